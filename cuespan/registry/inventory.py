"""Watched folders, jobs, recordings, storage, retention, catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuespan.plans import catalog, inventory
from cuespan.registry import tables as T
from cuespan.registry.book import query

NOW, STABLE = 200000.0, 3000.0


def jobs(spark, sf):
    """Labels as jobs on the folders of the documents' files."""
    f = T.files(spark, sf).select("doc_id", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("path"), F.col("path").alias("file"))
    lab = T.table(spark, sf, "labels").join(f, "doc_id")
    d = F.col("doc_id")
    return lab.select(
        d.cast("string").alias("key"), F.when(d % 3 == 0, F.col("file")).otherwise(F.col("path")).alias("path"),
        F.regexp_extract("path", r"([^/]*)$", 1).alias("session"),
        F.when(d % 4 == 0, "running").when(d % 4 == 1, "queued").when(d % 4 == 2, "done").otherwise("failed").alias("state"),
        F.date_format(F.timestamp_seconds(F.lit(1700000000) + d * 61), "yyyy-MM-dd HH:mm:ss").alias("enqueued_at"),
        F.lit(None).cast("string").alias("done_key"), (d % 3 != 0).alias("is_dir"),
    )


JOBS = T.FILES + """, jb AS (
  SELECT CAST(doc_id AS VARCHAR) AS key, doc_id, CASE WHEN doc_id % 3 = 0 THEN path ELSE regexp_extract(path, '^(.*)/[^/]*$', 1) END AS path,
    regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, doc_id % 3 <> 0 AS is_dir,
    ['running', 'queued', 'done', 'failed'][doc_id % 4 + 1] AS state, 1700000000 + doc_id * 61 AS enq
  FROM labels JOIN fl USING (doc_id))"""


@query("watch_targets", f"""WITH {T.FILES}, v AS (SELECT * FROM fl WHERE is_video),
l AS (SELECT root, path AS target, true AS loose FROM v WHERE sub = '' AND size > 0 AND {NOW} - mtime >= {STABLE}),
d AS (SELECT root, root || '/' || a AS target, bool_and(size > 0 AND {NOW} - mtime >= {STABLE}) AS ok, bool_or(rtrim(sub, '/') = a) AS direct
  FROM (SELECT v.*, unnest(CASE sub WHEN 'A/' THEN ['A'] WHEN 'A/x/' THEN ['A', 'A/x'] WHEN 'B/' THEN ['B'] WHEN 'C/y/z/' THEN ['C', 'C/y'] ELSE [] END) AS a FROM v) GROUP BY 1, 2),
t AS (SELECT * FROM d WHERE ok AND direct)
SELECT root, target, false AS loose FROM t WHERE NOT EXISTS (SELECT 1 FROM t u WHERE u.root = t.root AND starts_with(u.target, t.target || '/'))
UNION ALL SELECT root, target, loose FROM l""")
def watch_targets(spark, sf):
    return inventory.targets(T.files(spark, sf), STABLE, NOW)


@query("stable_groups", f"""WITH {T.FILES} SELECT root, sub, bool_and(size > 0 AND {NOW} - mtime >= {STABLE}) AS ok FROM fl GROUP BY 1, 2""")
def stable_groups(spark, sf):
    f = T.files(spark, sf)
    sub = F.regexp_extract(F.expr("substring(path, length(root) + 2)"), r"^(.*/)?[^/]*$", 1)
    return f.groupBy("root", sub.alias("sub")).agg(inventory.settled(STABLE, NOW).alias("ok"))


@query("fingerprints", f"""WITH {T.FILES}, a AS (SELECT *, unnest(CASE sub WHEN '' THEN [root] WHEN 'A/' THEN [root, root || '/A'] WHEN 'A/x/' THEN [root, root || '/A', root || '/A/x']
  WHEN 'B/' THEN [root, root || '/B'] ELSE [root, root || '/C', root || '/C/y', root || '/C/y/z'] END) AS target FROM fl WHERE is_video)
SELECT target, sha1(target || string_agg('|' || regexp_extract(path, '([^/]*)$', 1) || '|' || size || '|' || CAST(mtime AS BIGINT), '' ORDER BY string_split(path, '/'))) AS fingerprint
FROM a GROUP BY 1""")
def fingerprints(spark, sf):
    return inventory.fingerprints(T.files(spark, sf))


@query("covered_targets", f"""WITH {JOBS}, a AS (SELECT *, unnest(CASE sub WHEN '' THEN [root] WHEN 'A/' THEN [root, root || '/A'] WHEN 'A/x/' THEN [root, root || '/A', root || '/A/x']
  WHEN 'B/' THEN [root, root || '/B'] ELSE [root, root || '/C', root || '/C/y', root || '/C/y/z'] END) AS target FROM fl WHERE is_video),
p AS (SELECT target, sha1(target || string_agg('|' || regexp_extract(path, '([^/]*)$', 1) || '|' || size || '|' || CAST(mtime AS BIGINT), '' ORDER BY string_split(path, '/'))) AS fingerprint FROM a GROUP BY 1),
j AS (SELECT path, arg_min(state, (enq, key)) AS state FROM jb GROUP BY 1)
SELECT target, fingerprint, coalesce(state = 'done', false) AS done FROM p LEFT JOIN j ON j.path = p.target""")
def covered_targets(spark, sf):
    p = inventory.fingerprints(T.files(spark, sf))
    j = jobs(spark, sf).join(p.withColumnRenamed("target", "path").withColumnRenamed("fingerprint", "fp"), "path", "left")
    return inventory.covered(p, j.withColumn("done_key", F.when(F.col("state") == "done", F.col("fp"))).drop("fp"))


@query("unprocessed_bytes", f"""WITH {JOBS}, g AS (
  SELECT root, regexp_extract(path, '^(.*)/[^/]*$', 1) AS target, bool_and(size > 0 AND {NOW} - mtime >= {STABLE}) AS ok, sum(size) AS b
  FROM fl WHERE is_video GROUP BY 1, 2),
f AS (SELECT path, arg_min(state, (enq, key)) AS state FROM jb GROUP BY 1)
SELECT r.root, CAST(coalesce(sum(g.b) FILTER (g.ok AND coalesce(f.state, '') <> 'done'), 0) AS BIGINT) AS bytes
FROM (SELECT DISTINCT root FROM fl) r LEFT JOIN g ON g.root = r.root LEFT JOIN f ON f.path = g.target GROUP BY 1""")
def unprocessed_bytes(spark, sf):
    f = T.files(spark, sf)
    p = inventory.fingerprints(f).withColumnRenamed("target", "path")
    j = jobs(spark, sf).join(p, "path", "left").withColumn("done_key", F.col("fingerprint")).drop("fingerprint")
    return inventory.unprocessed_bytes(f, j, STABLE, NOW)


@query("new_bytes", f"""WITH {T.FILES}, g AS (
  SELECT root, CASE WHEN sub = '' THEN path ELSE sub[1] END AS entry, bool_and(size > 0 AND {NOW} - mtime >= {STABLE}) AS ok,
    coalesce(sum(size) FILTER (mtime > {NOW} - 86400 AND mtime <= {NOW}), 0) AS b FROM fl WHERE is_video GROUP BY 1, 2)
SELECT root, CAST(coalesce(sum(b) FILTER (ok), 0) AS BIGINT) AS bytes FROM g GROUP BY 1""")
def new_bytes(spark, sf):
    return inventory.new_bytes(T.files(spark, sf), STABLE, NOW)


@query("files_below_depth", f"""WITH {T.FILES} SELECT root, count(*) FILTER (length(sub) > 4) AS files, CAST(coalesce(sum(size) FILTER (length(sub) > 4), 0) AS BIGINT) AS bytes
FROM fl WHERE is_video GROUP BY 1""")
def files_below_depth(spark, sf):
    """What a watch of two levels of folders leaves out."""
    return inventory.left_out(T.files(spark, sf), 2)


@query("pending_sources", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_sources(spark, sf):
    d = T.table(spark, sf, "documents").select(F.col("doc_id").alias("src"))
    s = T.table(spark, sf, "labels").select(F.col("doc_id").alias("src"))
    return inventory.pending(d, s).select(F.col("src").alias("doc_id"))


@query("lineitem_without_order", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def lineitem_without_order(spark, sf):
    li = T.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("src"), "l_linenumber", "l_partkey")
    o = T.table(spark, sf, "orders").where(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("src"))
    return inventory.pending(li, o).select(F.col("src").alias("l_orderkey"), "l_linenumber", "l_partkey")


@query("merged_jobs", f"""WITH {JOBS}, r AS (
  SELECT *, row_number() OVER (PARTITION BY folder ORDER BY CASE state WHEN 'running' THEN 0 WHEN 'queued' THEN 1 ELSE 2 END, enq, key) AS rn, count(*) OVER (PARTITION BY folder) AS n FROM jb)
SELECT key, CASE WHEN n > 1 THEN folder ELSE path END AS path, state FROM r WHERE rn = 1""")
def merged_jobs(spark, sf):
    return inventory.merge_jobs(jobs(spark, sf)).select("key", "path", "state")


@query("job_states", f"WITH {JOBS} SELECT state, count(*) AS n FROM jb GROUP BY 1")
def job_states(spark, sf):
    return inventory.job_counts(jobs(spark, sf))


@query("job_order", f"WITH {JOBS} SELECT key, row_number() OVER (ORDER BY enq, key) AS place, state = 'failed' AS failed FROM jb")
def job_order(spark, sf):
    j = jobs(spark, sf)
    failed = inventory.failed_sessions(j).select("key", F.lit(True).alias("failed"))
    return inventory.jobs_in_order(j).join(failed, "key", "left").select("key", "place", F.coalesce("failed", F.lit(False)).alias("failed"))


@query("latest_counts", """WITH i AS (SELECT ['knockdowns', 'pickups', 'queues', 'voice'][o_orderkey % 4 + 1] AS line, 's' || (o_custkey % 50) || '_P' || (o_orderkey % 3) AS session,
  epoch_us(o_orderdate) // 1000000 * 100000 + o_orderkey AS mtime, o_orderkey % 17 AS n FROM orders),
v AS (SELECT regexp_extract(session, '^(.*)_P[0-9]', 1) AS session, max(mtime) AS mtime, sum(n) AS n FROM i WHERE line = 'voice' GROUP BY 1)
SELECT line, arg_max(session, mtime) AS session, CAST(arg_max(n, mtime) AS BIGINT) AS n FROM i WHERE line <> 'voice' GROUP BY 1
UNION ALL SELECT 'voice', arg_max(session, mtime), CAST(arg_max(n, mtime) AS BIGINT) FROM v""")
def latest_counts(spark, sf):
    o = T.table(spark, sf, "orders")
    line = F.element_at(F.array(*[F.lit(x) for x in ("knockdowns", "pickups", "queues", "voice")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    rows = o.select(
        line.alias("line"), F.concat(F.lit("s"), (F.col("o_custkey") % 50).cast("string"), F.lit("_P"), (F.col("o_orderkey") % 3).cast("string")).alias("session"),
        (F.unix_seconds(F.col("o_orderdate").cast("timestamp")) * 100000 + F.col("o_orderkey")).alias("mtime"), (F.col("o_orderkey") % 17).alias("n"),
    )
    return inventory.latest_counts(rows)


@query("next_part_numbers", f"""WITH {T.FILES} SELECT d.folder, d.doc_id, coalesce(t.top, 0) + row_number() OVER (PARTITION BY d.folder ORDER BY d.doc_id) AS part_no
FROM (SELECT *, '/w/' || source AS folder FROM documents WHERE lang = 'fr') d LEFT JOIN (SELECT root AS folder, max(doc_id % 13) AS top FROM fl WHERE is_video GROUP BY 1) t USING (folder)""")
def next_part_numbers(spark, sf):
    f = T.files(spark, sf).where("is_video").select(F.col("root").alias("folder"), "path")
    new = T.table(spark, sf, "documents").where(F.col("lang") == "fr").select(
        F.concat(F.lit("/w/"), "source").alias("folder"), F.col("doc_id").cast("double").alias("started"), "doc_id"
    )
    return inventory.next_parts(f, new).select("folder", "doc_id", "part_no")


@query("register_recordings", """WITH known AS (SELECT count(*) AS n FROM labels)
SELECT 'v' || lpad(CAST(n + row_number() OVER (ORDER BY doc_id) AS VARCHAR), CAST(greatest(3, length(CAST(n + row_number() OVER (ORDER BY doc_id) AS VARCHAR))) AS INT), '0') AS id,
  'f' || doc_id AS source_path FROM documents, known WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def register_recordings(spark, sf):
    from cuespan.operators.ranged import number_all

    lab = number_all(T.table(spark, sf, "labels").select("doc_id"), ["doc_id"], "n")
    index = lab.select(F.format_string("v%03d", "n").alias("id"), F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("source_path"))
    new = T.table(spark, sf, "documents").select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("source_path"), F.col("doc_id").alias("ord"))
    return inventory.register(index, new).select("id", "source_path")


@query("retention_victims", """SELECT tenant, session FROM (SELECT o_custkey AS tenant, o_orderkey AS session,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS newest FROM orders) WHERE newest > 3""")
def retention_victims(spark, sf):
    o = T.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("tenant"), F.col("o_orderkey").alias("session"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("imported_at")
    )
    return catalog.retention(o, 3, width=365 * 86400.0).select("tenant", "session")


@query("victim_artifacts", """WITH v AS (SELECT o_custkey AS tenant, o_orderkey AS session, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS newest FROM orders)
SELECT tenant, CAST(session AS VARCHAR) AS session, unnest(['sessions', 'asr', 'knockdowns']) AS tree, unnest([CAST(session AS VARCHAR), 'a' || session, CASE WHEN session % 2 = 0 THEN 'k' || session END]) AS name
FROM v WHERE newest > 3 AND session % 2 = 0 UNION ALL
SELECT tenant, CAST(session AS VARCHAR), unnest(['sessions', 'asr']), unnest([CAST(session AS VARCHAR), 'a' || session]) FROM v WHERE newest > 3 AND session % 2 = 1""")
def victim_artifacts(spark, sf):
    k = F.col("o_orderkey")
    name = k.cast("string")
    o = T.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("tenant"), k.alias("o"), name.alias("session"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("imported_at"),
        F.array(F.struct(F.concat(F.lit("a"), name).alias("asr_dir"), F.lit("../x").alias("events_rpt"))).alias("parts"),
        F.struct(
            F.when(k % 2 == 0, F.concat(F.lit("k"), name)).otherwise("a/b").alias("knockdowns"), F.lit(None).cast("string").alias("pickups"),
            F.lit(None).cast("string").alias("report"), F.array(F.lit("..")).alias("voice"),
        ).alias("lines"),
    )
    v = catalog.retention(o.withColumn("session", F.col("o")), 3, width=365 * 86400.0).withColumn("session", F.col("o").cast("string"))
    return catalog.victim_artifacts(v)


@query("storage_use", """SELECT source AS tenant, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 's' || (doc_id % 7) END AS session, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents GROUP BY 1, 2""")
def storage_use(spark, sf):
    d = F.col("doc_id")
    f = T.table(spark, sf, "documents").select(
        F.concat(F.lit("/r/tenants/"), "source", F.when(d % 3 == 0, "/data/x/").otherwise(F.concat(F.lit("/sessions/s"), (d % 7).cast("string"), F.lit("/"))), d.cast("string")).alias("path"),
        F.col("n_chars").alias("size"),
    )
    return catalog.storage_use(f)


@query("files_signature", """SELECT source, substring(sha256(string_agg('p' || doc_id || '|' || n_chars || '|' || md5(text), chr(10) ORDER BY doc_id)), 1, 16) AS signature FROM documents GROUP BY 1""")
def files_signature(spark, sf):
    f = T.table(spark, sf, "documents").select(
        "source", "doc_id", F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("path"), F.col("n_chars").alias("size"), F.md5("text").alias("sha")
    )
    return catalog.files_signature(f, ["source"], "doc_id")


@query("source_remap", """SELECT event_id, CASE user_id % 4 WHEN 0 THEN '/srv/v' || user_id WHEN 1 THEN '/srv/v' || user_id END AS src,
  CASE user_id % 4 WHEN 0 THEN 'remapped' WHEN 1 THEN 'unchanged' ELSE 'dropped' END AS status FROM events WHERE user_id % 4 < 2
UNION ALL SELECT event_id, CASE user_id % 4 WHEN 2 THEN 'http://x/' || user_id ELSE '/etc/passwd' END, 'dropped' FROM events WHERE user_id % 4 >= 2""")
def source_remap(spark, sf):
    u = F.col("user_id")
    e = T.table(spark, sf, "events")
    name = u.cast("string")
    src = F.when(u % 4 == 0, F.concat(F.lit("C:/me/v"), name)).when(u % 4 == 1, F.concat(F.lit("/srv/v"), name)).when(
        u % 4 == 2, F.concat(F.lit("http://x/"), name)).otherwise("/etc/passwd")
    rows = e.select("event_id", F.lit("s").alias("session"), src.alias("src"))
    vm = e.select(F.lit("s").alias("session"), F.concat(F.lit("C:/me/v"), name).alias("client_video"), F.concat(F.lit("/srv/v"), name).alias("server_video")).distinct()
    return catalog.remap_sources(rows, vm).select("event_id", "src", "status")


def complete(spark, sf):
    p = T.parts(spark, sf)
    conv = T.table(spark, sf, "conversations").select("conv_id").distinct()
    tr = conv.select(F.concat(F.lit("u"), F.col("conv_id").cast("string")).alias("game"), F.concat(F.lit("/asr/"), F.col("conv_id").cast("string")).alias("path"),
                     F.concat(F.lit("a"), F.col("conv_id").cast("string")).alias("asr_dir"))
    ev = T.timeline(spark, sf).where(F.col("kind") == "dance").where(F.col("k") > 60).select("src")
    vd = conv.where(F.col("conv_id") % 2 == 0).select(F.concat(F.lit("a"), F.col("conv_id").cast("string")).alias("voice_dir"))
    return catalog.completeness(p, tr, ev, vd)


@query("session_completeness", f"""WITH {T.TL}, c AS (SELECT DISTINCT 'u' || conv_id AS src, conv_id FROM conversations), e AS (SELECT DISTINCT src FROM tl WHERE kind = 'dance' AND k > 60)
SELECT p.src, 'a' || c.conv_id AS asr_dir, CASE WHEN c.conv_id % 2 = 0 THEN 'a' || c.conv_id END AS voice_dir, e.src IS NOT NULL AS has_events,
  CAST((c.src IS NULL)::INT + (e.src IS NULL)::INT AS BIGINT) AS n_missing
FROM (SELECT DISTINCT 'u' || user_id AS src FROM events) p LEFT JOIN c ON c.src = p.src LEFT JOIN e ON e.src = p.src""")
def session_completeness(spark, sf):
    c = complete(spark, sf)
    return c.select("src", "asr_dir", "voice_dir", F.col("events_rpt").isNotNull().alias("has_events"), F.size("missing").cast("long").alias("n_missing"))


@query("manifests", f"""WITH {T.TL}, c AS (SELECT DISTINCT 'u' || conv_id AS src FROM conversations), e AS (SELECT DISTINCT src FROM tl WHERE kind = 'dance' AND k > 60)
SELECT 's' || (user_id % 16) AS session, count(*) AS n_parts, CAST(sum((c.src IS NULL)::INT + (e.src IS NULL)::INT) AS BIGINT) AS n_missing, true AS ok
FROM (SELECT DISTINCT user_id FROM events) p LEFT JOIN c ON c.src = 'u' || user_id LEFT JOIN e ON e.src = 'u' || user_id GROUP BY 1""")
def manifests(spark, sf):
    c = complete(spark, sf)
    lines = c.select("session").distinct().select("session", F.col("session").alias("knockdowns"), F.col("session").alias("pickups"))
    m = catalog.manifests(c, "eval", "1.6.0", F.lit("2026-01-01T00:00:00"), lines)
    return m.select("session", F.size("parts").cast("long").alias("n_parts"), F.size("missing").cast("long").alias("n_missing"),
                    catalog.manifest_ok(F.col("parts"), F.col("lines"), F.col("session")).alias("ok"))


@query("state_merge", """SELECT coalesce(m.c_custkey, s.c_custkey) AS session, coalesce(m.c_mktsegment, s.c_mktsegment) AS mode, s.c_name AS report, m.c_nationkey AS missing
FROM (SELECT * FROM customer WHERE c_custkey % 3 <> 0) s FULL JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) m ON s.c_custkey = m.c_custkey""")
def state_merge(spark, sf):
    c = T.table(spark, sf, "customer")
    s = c.where(F.col("c_custkey") % 3 != 0).select(F.col("c_custkey").alias("session"), F.col("c_mktsegment").alias("mode"), F.col("c_name").alias("report"))
    m = c.where(F.col("c_custkey") % 2 == 0).select(F.col("c_custkey").alias("session"), F.col("c_mktsegment").alias("mode"), F.col("c_nationkey").alias("missing"))
    return catalog.merge_state(s, m, [])
