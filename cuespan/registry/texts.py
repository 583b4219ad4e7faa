"""Scalar text, clock, fuzzy, masking, version and verdict expressions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuespan import constants as K
from cuespan.functions import clock, fuzzy, safety, verdicts, versions
from cuespan.functions import text as tx
from cuespan.plans import fleet, transcripts
from cuespan.registry import tables as T
from cuespan.registry.book import query


def docs(spark, sf):
    return T.table(spark, sf, "documents")


@query("clock_and_part_no", """SELECT user_id, CASE WHEN user_id % 11 <> 0 THEN (user_id * 5 % 24) * 3600 + (user_id * 7 % 60) * 60 END AS base,
  CAST(user_id AS VARCHAR) AS part FROM (SELECT DISTINCT user_id FROM events)""")
def clock_and_part_no(spark, sf):
    p = T.parts(spark, sf)
    return p.select(
        F.col("part_seq").cast("long").alias("user_id"), clock.clock_base(F.col("filename")).alias("base"),
        clock.part_no(F.col("filename")).alias("part"),
    )


@query("clock_texts", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(count(*) AS BIGINT) AS n,
  printf('%02dm%02ds', CAST(l_extendedprice AS BIGINT) // 60, CAST(l_extendedprice AS BIGINT) % 60) AS mmss,
  printf('%02d:%02d:%02d', CAST(l_extendedprice AS BIGINT) // 3600 % 24, CAST(l_extendedprice AS BIGINT) % 3600 // 60, CAST(l_extendedprice AS BIGINT) % 60) AS wall,
  printf('%d分%02d秒', CAST(l_extendedprice AS BIGINT) // 60, CAST(l_extendedprice AS BIGINT) % 60) AS dur
FROM (SELECT * REPLACE (trunc(l_extendedprice) AS l_extendedprice) FROM lineitem) GROUP BY ALL""")
def clock_texts(spark, sf):
    sec = F.floor("l_extendedprice").cast("double")
    rows = T.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", clock.mmss(sec).alias("mmss"),
        clock.wall_clock(sec).alias("wall"), clock.minutes_text(sec).alias("dur"),
    )
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))


@query("slugs", r"""SELECT doc_id,
  coalesce(nullif(trim(substring(regexp_replace(text, '[/\\\s:|"''?*]+', '_', 'g'), 1, 40), '_'), ''), 'clip') AS slug
FROM documents""")
def slugs(spark, sf):
    return docs(spark, sf).select("doc_id", tx.slug(F.col("text")).alias("slug"))


@query("transcript_slugs", r"""SELECT doc_id,
  substring(coalesce(nullif(trim(regexp_replace(text, '[^\pL\pN\pM_]+', '_', 'g'), '_'), ''), 'asr'), 1, 48) AS slug,
  substring(coalesce(nullif(trim(regexp_replace(text, '[^\pL\pN\pM_（）()]+', ' ', 'g'), ' '), ''), 'live'), 1, 60) AS title
FROM documents""")
def transcript_slugs(spark, sf):
    t = F.col("text")
    return docs(spark, sf).select("doc_id", tx.transcript_slug(t).alias("slug"), tx.safe_title(t).alias("title"))


_EMO = " + ".join(
    f"((length(text) - length(replace(text, '{w}', ''))) // {len(w)})" if len(w) > 1
    else f"CASE WHEN length(text) - length(replace(text, '{w}', '')) >= 2 THEN length(text) - length(replace(text, '{w}', '')) - 1 ELSE 0 END"
    for w in K.EMOTION_WORDS
)


@query("speech_counts", f"""WITH {T.SE} SELECT src, id, CAST({_EMO} AS BIGINT) AS emo,
  CAST(CASE WHEN contains(text, '啊啊啊啊') THEN 2 ELSE 0 END + CASE WHEN contains(text, '牛牛') THEN 1 ELSE 0 END AS BIGINT) AS rep,
  length(replace(text, ' ', '')) AS dense FROM se""")
def speech_counts(spark, sf):
    s = T.sentences(spark, sf)
    return s.select(
        "src", F.col("id").cast("long").alias("id"), tx.emotion_count(F.col("text")).alias("emo"),
        tx.repeat_count(F.col("text")).alias("rep"), tx.dense_length(F.col("text")).cast("long").alias("dense"),
    )


@query("to_count", """SELECT event_id, CASE WHEN k % 3 = 0 THEN k * 1000 + k WHEN k % 3 = 1 THEN k END AS n
FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)""")
def to_count(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    text = F.when(k % 3 == 0, F.concat(k.cast("string"), F.lit(","), F.lpad(k.cast("string"), 3, "0"))).when(
        k % 3 == 1, F.concat(F.lit(" "), k.cast("string"))
    ).otherwise(F.concat(k.cast("string"), F.lit("x")))
    return T.table(spark, sf, "events").select("event_id", tx.to_count(text).alias("n"))


_WORDS = [("hot", 5), ("ring", 4), ("small", 3), ("widget", 2), ("plate", 1)]


@query("first_listed_item", "SELECT p_partkey, CASE " + " ".join(f"WHEN contains(p_name, '{w}') THEN {n}" for w, n in _WORDS[::-1]) + " END AS price, CASE " + " ".join(f"WHEN contains(p_name, '{w}') THEN '{w}'" for w, _ in _WORDS) + " END AS dearest FROM part")
def first_listed_item(spark, sf):
    """Containment lookup: list order for the price, dearest first for the label."""
    items = _WORDS[::-1]
    p = F.col("p_name")
    return T.table(spark, sf, "part").select(
        "p_partkey", tx.first_listed(p, items, "table").getField("price").alias("price"),
        tx.dearest_named(p, items).alias("dearest"),
    )


_KILL = "CASE " + " ".join(f"WHEN n = {k} THEN '{w}'" for k, w in K.KILL_WORDS.items()) + " ELSE n || '杀' END"


@query("captions", f"""SELECT o_orderkey, {_KILL} AS kill, '+' || CAST(round_even(o_totalprice / 10000, 0) AS BIGINT) || '万' AS wan,
  CASE WHEN o_totalprice * 10 >= 3000000 THEN '出大红！' WHEN o_totalprice * 10 >= 1000000 THEN '出红！' ELSE '高价值！' END AS loot
FROM (SELECT *, o_orderkey % 9 + 1 AS n FROM orders)""")
def captions(spark, sf):
    n, p = F.col("o_orderkey") % 9 + 1, F.col("o_totalprice")
    return T.table(spark, sf, "orders").select(
        "o_orderkey", tx.kill_word(n).alias("kill"), tx.wan_tag(p).alias("wan"), tx.loot_caption(p * 10).alias("loot")
    )


@query("fuzzy_targets", """WITH n AS (
  SELECT line, target, lag(target) OVER (PARTITION BY src ORDER BY line) AS before FROM (
    SELECT user_id AS src, event_id AS line, event_type || substring('abcde', 1, CAST(event_id % 6 AS INT)) AS target FROM events))
SELECT line, CASE WHEN target = before THEN true WHEN length(target) = 0 OR length(before) = 0 THEN false
  ELSE levenshtein(target, before) <= 1 OR contains(target, before) OR contains(before, target)
    OR (least(length(target), length(before)) >= 3 AND substring(target, 1, 2) = substring(before, 1, 2)
      AND right(target, 1) = right(before, 1) AND abs(length(target) - length(before)) <= 1) END AS same
FROM n""")
def fuzzy_targets(spark, sf):
    from cuespan.operators.ordered import lane, scan

    e = T.table(spark, sf, "events").select(
        F.col("user_id").alias("src"), F.col("event_id").alias("line"),
        F.concat("event_type", F.expr("substring('abcde', 1, cast(event_id % 6 as int))")).alias("target"),
    )
    rows = scan(e, lane("src", ("line",), 4096.0), prev={"before": F.col("target")})
    return rows.select("line", fuzzy.same_target(F.col("target"), F.col("before")).alias("same"))


@query("operator_and_weapon_names", """SELECT event_id, CASE k % 4 WHEN 0 THEN '红狼' WHEN 1 THEN '骇爪' WHEN 2 THEN '麦晓雯' END AS operator,
  CASE k % 6 WHEN 0 THEN 'SCAR-H' WHEN 1 THEN '坠星者' WHEN 3 THEN 'M4A1' WHEN 4 THEN '新枪' || k END AS weapon,
  CASE k % 4 WHEN 0 THEN '突击' WHEN 1 THEN '侦察' WHEN 2 THEN '侦察' END AS operator_class
FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)""")
def operator_and_weapon_names(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    op = F.when(k % 4 == 0, "x红狼!").when(k % 4 == 1, "骇瓜").when(k % 4 == 2, "麦晓文").otherwise("abc")
    arm = (
        F.when(k % 6 == 0, "scar h").when(k % 6 == 1, "星者").when(k % 6 == 2, "30/120").when(k % 6 == 3, "M4A7")
        .when(k % 6 == 4, F.concat(F.lit("新枪"), k.cast("string"))).otherwise("9x19mm")
    )
    named = fuzzy.match_operator(op)
    return T.table(spark, sf, "events").select(
        "event_id", named.alias("operator"), fuzzy.clean_weapon(arm).alias("weapon"),
        fuzzy.lookup(named, K.OPERATORS).alias("operator_class"),
    )


@query("masking", r"""SELECT doc_id, md5(regexp_replace(regexp_replace(' ' || text || ' ', '([^0-9])(1[3-9][0-9])[0-9]{4}([0-9]{4})([^0-9])', '\1\2****\3\4', 'g'),
  '(sk-[A-Za-z0-9]{8,}|Bearer\s+[A-Za-z0-9._\-]{8,})', '<已脱敏>', 'g')) AS masked,
  CASE WHEN length(CAST(doc_id * 123456789 AS VARCHAR)) <= 10 THEN CAST(doc_id * 123456789 AS VARCHAR)
    ELSE substring(CAST(doc_id * 123456789 AS VARCHAR), 1, 6) || '…' || right(CAST(doc_id * 123456789 AS VARCHAR), 4) END AS uid
FROM documents""")
def masking(spark, sf):
    return docs(spark, sf).select(
        "doc_id", F.md5(F.concat(F.lit(" "), safety.redact(F.col("text")), F.lit(" "))).alias("masked"),
        safety.mask_uid(F.col("doc_id") * 123456789).alias("uid"),
    )


@query("source_safety", """SELECT page_id, NOT contains(src, '://') AND NOT (contains(head, ':') AND NOT regexp_full_match(head, '[A-Za-z]:?')) AS ok
FROM (SELECT page_id, src, regexp_extract(src, '^([^\\\\/]*)', 1) AS head FROM (
  SELECT page_id, CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN '/data' || substring(url, 9) WHEN 2 THEN 'C:/v/' || page_id
    WHEN 3 THEN 'pipe:' || page_id ELSE 'plain' || page_id END AS src FROM pages))""")
def source_safety(spark, sf):
    p = F.col("page_id")
    src = (
        F.when(p % 5 == 0, F.col("url")).when(p % 5 == 1, F.concat(F.lit("/data"), F.expr("substring(url, 9)")))
        .when(p % 5 == 2, F.concat(F.lit("C:/v/"), p.cast("string"))).when(p % 5 == 3, F.concat(F.lit("pipe:"), p.cast("string")))
        .otherwise(F.concat(F.lit("plain"), p.cast("string")))
    )
    return T.table(spark, sf, "pages").select("page_id", safety.source_ok(src).alias("ok"))


@query("safe_components", r"""SELECT doc_id, c <> '' AND c NOT IN ('.', '..') AND NOT regexp_matches(c, '[/\\:\x00-\x1f\x7f]') AND octet_length(encode(c)) <= 255 AS ok,
  coalesce(regexp_full_match(source, '[A-Za-z0-9_-]{1,32}'), false) AS tenant
FROM (SELECT doc_id, source, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN source WHEN 2 THEN '..' ELSE lang || text END AS c FROM documents)""")
def safe_components(spark, sf):
    d = F.col("doc_id")
    c = F.when(d % 4 == 0, F.col("text")).when(d % 4 == 1, F.col("source")).when(d % 4 == 2, "..").otherwise(F.concat("lang", "text"))
    return docs(spark, sf).select("doc_id", safety.safe_component(c).alias("ok"), safety.tenant_ok(F.col("source")).alias("tenant"))


@query("upload_exclusions", f"""WITH {T.FILES} SELECT doc_id FROM fl WHERE NOT (contains(sub, 'x/') OR regexp_matches(path, '[^/]*_[0-9]*7\\.mp4$'))""")
def upload_exclusions(spark, sf):
    from cuespan.plans.catalog import upload_plan

    f = T.files(spark, sf).withColumn("rel", F.expr("substring(path, length(root) + 2)"))
    return upload_plan(f, F.lit("voice"), {"voice": ["x/", "*_*7.mp4"]}).select("doc_id")


@query("version_order", """WITH v AS (SELECT event_id, [CAST(k // 10 AS INT), CAST(k % 10 AS INT), 0] AS new, [3, 4, 0] AS cur, k % 7 AS r FROM (
  SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events))
SELECT event_id, CASE WHEN new <> cur THEN new > cur ELSE r > 3 END AS newer, new < [5, 0, 0] AS below FROM v""")
def version_order(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    v = F.concat(F.floor(k / 10).cast("string"), F.lit("."), (k % 10).cast("string"))
    b = F.concat(F.lit("20261022-r"), (k % 7).cast("string"))
    return T.table(spark, sf, "events").select(
        "event_id", versions.newer_than(v, b, F.lit("3.4.0"), F.lit("20261022-r3")).alias("newer"),
        versions.below_minimum(v, F.lit("5.0")).alias("below"),
    )


@query("fleet_verdicts", """SELECT c_custkey, CASE WHEN ram > 0 AND ram < 2 THEN 'bad' WHEN cpu < 2 OR (ram > 0 AND ram < 4) THEN 'warn' ELSE 'ok' END AS machine,
  CASE WHEN gb < 2 THEN 'bad' WHEN gb < 10 THEN 'warn' WHEN mbps < 20 THEN 'warn' ELSE 'ok' END AS disk,
  CASE WHEN ratio >= CAST(0.6 AS DOUBLE) THEN 'bad' WHEN ratio >= CAST(0.25 AS DOUBLE) THEN 'warn' ELSE 'ok' END AS decode,
  CASE WHEN ms >= 2500 THEN 'bad' WHEN ms >= 800 THEN 'warn' ELSE 'ok' END AS ocr,
  CASE WHEN ms <> 0 THEN round_even(1800 * (ms / 1000) / greatest(2, least(6, cpu // 4)) / 60 + 1800 * ratio / 60, 1) END AS minutes
FROM (SELECT c_custkey, c_custkey % 17 + 1 AS cpu, CAST(c_custkey % 9 AS DOUBLE) AS ram, CAST(c_custkey % 23 AS DOUBLE) AS gb,
  CAST(c_custkey % 41 AS DOUBLE) AS mbps, c_custkey % 101 / CAST(100 AS DOUBLE) AS ratio, CAST(c_custkey % 4001 AS DOUBLE) + CAST(0.37 AS DOUBLE) AS ms FROM customer)""")
def fleet_verdicts(spark, sf):
    c = F.col("c_custkey")
    d = T.table(spark, sf, "customer").select(
        "c_custkey", (c % 17 + 1).alias("cpu"), (c % 9).cast("double").alias("ram"), (c % 23).cast("double").alias("gb"),
        (c % 41).cast("double").alias("mbps"), ((c % 101) / 100.0).alias("ratio"), ((c % 4001).cast("double") + 0.37).alias("ms"),
    )
    return d.select(
        "c_custkey", verdicts.machine_verdict(F.col("cpu"), F.col("ram")).alias("machine"),
        verdicts.disk_verdict(F.col("gb"), F.lit(None).cast("double"), F.col("mbps"), F.lit(None).cast("string")).alias("disk"),
        verdicts.decode_verdict(F.col("ratio")).alias("decode"), verdicts.ocr_verdict(F.col("ms")).alias("ocr"),
        verdicts.minutes_for_half_hour(F.col("ms"), F.col("ratio"), F.col("cpu")).alias("minutes"),
    )


@query("rule_clamp", """SELECT c_custkey, key, CASE WHEN key = 'threshold_gb' THEN greatest(CAST(0.05 AS DOUBLE), least(100, v)) ELSE greatest(10, least(1440, v)) END AS value
FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'threshold_gb' WHEN 1 THEN 'scan_interval_min' ELSE 'hack' END AS key, CAST(c_custkey AS DOUBLE) AS v FROM customer)
WHERE key <> 'hack' AND CAST(v AS BIGINT) % 10 <> 9""")
def rule_clamp(spark, sf):
    c = F.col("c_custkey")
    rules = T.table(spark, sf, "customer").select(
        "c_custkey",
        F.when(c % 3 == 0, "threshold_gb").when(c % 3 == 1, "scan_interval_min").otherwise("hack").alias("key"),
        F.when(c % 10 == 9, "abc").otherwise(c.cast("string")).alias("value"),
    )
    return fleet.clamp_rules(rules).select("c_custkey", "key", "value")


@query("layered_config", """SELECT o_custkey, o_orderpriority, arg_max(o_totalprice, o_orderkey) AS value FROM orders GROUP BY 1, 2""")
def layered_config(spark, sf):
    o = T.table(spark, sf, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", F.col("o_totalprice").alias("value"))
    return fleet.layered(o, ["o_custkey", "o_orderpriority"], "o_orderkey", ["value"])


@query("work_hours", """SELECT event_id, hour(ts) >= 4 AND hour(ts) < 12 AS day, hour(ts) >= 22 OR hour(ts) < 6 AS night FROM events""")
def work_hours(spark, sf):
    h = F.hour("ts")
    return T.table(spark, sf, "events").select("event_id", clock.in_hours(h, 4, 12).alias("day"), clock.in_hours(h, 22, 6).alias("night"))


@query("process_presence", """SELECT user_id AS host, ts, bool_or(event_type IN ('click', 'view')) AS hit FROM events GROUP BY 1, 2""")
def process_presence(spark, sf):
    from cuespan.streaming.jobs import process_hits

    e = T.table(spark, sf, "events")
    name = F.when(F.col("event_type") == "click", "DeltaForceClient.exe").when(F.col("event_type") == "view", "delta_force.exe").when(
        F.col("event_type") == "error", "delta_force_launcher.exe").otherwise("browser.exe")
    return process_hits(e.select(F.col("user_id").alias("host"), "ts", name.alias("process_name")), K.PROCESS_NAMES, K.PROCESS_EXCLUDES)


@query("mojibake_repair")
def mojibake_repair(spark, sf):
    return fleet.repair_mojibake(docs(spark, sf), "text").select("doc_id", F.md5("text").alias("fixed"))


@query("sentence_split", """SELECT doc_id, CAST(len(regexp_extract_all(text, '([^。！？!?]*[。！？!?]|[^。！？!?]+)', 1)) AS BIGINT) AS n,
  md5(array_to_string(regexp_extract_all(text, '([^。！？!?]*[。！？!?]|[^。！？!?]+)', 1), '|')) AS pieces FROM documents
WHERE len(regexp_extract_all(text, '([^。！？!?]*[。！？!?]|[^。！？!?]+)', 1)) > 0""")
def sentence_split(spark, sf):
    d = docs(spark, sf).select("doc_id", F.replace("text", F.lit("."), F.lit(".")).alias("text"))
    p = transcripts.split_sentences(d, ("doc_id",))
    return p.groupBy("doc_id").agg(
        F.count("*").alias("n"),
        F.md5(F.array_join(F.array_sort(F.collect_list(F.struct("pos", "piece"))).getField("piece"), "|")).alias("pieces"),
    )


@query("timed_sentences", r"""WITH t AS (SELECT source, doc_id, regexp_extract_all(replace(text, '.', '。'), '[^。！？!?]*[。！？!?]|[^。！？!?]+') AS ps FROM documents),
p AS (SELECT source, doc_id, unnest(ps) AS piece, generate_subscripts(ps, 1) - 1 AS pos FROM t),
k AS (SELECT *, length(regexp_replace(piece, '[^\p{L}\p{N}]', '', 'g')) AS k FROM p),
u AS (SELECT *, sum(k) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM k)
SELECT source AS session, CAST(doc_id AS VARCHAR) AS src, CAST(pos AS INT) AS id, CAST((upto - k) * 200 AS DOUBLE) / 1000 AS start,
  CAST((upto - 1) * 200 + 180 AS DOUBLE) / 1000 AS "end", trim(piece) AS text FROM u WHERE k > 0 AND trim(piece) <> ''""")
def timed_sentences(spark, sf):
    """Documents as recognised texts, 200 ms per character; every sentence gets its times."""
    t = F.regexp_replace("text", r"\.", "。")
    n = F.length(F.regexp_replace(t, r"[^\p{L}\p{N}]", ""))
    stamps = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array(i.cast("long") * 200, i.cast("long") * 200 + 180)))
    d = docs(spark, sf).select(F.col("source").alias("session"), F.col("doc_id").cast("string").alias("src"), t.alias("text"),
                               F.coalesce(stamps, F.array().cast("array<array<bigint>>")).alias("stamps"))
    return transcripts.timed_sentences(d)


@query("localized_paths", """SELECT page_id, CASE WHEN starts_with(p, '/opt/data/') THEN '/home/me/' || (page_id % 3) || '/' || regexp_extract(p, '([^/]*)$', 1) ELSE p END AS cover
FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '/opt/data/' || url ELSE url END AS p FROM pages)""")
def localized_paths(spark, sf):
    from cuespan.plans.catalog import localize_fields

    p = T.table(spark, sf, "pages").select(
        "page_id", F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("/opt/data/"), "url")).otherwise(F.col("url")).alias("cover"),
        F.concat(F.lit("/home/me/"), (F.col("page_id") % 3).cast("string")).alias("folder"),
    )
    return localize_fields(p, "/opt/data", "folder", ["cover"]).select("page_id", "cover")
