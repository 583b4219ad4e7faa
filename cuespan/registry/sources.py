"""Readers and sinks over lines, documents and listings built from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuespan.plans import clips, edl, transcripts
from cuespan.registry import tables as T
from cuespan.registry.book import query
from cuespan.registry.matches import KNOCKS, build, knocks, pickups
from cuespan.session import new_folder, stored
from cuespan.sources import events as ev
from cuespan.sources import media


def event_lines(spark, sf):
    """Events as lines of one file per user; lines of every 29th event are cut off."""
    e = T.table(spark, sf, "events")
    u = F.col("user_id").cast("string")
    body = F.to_json(
        F.struct(
            F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("u"), u)).alias("src"), F.col("event_type").alias("kind"),
            F.col("value").alias("confidence"), F.struct(F.when(F.col("event_id") % 2 == 0, F.array(F.lit("M7"))).alias("weapons")).alias("meta"),
        )
    )
    line = F.when(F.col("event_id") % 29 == 0, F.expr("substring(body, 1, length(body) - 4)")).otherwise(F.col("body"))
    folder = F.concat(F.lit("d"), u, F.when(F.col("user_id") % 2 == 0, "_full").otherwise(""))
    rows = e.withColumn("body", body).select(F.concat(folder, F.lit("/events.jsonl")).alias("path"), folder.alias("part_dir"), "user_id", "event_id", line.alias("line"))
    from cuespan.operators.ordered import lane, scan

    rows = scan(rows, lane("path", ("event_id",), 4096.0), running={"pos": F.lit(1).cast("long")}, following={"__n": F.col("event_id")})
    return rows.select("path", "part_dir", (F.col("pos") - 1).alias("pos"), "line", F.col("__n").isNull().alias("last"), "user_id", "event_id")


LINES = """ln AS (SELECT user_id, event_id, event_id % 29 = 0 AS bad, row_number() OVER w - 1 AS pos, lead(event_id) OVER w IS NULL AS last,
  'd' || user_id || CASE WHEN user_id % 2 = 0 THEN '_full' ELSE '' END AS part_dir, CASE WHEN event_id % 3 <> 0 THEN 'u' || user_id END AS src
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
fi AS (SELECT part_dir, user_id, NOT bool_or(last AND bad) AS usable, count(*) FILTER (NOT bad) AS n_events, count(*) FILTER (bad) AS n_bad,
  arg_min(CASE WHEN bad THEN '' ELSE coalesce(src, '') END, pos) AS first_src, bool_or(pos = 0 AND bad) AS first_bad FROM ln GROUP BY 1, 2)"""


@query("event_files", f"WITH {LINES} SELECT part_dir, usable, n_events, n_bad FROM fi")
def event_files(spark, sf):
    return ev.event_files(ev.parse_lines(event_lines(spark, sf))).select("part_dir", "usable", "n_events", "n_bad")


@query("usable_event_rows", f"WITH {LINES} SELECT ln.part_dir, pos AS line_no, coalesce(src, '') AS src, event_id % 2 = 0 AS armed FROM ln JOIN fi USING (part_dir) WHERE usable AND NOT bad")
def usable_event_rows(spark, sf):
    e = ev.usable_events(ev.parse_lines(event_lines(spark, sf)))
    return e.select("part_dir", "line_no", F.coalesce("src", F.lit("")).alias("src"), F.col("meta.weapons").isNotNull().alias("armed"))


def written_lines(spark, sf):
    """The event lines as files of the shared folder, one per user, read back as lines."""
    folder = new_folder(spark, "events")
    rows = event_lines(spark, sf).select(F.regexp_replace("part_dir", "^d", "").alias("part"), "pos", "line")
    # a file is far more work than its few bytes say: a fixed number of partitions isn't merged by size into one or two
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(tasks, "part").sortWithinPartitions("part", "pos")
    # tasks move their own files into the new folder: the other committer moves all of them one by one in the driver
    dealt.select("part", "line").write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("part").text(folder)
    # read from the folder, so that its listing is dealt to tasks; a pattern is matched in the driver, folder by folder
    lines = ev.read_lines(spark, folder, recursiveFileLookup="true", pathGlobFilter="*.txt")
    return lines.withColumn("part_dir", F.regexp_replace("part_dir", "^part=", "d"))


@query("written_event_files", f"WITH {LINES} SELECT part_dir, usable, n_events, n_bad, coalesce(CASE WHEN first_bad THEN NULL ELSE nullif(first_src, '') END, '-') AS first_src FROM fi")
def written_event_files(spark, sf):
    f = ev.event_files(ev.parse_lines(written_lines(spark, sf)))
    first = F.when(~F.col("first_bad"), F.col("first_src"))
    return f.select("part_dir", "usable", "n_events", "n_bad", F.coalesce(first, F.lit("-")).alias("first_src"))


@query("written_event_rows", f"WITH {LINES} SELECT ln.part_dir, pos AS line_no, coalesce(src, '') AS src, CASE WHEN event_id % 2 = 0 THEN 'M7' ELSE '' END AS weapons FROM ln JOIN fi USING (part_dir) WHERE usable AND NOT bad")
def written_event_rows(spark, sf):
    # many small files, read once for both the rows and the files that were cut off
    e = ev.usable_events(ev.parse_lines(stored(written_lines(spark, sf))))
    weapons = F.coalesce(F.array_join("meta.weapons", ","), F.lit(""))
    return e.select("part_dir", "line_no", F.coalesce("src", F.lit("")).alias("src"), weapons.alias("weapons"))


@query("stored_events", f"WITH {T.TL} SELECT session, src, kind, round(t_start, 1) AS t_start, round(t_end, 1) AS t_end FROM tl")
def stored_events(spark, sf):
    """The timeline written by the event sink and read back."""
    folder = new_folder(spark, "stored")
    e = T.timeline(spark, sf).select("session", "src", "kind", "t_start", "t_end")
    ev.write_events(e, folder)
    return ev.read_events(spark, folder).select("session", "src", "kind", "t_start", "t_end")


def report_parts(spark, sf):
    return T.table(spark, sf, "events").select("user_id").distinct().select(
        F.lit("s").alias("session"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("src"),
        F.concat(F.lit("d"), F.col("user_id").cast("string"), F.lit(".mp4")).alias("filename"),
    )


@query("resolved_reports", f"""WITH {LINES} SELECT 'u' || user_id AS src, part_dir || '/events.jsonl' AS path FROM fi
WHERE usable AND (user_id % 2 = 0 OR (NOT first_bad AND first_src = 'u' || user_id))""")
def resolved_reports(spark, sf):
    f = ev.event_files(ev.parse_lines(event_lines(spark, sf)))
    return ev.resolve_reports(report_parts(spark, sf), f).select("src", "path")


@query("resolved_uploads", f"""WITH {LINES} SELECT 'u' || user_id AS src, part_dir || '/events.jsonl' AS path FROM fi
WHERE NOT first_bad AND (user_id % 2 = 0 OR first_src = 'u' || user_id)""")
def resolved_uploads(spark, sf):
    f = ev.event_files(ev.parse_lines(event_lines(spark, sf)))
    return ev.resolve_uploads(report_parts(spark, sf), f).select("src", "path")


@query("part_event_counts", f"""WITH {LINES} SELECT 'u' || user_id AS src, n_events AS n FROM fi
WHERE usable AND n_events > 0 AND (user_id % 2 = 0 OR (NOT first_bad AND first_src = 'u' || user_id))""")
def part_event_counts(spark, sf):
    """Events of each part from its resolved file, with missing sources filled in."""
    p = ev.parse_lines(event_lines(spark, sf))
    e = ev.part_events(report_parts(spark, sf), ev.event_files(p), ev.usable_events(p))
    return e.groupBy("src").agg(F.count("*").alias("n"))


@query("missing_parts", "SELECT DISTINCT 'u' || user_id AS src FROM events WHERE user_id NOT IN (SELECT conv_id FROM conversations)")
def missing_parts(spark, sf):
    scanned = T.sentences(spark, sf).select("src")
    return ev.missing_parts(report_parts(spark, sf), scanned).select("src")


@query("rounded_events", f"WITH {T.TL} SELECT line_no, round(t_start, 1) AS t_start, round(t_end, 1) AS t_end FROM tl")
def rounded_events(spark, sf):
    return ev.rounded(T.timeline(spark, sf)).select("line_no", "t_start", "t_end")


@query("pool_dropped", """SELECT 'd' || user_id || '_full' AS part_dir, count(*) FILTER (event_id % 5 = 0) AS dropped, count(*) FILTER (event_id % 5 <> 0) AS kept
FROM events WHERE user_id % 2 = 0 GROUP BY 1""")
def pool_dropped(spark, sf):
    u = F.col("user_id").cast("string")
    e = T.table(spark, sf, "events").select(
        F.concat(F.lit("d"), u, F.when(F.col("user_id") % 2 == 0, "_full").otherwise("")).alias("part_dir"),
        F.when(F.col("event_id") % 5 == 0, "/srv/t1/../t2/x").otherwise(F.concat(F.lit("/srv/t1/v"), u)).alias("src"),
    )
    return ev.dropped_counts(ev.pool(e, "/srv/t1"))


def transcript_files(spark, sf):
    s = T.sentences(spark, sf)
    items = F.array_sort(F.collect_list(F.struct("id", "start", "end", "text"))).alias("sentences")
    docs = s.groupBy("src").agg(items)
    value = F.when(F.expr("cast(substring(src, 2) as int) % 2 = 0"), F.to_json(F.struct(F.col("src").alias("game"), "sentences"))).otherwise(F.to_json("sentences"))
    return docs.select(F.concat(F.lit("/asr/"), "src", F.lit("/transcript.json")).alias("path"), value.alias("value"))


@query("transcript_rows", f"""WITH {T.SE} SELECT src AS asr_dir, CASE WHEN CAST(substring(src, 2) AS INT) % 2 = 0 THEN src END AS game, id, start, md5(text) AS h FROM se""")
def transcript_rows(spark, sf):
    t = media.parse_transcripts(transcript_files(spark, sf))
    return t.select("asr_dir", "game", F.col("id").cast("long").alias("id"), "start", F.md5("text").alias("h"))


@query("preferred_transcript", f"""WITH {T.SE} SELECT src, id FROM se WHERE (CAST(substring(src, 2) AS INT) % 2 = 0 AND coalesce(speaker, 'host') = 'host') OR CAST(substring(src, 2) AS INT) % 2 = 1""")
def preferred_transcript(spark, sf):
    s = T.sentences(spark, sf)
    lab = s.where(F.expr("cast(substring(src, 2) as int) % 2 = 0"))
    return transcripts.prefer_labelled(s.drop("speaker"), lab).select("src", F.col("id").cast("long").alias("id"))


def label_files(spark, sf):
    """Verdicts per clip file as one JSON map per session."""

    k = knocks(spark, sf)
    n = F.col("seq")
    body = F.to_json(F.map_from_entries(F.collect_list(F.struct(
        "file",
        F.struct((n % 3 == 0).alias("picked"), F.when(n % 5 == 0, "false_positive").otherwise("up").alias("verdict"),
                 F.when(n % 2 == 0, (n % 11).cast("double")).alias("score_override")),
    ))))
    return k.groupBy("session").agg(body.alias("value"))


@query("label_tally", f"""WITH {KNOCKS}
SELECT session, count(*) AS clips, count(*) FILTER (seq % 5 <> 0) AS up, CAST(0 AS BIGINT) AS down FROM kc GROUP BY 1""")
def label_tally(spark, sf):

    return media.label_tally(knocks(spark, sf), media.parse_labels(label_files(spark, sf)))


@query("clip_documents", f"""WITH {KNOCKS} SELECT session, count(*) AS n, arg_min(label, seq) AS first_label FROM kc GROUP BY 1""")
def clip_documents(spark, sf):

    d = media.clip_index(knocks(spark, sf), "seq")
    return d.select("session", F.size("clips").cast("long").alias("n"), F.get("clips", F.lit(0)).getField("label").alias("first_label"))


@query("pickup_documents")
def pickup_documents(spark, sf):
    from cuespan.session import cut_lineage

    m = cut_lineage(build(spark, sf))
    rows = cut_lineage(pickups(spark, sf, m))
    p = T.parts(spark, sf)
    return media.pickup_document(clips.pickup_index(rows, p), rows, m, p)


@query("queue_index_merge", f"""WITH {T.TL} SELECT 'P' || user_id || '#' || CAST(trunc(t_start) AS BIGINT) AS key, max(CASE WHEN user_id % 2 = 0 THEN 'old' ELSE 'new' END) AS origin
FROM tl WHERE kind = 'match_start' GROUP BY 1""")
def queue_index_merge(spark, sf):
    m = T.timeline(spark, sf).where(F.col("kind") == "match_start").select(
        F.lit("s").alias("session"), F.concat(F.lit("P"), F.expr("substring(src, 2)"), F.lit("#"), F.floor("t_start").cast("string")).alias("key"),
        F.expr("cast(substring(src, 2) as int) % 2").alias("odd"),
    ).distinct()
    old = m.where("odd = 0").select("session", "key", F.lit("x.jpg").alias("file"), F.lit(None).cast("string").alias("skip"), F.lit("old").alias("origin"))
    new = m.select("session", "key", F.lit("y.jpg").alias("file"), F.lit(None).cast("string").alias("skip"), F.lit("new").alias("origin"))
    return clips.merge_queue_index(old, new).select("key", "origin")


@query("video_order", f"""WITH {T.FILES} SELECT path, row_number() OVER (PARTITION BY regexp_extract(path, '^(.*)/[^/]*$', 1)
  ORDER BY length(regexp_extract(path, '([^/]*)[.][^.]*$', 1)), regexp_extract(path, '([^/]*)$', 1)) AS part_seq FROM fl WHERE is_video""")
def video_order(spark, sf):
    return media.video_order(T.files(spark, sf).select("path")).select("path", "part_seq")


@query("edl_documents", f"""WITH {T.TL} SELECT session, count(*) FILTER (kind = 'down') AS n_down, count(*) FILTER (kind = 'extract' AND ok) AS n_extract_ok, count(*) AS n_events FROM tl
WHERE session IN (SELECT session FROM tl WHERE kind = 'down') GROUP BY 1""")
def edl_documents(spark, sf):
    pool = T.timeline(spark, sf)
    segs = edl.category_mix(pool, T.sentences(spark, sf))
    d = media.edl_document(segs, edl.pool_stats(pool), "category_mix", F.lit("1080x1920"))
    return d.select("session", "pool_stats.*")


