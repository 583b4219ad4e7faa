"""Access statistics, progress, outcomes, streaming twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuespan.plans import fleet
from cuespan.registry import tables as T
from cuespan.registry.book import query
from cuespan.streaming import jobs


def parsed(spark, sf):
    return fleet.parse_access(T.access_lines(spark, sf))


def hits(spark, sf):
    return fleet.client_hits(parsed(spark, sf))


@query("access_line_counts", """SELECT count(*) FILTER (event_id % 50 <> 0 AND event_id % 7 <> 0) AS total, count(*) FILTER (event_id % 50 = 0) AS bad FROM events""")
def access_line_counts(spark, sf):
    return fleet.line_counts(parsed(spark, sf))


@query("access_daily", f"WITH {T.HITS} SELECT CAST(day AS VARCHAR) AS day, count(DISTINCT ip) AS active FROM hits GROUP BY 1")
def access_daily(spark, sf):
    return fleet.daily_actives(hits(spark, sf)).withColumn("day", F.col("day").cast("string"))


@query("access_last_days", f"WITH {T.HITS} SELECT CAST(day AS VARCHAR) AS day, count(DISTINCT ip) AS active FROM hits GROUP BY 1 ORDER BY day DESC LIMIT 7")
def access_last_days(spark, sf):
    return fleet.last_days(fleet.daily_actives(hits(spark, sf)), 7).withColumn("day", F.col("day").cast("string"))


@query("access_builds", f"WITH {T.HITS} SELECT build, count(DISTINCT ip) AS active FROM hits WHERE day IN (SELECT DISTINCT day FROM hits ORDER BY day DESC LIMIT 7) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def access_builds(spark, sf):
    return fleet.build_actives(hits(spark, sf), days=7)


@query("access_platforms", f"WITH {T.HITS} SELECT os, count(DISTINCT ip) AS active FROM hits WHERE os IS NOT NULL GROUP BY 1")
def access_platforms(spark, sf):
    return fleet.platform_actives(hits(spark, sf))


@query("access_installs", f"""WITH {T.HITS} SELECT CASE WHEN grouping(day, build) = 3 THEN 'total' WHEN grouping(day, build) = 1 THEN 'day' ELSE 'build' END AS scope,
  CAST(day AS VARCHAR) AS day, build, count(DISTINCT install) AS installs FROM hits WHERE install IS NOT NULL GROUP BY GROUPING SETS ((), (day), (build))""")
def access_installs(spark, sf):
    return fleet.installs(hits(spark, sf)).withColumn("day", F.col("day").cast("string"))


@query("user_daily", "SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(DISTINCT user_id) AS active FROM events GROUP BY 1, 2")
def user_daily(spark, sf):
    e = T.table(spark, sf, "events").select("event_type", F.to_date("ts").alias("day"), "user_id")
    return e.groupBy("event_type", F.col("day").cast("string").alias("day")).agg(F.count_distinct("user_id").alias("active"))


def progress_lines(spark, sf):
    """Events as pipeline log lines of a session per user."""
    k = F.get_json_object("props", "$.k").cast("int")
    stage = F.element_at(F.array(*[F.lit(s) for s in ["asr", "speaker", "detect", "knockdowns", "pickups"]]), (k % 5 + 1).cast("int"))
    line = (
        F.when(F.col("event_type") == "signup", F.concat(F.lit("[pipeline] "), stage, F.lit(" 开始 ...")))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("[pipeline] "), stage, F.lit(" 完成 (3s)")))
        .when(F.col("event_type") == "error", F.concat(F.lit("[pipeline] -- 跳过 "), stage))
        .when(F.col("event_type") == "view", F.concat(F.lit("  part"), (k % 9).cast("string"), F.lit(".mp4：检测完成 -> x")))
        .otherwise(F.lit("[pipeline] 场次：s，8 个分片"))
    )
    return T.table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("session"), F.col("ts").cast("timestamp").alias("ts"), line.alias("line")
    )


@query("stage_progress", """WITH m AS (
  SELECT user_id AS session, ts, event_type AS e, ['asr', 'speaker', 'detect', 'knockdowns', 'pickups'][k % 5 + 1] AS stage, k % 9 AS shard
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)),
s AS (SELECT session, stage, arg_max(e, ts) AS state FROM m WHERE e IN ('signup', 'purchase', 'error') GROUP BY 1, 2),
w AS (SELECT session, sum(CASE WHEN state <> 'signup' THEN CASE stage WHEN 'asr' THEN 0.03 WHEN 'speaker' THEN 0.01 WHEN 'detect' THEN 0.75 WHEN 'knockdowns' THEN 0.10 ELSE 0.06 END ELSE 0 END) AS base FROM s GROUP BY 1),
c AS (SELECT session, count(DISTINCT shard) FILTER (e = 'view') AS det, count(*) FILTER (e = 'click') > 0 AS parts,
  arg_max(e, ts) FILTER (e IN ('signup', 'purchase')) AS le, arg_max(stage, ts) FILTER (e IN ('signup', 'purchase')) AS ls FROM m GROUP BY 1)
SELECT CAST(c.session AS VARCHAR) AS session, CASE WHEN le = 'signup' THEN ls END AS cur, round(least(0.99, coalesce(base, 0) + CASE WHEN le <> 'signup' OR le IS NULL THEN 0
  WHEN ls = 'detect' AND parts THEN 0.75 * least(1, det / 8) WHEN ls = 'knockdowns' AND parts THEN 0
  ELSE CASE ls WHEN 'asr' THEN 0.03 WHEN 'speaker' THEN 0.01 WHEN 'detect' THEN 0.75 WHEN 'knockdowns' THEN 0.10 ELSE 0.06 END / 2 END), 6) AS frac
FROM c LEFT JOIN w ON w.session = c.session""")
def stage_progress(spark, sf):
    p = fleet.progress(fleet.parse_progress(progress_lines(spark, sf)))
    return p.select("session", "cur", F.round("frac", 6).alias("frac"))


@query("stage_progress_by_duration", """WITH m AS (
  SELECT user_id AS session, ts, event_type AS e, ['asr', 'speaker', 'detect', 'knockdowns', 'pickups'][k % 5 + 1] AS stage, k % 5 AS pos, k % 9 AS shard
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)),
s AS (SELECT session, stage, pos, arg_max(e, ts) AS state FROM m WHERE e IN ('signup', 'purchase', 'error') GROUP BY 1, 2, 3),
w AS (SELECT session, arg_min(stage, pos) FILTER (state = 'signup') AS cur,
  sum(CASE WHEN state <> 'signup' THEN CASE stage WHEN 'asr' THEN 0.03 WHEN 'speaker' THEN 0.01 WHEN 'detect' THEN 0.75 WHEN 'knockdowns' THEN 0.10 ELSE 0.06 END ELSE 0 END) AS base FROM s GROUP BY 1),
c AS (SELECT session, count(*) FILTER (e = 'view') > 0 AS det, count(*) FILTER (e NOT IN ('view', 'signup', 'purchase', 'error')) > 0 AS parts,
  (epoch_us(max(ts)) - epoch_us(min(ts))) / CAST(1000000 AS DOUBLE) AS spent FROM m GROUP BY 1),
f AS (SELECT c.session, cur, spent, CAST(least(0.99, coalesce(base, 0) + CASE WHEN parts THEN 0.02 ELSE 0 END + CASE cur
    WHEN 'detect' THEN CASE WHEN det THEN 0.75 ELSE 0 END WHEN 'knockdowns' THEN CASE WHEN parts THEN 0 ELSE 0.05 END
    WHEN 'asr' THEN 0.015 WHEN 'speaker' THEN 0.005 WHEN 'pickups' THEN 0.03 ELSE 0 END) AS DOUBLE) AS frac
  FROM c LEFT JOIN w ON w.session = c.session)
SELECT CAST(session AS VARCHAR) AS session, cur, round(frac, 6) AS frac, round(CASE WHEN frac >= 0.03 THEN spent * (1 - frac) / frac END, 2) AS eta_sec FROM f""")
def stage_progress_by_duration(spark, sf):
    marks = fleet.parse_progress(progress_lines(spark, sf))
    d = marks.where(F.col("mark") == "detected").select("session", F.col("shard").alias("filename")).distinct()
    d = d.withColumn("duration_s", F.length("filename") * 60.0)
    p = fleet.progress(marks, d, by_duration=True)
    return p.select("session", "cur", F.round("frac", 6).alias("frac"), F.round("eta_sec", 2).alias("eta_sec"))


@query("job_outcomes", """WITH h AS (SELECT user_id, event_type, epoch_us(ts) / 1e6 AS tt, min(epoch_us(ts)) OVER (PARTITION BY user_id) / 1e6 AS t0 FROM events)
SELECT user_id AS upload_id, coalesce(arg_min(CASE event_type WHEN 'purchase' THEN 'done' ELSE 'failed' END, tt) FILTER (event_type IN ('purchase', 'error') AND tt <= t0 + 36000), 'timeout') AS outcome
FROM h GROUP BY 1""")
def job_outcomes(spark, sf):
    at = T.micros() / 1e6
    e = T.table(spark, sf, "events").select(
        F.col("user_id").alias("upload_id"), at.alias("at"),
        F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "failed").otherwise("running").alias("state"),
    )
    start = e.groupBy("upload_id").agg(F.min("at").alias("asked_at"))
    return fleet.outcome(e.join(start, "upload_id"), 36000.0).select("upload_id", "outcome")


@query("log_tail", """WITH l AS (SELECT doc_id, i, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
b AS (SELECT *, sum(octet_length(encode(line)) + 1) OVER (PARTITION BY doc_id ORDER BY i DESC ROWS UNBOUNDED PRECEDING) AS tail, sum(octet_length(encode(line)) + 1) OVER (PARTITION BY doc_id) AS total FROM l)
SELECT doc_id, count(*) AS n, CAST(min(i) AS BIGINT) AS first_line FROM b WHERE total <= 1000 OR tail < 1000 GROUP BY 1""")
def log_tail(spark, sf):
    lines = T.table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    t = fleet.log_tail(lines, ["doc_id"], "pos", 1000)
    return t.groupBy("doc_id").agg(F.count("*").alias("n"), (F.min("pos") + 1).cast("long").alias("first_line"))


@query("stalls", """WITH g AS (SELECT user_id AS src, epoch_us(ts) / 1e6 AS t, CAST(floor(value / 60) AS BIGINT) AS size FROM events),
c AS (SELECT *, size IS DISTINCT FROM lag(size) OVER (PARTITION BY src ORDER BY t) AS ch FROM g),
l AS (SELECT *, last_value(CASE WHEN ch THEN t END IGNORE NULLS) OVER (PARTITION BY src ORDER BY t ROWS UNBOUNDED PRECEDING) AS grew FROM c)
SELECT src, round(grew, 3) AS grew, round(min(t), 3) AS stalled_at FROM l WHERE NOT ch AND t - grew > 7200 GROUP BY src, grew""")
def stalls(spark, sf):
    e = T.table(spark, sf, "events").select(
        F.col("user_id").alias("src"), F.col("ts").cast("timestamp").alias("ts"), F.floor(F.col("value") / 60).alias("size")
    )
    s = jobs.stalls(e, 7200.0, width=6 * 86400.0)
    return s.select("src", F.round("grew", 3).alias("grew"), F.round("stalled_at", 3).alias("stalled_at"))


@query("rotation_segments", """SELECT user_id AS src, CAST(floor((epoch_us(ts) / 1e6 - min(epoch_us(ts)) OVER (PARTITION BY user_id) / 1e6) / 86400) AS BIGINT) AS segment, event_id FROM events""")
def rotation_segments(spark, sf):
    e = T.table(spark, sf, "events").select(F.col("user_id").alias("src"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    return jobs.rotations(e, 86400.0).select("src", "segment", "event_id")


@query("presence_runs", """WITH p AS (SELECT user_id AS host, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i, epoch_us(ts) / 1e6 AS t, event_type IN ('click', 'view') AS hit FROM events),
h AS (SELECT *, max(CASE WHEN hit THEN i END) OVER (PARTITION BY host ORDER BY i ROWS UNBOUNDED PRECEDING) AS last_hit FROM p),
o AS (SELECT *, i - last_hit < 3 AS on_air FROM h WHERE last_hit IS NOT NULL),
r AS (SELECT *, sum(CASE WHEN lag_i IS NULL OR i - lag_i > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY host ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM (
  SELECT *, lag(i) OVER (PARTITION BY host ORDER BY i) AS lag_i FROM o WHERE on_air))
SELECT r.host, CAST(r.run AS BIGINT) AS run, round(min(r.t), 3) AS started_at, round(max(s.t), 3) AS stopped_at FROM r
LEFT JOIN (SELECT host, i, t FROM h WHERE i - last_hit = 3) s ON s.host = r.host AND s.i = r.i + 1
  AND r.i = (SELECT max(q.i) FROM r q WHERE q.host = r.host AND q.run = r.run) GROUP BY 1, 2""")
def presence_runs(spark, sf):
    e = T.table(spark, sf, "events").select(
        F.col("user_id").alias("host"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").isin("click", "view").alias("hit")
    )
    r = jobs.presence_runs(e, 3, width=6 * 86400.0)
    return r.select("host", "run", F.round("started_at", 3).alias("started_at"), F.round("stopped_at", 3).alias("stopped_at"))


@query("session_windows", """WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 43200000000 THEN 0 ELSE 1 END AS o, event_id FROM events),
n AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, count(*) AS n, CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS BIGINT) AS span_us FROM n GROUP BY user_id, s""")
def session_windows(spark, sf):
    """The streaming session query run over a finished table."""
    e = T.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = jobs.streaming_gap_sessions(e, ["user_id"], "ts", "12 hours", "1 day")
    return s.select("user_id", "n", (F.unix_micros("last_ts") - F.unix_micros("first_ts")).alias("span_us"))


@query("daily_actives_approx", """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(DISTINCT user_id) AS exact, true AS near FROM events GROUP BY 1""")
def daily_actives_approx(spark, sf):
    """The streaming daily count over a finished table: whether it is within 5 % of the exact one."""
    e = T.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    exact = e.groupBy(F.to_date("ts").alias("day")).agg(F.count_distinct("user_id").alias("exact"))
    got = jobs.streaming_daily_actives(e, "ts", "user_id").select(F.to_date("day").alias("day"), "active")
    near = F.abs(F.col("active") - F.col("exact")) <= F.greatest(F.lit(1.0), F.col("exact") * 0.05)
    return exact.join(got, "day").select(F.col("day").cast("string").alias("day"), "exact", near.alias("near"))
