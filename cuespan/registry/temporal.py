"""Ordered primitives: gap groups, as-of, nearest, interval and rank queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuespan.operators.distribution import percentiles, strict_rank
from cuespan.operators.intervals import count_in_spans, stab
from cuespan.operators.ordered import asof, gap_groups, has_within, lane, nearest, scan
from cuespan.plans.detect import confirmed_increases
from cuespan.plans.speakers import forward_fill
from cuespan.plans.voice import above_percentile
from cuespan.registry import tables as T
from cuespan.registry.book import query

PART = ("session", "src")
W = 120.0


def kind(spark, sf, name):
    return T.timeline(spark, sf).where(F.col("kind") == name)


def _gap_sql(where: str, key: str, gap: float) -> str:
    return f"""WITH {T.TL}, g AS (
      SELECT *, CASE WHEN t_start - lag(t_start) OVER (PARTITION BY {key} ORDER BY t_start, line_no) <= {gap}
        THEN 0 ELSE 1 END AS o FROM tl WHERE {where}),
    n AS (SELECT *, sum(o) OVER (PARTITION BY {key} ORDER BY t_start, line_no ROWS UNBOUNDED PRECEDING) AS grp FROM g)
    SELECT {key}, CAST(grp AS BIGINT) AS grp, min(t_start) AS first_t, max(t_start) AS last_t, count(*) AS n
    FROM n GROUP BY {key}, grp"""


def _grouped(df, key, gap):
    g = gap_groups(df, lane(key, ("t_start", "line_no"), W), gap, "grp")
    return g.groupBy(*key, "grp").agg(
        F.min("t_start").alias("first_t"), F.max("t_start").alias("last_t"), F.count("*").alias("n")
    )


@query("gap_sessions_user", _gap_sql("TRUE", "session, src", 12.0))
def gap_sessions_user(spark, sf):
    return _grouped(T.timeline(spark, sf), PART, 12.0)


@query("gap_sessions_kind", _gap_sql("TRUE", "session, src, kind", 25.0))
def gap_sessions_kind(spark, sf):
    return _grouped(T.timeline(spark, sf), (*PART, "kind"), 25.0)


@query("gap_down_merge", _gap_sql("kind = 'down'", "session, src", 12.0))
def gap_down_merge(spark, sf):
    return _grouped(kind(spark, sf, "down"), PART, 12.0)


@query("gap_loot_clusters", _gap_sql("kind = 'loot'", "session, src", 25.0))
def gap_loot_clusters(spark, sf):
    return _grouped(kind(spark, sf, "loot"), PART, 25.0)


@query("gap_all_by_type", """WITH e AS (
  SELECT event_type, epoch_us(ts) AS u, event_id FROM events), g AS (
  SELECT *, CASE WHEN u - lag(u) OVER (PARTITION BY event_type ORDER BY u, event_id) <= 3600000000 THEN 0 ELSE 1 END AS o FROM e),
n AS (SELECT *, sum(o) OVER (PARTITION BY event_type ORDER BY u, event_id ROWS UNBOUNDED PRECEDING) AS grp FROM g)
SELECT event_type, CAST(grp AS BIGINT) AS grp, count(*) AS n, max(u) - min(u) AS span_us FROM n GROUP BY 1, 2""")
def gap_all_by_type(spark, sf):
    """Five keys over the whole table: the case where one key holds a large share of the rows."""
    e = T.table(spark, sf, "events").select("event_type", T.micros().alias("u"), "event_id")
    g = gap_groups(e, lane("event_type", ("u", "event_id"), 6 * 3600e6), 3600e6, "grp")
    return g.groupBy("event_type", "grp").agg(
        F.count("*").alias("n"), (F.max("u") - F.min("u")).alias("span_us")
    )


@query("islands_in_clusters", f"""WITH {T.TL}, g AS (
  SELECT *, CASE WHEN t_start - lag(t_start) OVER (PARTITION BY session, src ORDER BY t_start, line_no) <= 60 THEN 0 ELSE 1 END AS o
  FROM tl WHERE kind = 'loot'),
c AS (SELECT *, sum(o) OVER (PARTITION BY session, src ORDER BY t_start, line_no ROWS UNBOUNDED PRECEDING) AS cluster FROM g),
h AS (SELECT *, CASE WHEN t_start - lag(t_start) OVER (PARTITION BY session, src, cluster ORDER BY t_start, line_no) <= 30 THEN 0 ELSE 1 END AS p FROM c),
i AS (SELECT *, sum(p) OVER (PARTITION BY session, src, cluster ORDER BY t_start, line_no ROWS UNBOUNDED PRECEDING) AS island FROM h)
SELECT session, src, CAST(cluster AS BIGINT) AS cluster, CAST(island AS BIGINT) AS island, count(*) AS n, min(t_start) AS first_t
FROM i GROUP BY 1, 2, 3, 4""")
def islands_in_clusters(spark, sf):
    from cuespan.plans.clips import loot_islands

    return loot_islands(T.timeline(spark, sf), merge_sec=60.0, width=W).groupBy(
        *PART, "cluster", "island"
    ).agg(F.count("*").alias("n"), F.min("t_start").alias("first_t"))


@query("interval_match_events", f"""WITH {T.TL}, s AS (SELECT session, src, t_start FROM tl WHERE kind = 'match_start')
SELECT e.line_no, (SELECT count(*) FROM s WHERE s.src = e.src AND s.t_start <= e.t_start) AS no
FROM tl e WHERE e.kind IN ('down', 'loot')
  AND EXISTS (SELECT 1 FROM s WHERE s.src = e.src AND s.t_start <= e.t_start)""")
def interval_match_events(spark, sf):
    e = T.timeline(spark, sf)
    marks = e.where(F.col("kind") == "match_start")
    acts = e.where(F.col("kind").isin("down", "loot"))
    return count_in_spans(marks, acts, PART, "t_start", "t_start", W).select("line_no", "no")


@query("first_extract_per_match", f"""WITH {T.TL}, s AS (
  SELECT session, src, t_start AS enter, lead(t_start) OVER (PARTITION BY src ORDER BY t_start, line_no) AS nxt, line_no
  FROM tl WHERE kind = 'match_start')
SELECT s.line_no, min(x.t_end) AS end_t FROM s JOIN tl x ON x.src = s.src AND x.kind = 'extract'
  AND x.t_end >= s.enter AND (s.nxt IS NULL OR x.t_end < s.nxt) GROUP BY 1""")
def first_extract_per_match(spark, sf):
    """First settlement between a match start and the next one, through one look-ahead."""
    e = T.timeline(spark, sf)
    s = scan(
        e.where(F.col("kind") == "match_start").select(*PART, "t_start", "line_no"),
        lane(PART, ("t_start", "line_no"), W), following={"nxt": F.col("t_start")},
    )
    x = e.where(F.col("kind") == "extract").select(*PART, F.col("t_end").alias("end_t"))
    out = asof(s, x, PART, "t_start", "end_t", [], W, forward=True)
    end_t = F.col("hit.end_t")
    return out.where(end_t.isNotNull() & (F.col("nxt").isNull() | (end_t < F.col("nxt")))).select(
        "line_no", end_t.alias("end_t")
    )


@query("asof_match_of_loot", f"""WITH {T.TL} SELECT l.line_no, m.line_no AS match_line
FROM (SELECT * FROM tl WHERE kind = 'loot') l ASOF LEFT JOIN (
  SELECT src, t_start, max(line_no) AS line_no FROM tl WHERE kind = 'match_start' GROUP BY 1, 2) m
ON l.src = m.src AND l.t_start >= m.t_start""")
def asof_match_of_loot(spark, sf):
    out = asof(
        kind(spark, sf, "loot").select(*PART, "t_start", "line_no"),
        kind(spark, sf, "match_start").select(*PART, F.col("t_start").alias("m_t"), F.col("line_no").alias("m_line")),
        PART, "t_start", "m_t", ["m_line"], W, tie="m_line",
    )
    return out.select("line_no", F.col("hit.m_line").alias("match_line"))


@query("asof_near_down", f"""WITH {T.TL}, d AS (SELECT src, t_start FROM tl WHERE kind = 'down')
SELECT l.line_no, CASE WHEN l.t_start - d.t_start <= 25 THEN round(l.t_start - d.t_start, 1) END AS near_down
FROM (SELECT * FROM tl WHERE kind = 'loot') l ASOF LEFT JOIN d ON l.src = d.src AND l.t_start >= d.t_start""")
def asof_near_down(spark, sf):
    out = asof(
        kind(spark, sf, "loot").select(*PART, "t_start", "line_no"),
        kind(spark, sf, "down").select(*PART, F.col("t_start").alias("d_t")), PART, "t_start", "d_t", [], W,
    )
    dt = F.col("t_start") - F.col("hit.d_t")
    return out.select("line_no", F.when(dt <= 25, F.round(dt, 1)).alias("near_down"))


@query("nearest_dance", f"""WITH {T.TL}, p AS (
  SELECT l.line_no, d.line_no AS hit_line, abs(l.t_start - d.t_start) AS dist,
    row_number() OVER (PARTITION BY l.line_no ORDER BY abs(l.t_start - d.t_start), d.t_start, d.line_no) AS rn
  FROM tl l JOIN tl d ON l.src = d.src AND d.kind = 'dance' AND abs(l.t_start - d.t_start) <= 2.5 WHERE l.kind = 'loot')
SELECT l.line_no, p.hit_line FROM tl l LEFT JOIN p ON p.line_no = l.line_no AND p.rn = 1 WHERE l.kind = 'loot'""")
def nearest_dance(spark, sf):
    out = nearest(
        kind(spark, sf, "loot").select(*PART, "t_start", "line_no"),
        kind(spark, sf, "dance").select(*PART, F.col("t_start").alias("d_t"), F.col("line_no").alias("d_line")),
        PART, "t_start", "d_t", ["d_line"], W, tolerance=2.5, tie="d_line",
    )
    return out.select("line_no", F.col("hit.d_line").alias("hit_line"))


_WITHIN = f"""WITH {T.TL} SELECT s.line_no FROM tl s WHERE s.kind = 'loot' AND {{no}} EXISTS (
  SELECT 1 FROM tl e WHERE e.kind = 'down' AND e.src = s.src AND e.t_start BETWEEN s.t_start - 2 AND s.t_end + 1)"""


def _loot_near_down(spark, sf):
    rows = kind(spark, sf, "loot").select(
        *PART, "line_no", (F.col("t_start") - 2).alias("lo"), (F.col("t_end") + 1).alias("hi")
    )
    return has_within(rows, kind(spark, sf, "down"), PART, "lo", "hi", "t_start", W)


@query("interval_semi", _WITHIN.format(no=""))
def interval_semi(spark, sf):
    return _loot_near_down(spark, sf).where("has").select("line_no")


@query("interval_anti", _WITHIN.format(no="NOT"))
def interval_anti(spark, sf):
    return _loot_near_down(spark, sf).where("not has").select("line_no")


@query("false_positive_anti", f"""WITH {T.TL}, f AS (SELECT src, t_start FROM tl WHERE kind = 'dance' AND k % 3 = 0)
SELECT e.line_no FROM tl e WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.src = e.src AND f.t_start BETWEEN e.t_start - 5 AND e.t_start + 5)""")
def false_positive_anti(spark, sf):
    from cuespan.plans.edl import drop_false

    e = T.timeline(spark, sf)
    fps = e.where((F.col("kind") == "dance") & (F.col("k") % 3 == 0)).select(*PART, F.col("t_start").alias("fp_t"))
    return drop_false(e.select(*PART, "line_no", "t_start"), fps, width=W).select("line_no")


@query("sentence_at_event", f"""WITH {T.TL}, {T.SE}, p AS (
  SELECT e.line_no, s.id, row_number() OVER (PARTITION BY e.line_no ORDER BY s.start, s.id) AS rn
  FROM tl e JOIN se s ON s.src = e.src AND s.start <= e.t_start AND e.t_start < s."end")
SELECT line_no, id FROM p WHERE rn = 1""")
def sentence_at_event(spark, sf):
    e = T.timeline(spark, sf).select(*PART, "line_no", "t_start")
    s = T.sentences(spark, sf).select(*PART, "id", "start", "end")
    hits = stab(e, s, PART, "t_start", "start", "end", 15.0, open_hi=True)
    return hits.groupBy("line_no").agg(F.min_by("id", F.struct("start", "id")).cast("long").alias("id"))


@query("interval_overlap_top3", f"""WITH {T.TL}, {T.SE}, p AS (
  SELECT e.line_no, s.id, row_number() OVER (PARTITION BY e.line_no ORDER BY s.id) AS rn
  FROM tl e JOIN se s ON s.src = e.src AND (e.t_start + e.t_end) / 2 BETWEEN s.start - 10 AND s."end" + 10
  WHERE e.kind = 'loot')
SELECT line_no, id FROM p WHERE rn <= 3""")
def interval_overlap_top3(spark, sf):
    from cuespan.operators.intervals import first_k

    e = kind(spark, sf, "loot").select(*PART, "line_no", ((F.col("t_start") + F.col("t_end")) / 2).alias("mid"))
    s = T.sentences(spark, sf).select(*PART, F.col("id").cast("long").alias("id"), (F.col("start") - 10).alias("lo"), (F.col("end") + 10).alias("hi"))
    return first_k(stab(e, s, PART, "mid", "lo", "hi", 30.0), ["line_no"], ["id"], 3).select("line_no", "id")


@query("reverse_first_hit", f"""WITH {T.TL}, s AS (
  SELECT src, line_no, t_start AS tm, lag(t_start) OVER (PARTITION BY src ORDER BY t_start, line_no) AS before FROM tl WHERE kind = 'match_start'),
f AS (SELECT *, least(CASE WHEN before IS NULL THEN 0 ELSE greatest(CAST(floor(before) AS BIGINT) + 6, CAST(floor(tm) AS BIGINT) - 30) END,
  CAST(floor(tm) AS BIGINT) - 1) AS flo FROM s)
SELECT f.line_no, max(e.t_start) AS hit_t FROM f LEFT JOIN tl e ON e.src = f.src AND e.kind = 'dance'
  AND e.t_start <= floor(f.tm) - 1 AND e.t_start >= f.flo GROUP BY 1""")
def reverse_first_hit(spark, sf):
    """Latest hit before an anchor, back to a floor set by the anchor before."""
    s = kind(spark, sf, "match_start").select(*PART, "line_no", F.col("t_start").alias("tm"))
    s = scan(s, lane(PART, ("tm", "line_no"), W), prev={"before": F.col("tm")})
    whole = F.floor("tm")
    floor = F.when(F.col("before").isNull(), F.lit(0).cast("long")).otherwise(
        F.greatest(F.floor("before") + 6, whole - 30)
    )
    s = s.withColumn("flo", F.least(floor, whole - 1)).withColumn("upto", (whole - 1).cast("double"))
    hits = kind(spark, sf, "dance").select(*PART, F.col("t_start").alias("h_t"))
    out = asof(s, hits, PART, "upto", "h_t", [], W)
    h = F.col("hit.h_t")
    return out.select("line_no", F.when(h >= F.col("flo"), h).alias("hit_t"))


@query("span_numbers", f"""WITH {T.TL} SELECT e.line_no, nullif((SELECT count(*) FROM tl s WHERE s.kind = 'match_start' AND s.src = e.src AND s.t_start <= e.t_start), 0) AS match_no
FROM tl e WHERE e.kind = 'down'""")
def span_numbers_q(spark, sf):
    from cuespan.plans.matches import span_numbers

    e = T.timeline(spark, sf)
    return span_numbers(e, e.where(F.col("kind") == "down").select(*PART, "line_no", "t_start"), "t_start", W).select(
        "line_no", "match_no"
    )


@query("next_prev_start", f"""WITH {T.TL} SELECT line_no, lag(t_start) OVER w AS before, lead(t_start) OVER w AS after
FROM tl WHERE kind = 'match_start' WINDOW w AS (PARTITION BY session, src ORDER BY t_start, line_no)""")
def next_prev_start(spark, sf):
    s = kind(spark, sf, "match_start").select(*PART, "line_no", "t_start")
    out = scan(s, lane(PART, ("t_start", "line_no"), W), prev={"before": F.col("t_start")}, following={"after": F.col("t_start")})
    return out.select("line_no", "before", "after")


@query("strict_rank_value", f"""WITH {T.TL} SELECT line_no, round((rank() OVER (PARTITION BY session ORDER BY confidence) - 1)
  / CAST(count(*) OVER (PARTITION BY session) AS DOUBLE), 6) AS rank01 FROM tl""")
def strict_rank_value(spark, sf):
    e = T.timeline(spark, sf).select("session", "line_no", "confidence")
    return strict_rank(e, ("session",), "confidence").select("line_no", F.round("rank01", 6).alias("rank01"))


@query("percentiles_session", f"""WITH {T.TL} SELECT session, round(quantile_cont(confidence, 0.4), 6) AS p40,
  round(quantile_cont(confidence, 0.5), 6) AS p50, round(quantile_cont(confidence, 0.85), 6) AS p85 FROM tl GROUP BY 1""")
def percentiles_session(spark, sf):
    e = T.timeline(spark, sf).select("session", "confidence")
    p = percentiles(e, ("session",), "confidence", {"p40": 0.4, "p50": 0.5, "p85": 0.85})
    return p.select("session", *[F.round(c, 6).alias(c) for c in ("p40", "p50", "p85")])


@query("percentiles_lineitem", """SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50,
  round(quantile_cont(l_extendedprice, 0.95), 6) AS p95 FROM lineitem GROUP BY 1""")
def percentiles_lineitem(spark, sf):
    p = percentiles(T.table(spark, sf, "lineitem"), ("l_returnflag",), "l_extendedprice", {"p50": 0.5, "p95": 0.95})
    return p.select("l_returnflag", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@query("above_p85", f"""WITH {T.TL}, q AS (SELECT session, quantile_cont(confidence, 0.85) AS bar FROM tl GROUP BY 1)
SELECT line_no FROM tl JOIN q USING (session) WHERE confidence >= bar""")
def above_p85(spark, sf):
    e = T.timeline(spark, sf).select("session", "line_no", "confidence")
    return above_percentile(e, ("session",), "confidence").select("line_no")


@query("confirmed_increases", f"""WITH {T.TL}, w AS (
  SELECT line_no, k, lag(k) OVER o AS prev, lead(k) OVER o AS next FROM tl WHERE kind = 'dance'
  WINDOW o AS (PARTITION BY session, src ORDER BY t_start, line_no))
SELECT line_no, prev, k AS cur FROM w WHERE k > prev AND next >= k""")
def confirmed_increases_q(spark, sf):
    e = kind(spark, sf, "dance").select(*PART, "t_start", "line_no", "k")
    return confirmed_increases(e, PART, ("t_start", "line_no"), "k", W).select("line_no", "prev", F.col("k").alias("cur"))


@query("forward_fill_role", """SELECT conv_id, turn, coalesce(last_value(CASE WHEN length(text) > 600 THEN role END IGNORE NULLS)
  OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'host') AS speaker FROM conversations""")
def forward_fill_role(spark, sf):
    c = T.table(spark, sf, "conversations").select(
        "conv_id", "turn", F.when(F.length("text") > 600, F.col("role")).alias("speaker")
    )
    return forward_fill(c, ("conv_id",), ("turn",), "speaker", "host", 4.0)


@query("running_counter", f"""WITH {T.TL} SELECT line_no, CAST(sum(k) OVER (PARTITION BY session ORDER BY t_start, line_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS counter FROM tl""")
def running_counter(spark, sf):
    e = T.timeline(spark, sf).select("session", "t_start", "line_no", "k")
    return scan(e, lane("session", ("t_start", "line_no"), W), running={"counter": F.col("k").cast("long")}).select("line_no", "counter")


@query("covered_bins", f"""WITH {T.SE} SELECT src, count(DISTINCT b) AS bins FROM (
  SELECT src, unnest(range(CAST(floor(start / 0.25) AS BIGINT), CAST(floor("end" / 0.25) AS BIGINT) + 1)) AS b FROM se
  WHERE coalesce(speaker, 'host') = 'host') GROUP BY 1""")
def covered_bins(spark, sf):
    from cuespan.plans.voice import host_bins, host_rows

    return host_bins(host_rows(T.sentences(spark, sf))).groupBy("src").agg(F.count("*").alias("bins"))
