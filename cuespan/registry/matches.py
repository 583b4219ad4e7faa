"""Clock bases, matches, reports, clips."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuespan.plans import clips, matches
from cuespan.registry import tables as T
from cuespan.registry.book import query
from cuespan.session import new_folder
from cuespan.sources import documents, media
from cuespan.sources import events as ev

W = 86400.0


@query("part_bases", f"""WITH RECURSIVE {T.BASES}
SELECT z.src, f.base, z.base AS zero_base FROM zfold z LEFT JOIN fold f ON f.src = z.src""")
def part_bases(spark, sf):
    b = matches.part_bases(T.parts(spark, sf))
    return b.select("src", "base", "zero_base")


MATCHES = f"""{T.TL}, {T.BASES}, ab AS (
  SELECT tl.*, f.base, f.base + tl.t_start AS abs_t FROM tl JOIN fold f ON f.src = tl.src),
st AS (
  SELECT session, src, t_start, k, abs_t AS enter, row_number() OVER w AS no, lead(abs_t) OVER w AS nxt
  FROM ab WHERE kind = 'match_start' WINDOW w AS (PARTITION BY session ORDER BY abs_t, src, line_no)),
ev AS (
  SELECT st.session, st.no, ab.kind, ab.t_start, ab.src FROM ab JOIN st ON st.session = ab.session
    AND ab.abs_t >= st.enter AND (st.nxt IS NULL OR ab.abs_t < st.nxt) WHERE ab.kind IN ('down', 'loot')),
cnt AS (SELECT session, no, count(*) FILTER (kind = 'down') AS downs, count(*) FILTER (kind = 'loot') AS loots,
  min(src) <> max(src) AS cross_part FROM ev GROUP BY 1, 2),
bg AS (
  SELECT session, no, t_start, CASE WHEN t_start - lag(t_start) OVER (PARTITION BY session, no ORDER BY t_start) <= 20 THEN 0 ELSE 1 END AS o
  FROM ev WHERE kind = 'down'),
bs AS (SELECT session, no, g, count(*) AS size FROM (
  SELECT *, sum(o) OVER (PARTITION BY session, no ORDER BY t_start ROWS UNBOUNDED PRECEDING) AS g FROM bg) GROUP BY 1, 2, 3 HAVING count(*) >= 2),
bu AS (SELECT session, no, count(*) AS multi, string_agg(CAST(size AS VARCHAR), '+' ORDER BY g) AS sizes FROM bs GROUP BY 1, 2),
ex AS (
  SELECT st.session, st.no, ab.base + ab.t_end AS abs_end, ab.ok, ab.k,
    row_number() OVER (PARTITION BY st.session, st.no ORDER BY ab.base + ab.t_end, ab.src, ab.t_start) AS rn
  FROM ab JOIN st ON st.session = ab.session AND ab.base + ab.t_end >= st.enter AND (st.nxt IS NULL OR ab.base + ab.t_end < st.nxt)
  WHERE ab.kind = 'extract'),
mt AS (
  SELECT st.session, st.no, st.src, st.enter, round(coalesce(ex.abs_end, st.nxt) - st.enter, 3) AS dur,
    coalesce(['红狼', '骇爪', '蜂医'][gk % 3 + 1], '') AS operator,
    coalesce(['M4A1', 'AKM', 'MP5', 'P90'][gk % 4 + 1], '') AS primary_weapon,
    coalesce(downs, 0) AS downs, coalesce(multi, 0) AS multi, coalesce(sizes, '') AS multi_sizes,
    CASE WHEN ex.ok THEN CASE WHEN ex.k % 5 = 0 THEN 3 ELSE ex.k % 12 END END AS kills_official,
    coalesce(loots, 0) AS loots, ex.ok,
    CASE WHEN ex.ok AND ex.k % 6 <> 0 THEN ex.k * 1000 + (ex.k * 7) % 1000 END AS profit,
    coalesce(cross_part, false) AS cross_part
  FROM st LEFT JOIN cnt USING (session, no) LEFT JOIN bu USING (session, no)
    LEFT JOIN (SELECT src, t_start, arg_max(k, line_no) AS gk FROM tl WHERE kind = 'match_start' AND k % 2 = 0 GROUP BY 1, 2) ge
      ON ge.src = st.src AND ge.t_start = st.t_start
    LEFT JOIN ex ON ex.session = st.session AND ex.no = st.no AND ex.rn = 1)"""


def build(spark, sf):
    bases = matches.part_bases(T.parts(spark, sf))
    return matches.build_matches(T.timeline(spark, sf, with_gear=True), bases, W)


@query("match_report", f"""WITH RECURSIVE {MATCHES} SELECT session, no, src, enter, dur, operator, primary_weapon, downs, multi,
  multi_sizes, kills_official, loots, ok, profit, cross_part FROM mt""")
def match_report(spark, sf):
    m = build(spark, sf)
    return m.select(
        "session", "no", "src", "enter", F.round("dur", 3).alias("dur"), "operator", "primary_weapon",
        "downs", "multi", F.array_join(F.transform("multi_sizes", lambda x: x.cast("string")), "+").alias("multi_sizes"),
        "kills_official", "loots", "ok", "profit", "cross_part",
    )


@query("match_totals", f"""WITH RECURSIVE {MATCHES} SELECT session, CAST(sum(downs) AS BIGINT) AS downs, CAST(sum(multi) AS BIGINT) AS multi,
  CAST(sum(loots) AS BIGINT) AS loots, count(*) FILTER (ok) AS ok, count(*) AS matches, CAST(sum(coalesce(profit, 0)) AS BIGINT) AS profit
FROM mt GROUP BY ROLLUP (session)""")
def match_totals(spark, sf):
    return matches.report_totals(build(spark, sf))


REPORT = f"""{MATCHES}, rl AS (
SELECT session, no AS line_no,
  '| ' || no || ' | ' || printf('%02d:%02d:%02d', (CAST(round_even(enter, 0) AS BIGINT) // 3600) % 24, CAST(round_even(enter, 0) AS BIGINT) % 3600 // 60, CAST(round_even(enter, 0) AS BIGINT) % 60)
  || ' | ' || CASE WHEN operator <> '' THEN operator || '(' || CASE operator WHEN '红狼' THEN '突击' WHEN '骇爪' THEN '侦察' ELSE '支援' END || ')' ELSE '-' END
  || ' | ' || CASE WHEN primary_weapon <> '' THEN primary_weapon ELSE '-' END
  || ' | ' || coalesce(printf('%d分%02d秒', CAST(round_even(dur, 0) AS BIGINT) // 60, CAST(round_even(dur, 0) AS BIGINT) % 60), '-')
  || ' | ' || downs || ' | ' || CASE WHEN multi > 0 THEN multi || '次(' || multi_sizes || ')' ELSE '0' END
  || ' | ' || coalesce(CAST(kills_official AS VARCHAR), '-') || ' | ' || loots
  || ' | ' || CASE WHEN ok THEN '✅' WHEN NOT ok THEN '❌' ELSE '-' END
  || ' | ' || CASE WHEN profit IS NOT NULL THEN format('{{:,}}', profit) WHEN NOT ok THEN '0（装备损失）' ELSE '-' END || ' |' AS line FROM mt
UNION ALL SELECT session, count(*) + 1, '| **合计** | | | | | **' || sum(downs) || '** | **' || sum(multi) || '次** | | **' || sum(loots) || '** | **'
  || count(*) FILTER (ok) || '/' || count(*) || '** | **' || format('{{:,}}', CAST(coalesce(sum(profit), 0) AS BIGINT)) || '** |' FROM mt GROUP BY 1),
hd AS (SELECT unnest(['{matches.REPORT_HEAD[0]}', '{matches.REPORT_HEAD[1]}']) AS line, unnest([-1, 0]) AS line_no)"""


def report_matches(spark, sf):
    return build(spark, sf).withColumn("dur", F.round("dur", 3)).withColumn("src", F.lit(""))


@query("match_report_lines", f"WITH RECURSIVE {REPORT} SELECT session, line_no, line FROM rl")
def match_report_lines(spark, sf):
    return matches.report_lines(report_matches(spark, sf))


@query("report_documents", f"""WITH RECURSIVE {REPORT}, al AS (SELECT * FROM rl UNION ALL SELECT DISTINCT rl.session, hd.line_no, hd.line FROM rl, hd)
SELECT session, string_agg(line, chr(10) ORDER BY line_no) || chr(10) AS markdown FROM al GROUP BY 1""")
def report_documents(spark, sf):
    return matches.report_document(report_matches(spark, sf))


@query("report_document_lines", f"""WITH RECURSIVE {REPORT} SELECT session, line_no + 1 AS pos, line FROM rl UNION ALL SELECT DISTINCT rl.session, hd.line_no + 1, hd.line FROM rl, hd""")
def report_document_lines(spark, sf):
    """The reports written as one file per session and read back line by line."""
    folder = new_folder(spark, "reports")
    documents.write(documents.text_lines(matches.REPORT_HEAD, matches.report_lines(report_matches(spark, sf)), "line_no"), folder)
    lines = ev.read_lines(spark, documents.files_of(folder))
    return lines.select(F.regexp_extract("part_dir", "=(.*)$", 1).alias("session"), "pos", "line")


@query("unclocked_events", f"""WITH RECURSIVE {T.TL}, {T.BASES} SELECT tl.session, tl.kind, count(*) AS n FROM tl LEFT JOIN fold f ON f.src = tl.src
WHERE f.base IS NULL GROUP BY 1, 2""")
def unclocked_events(spark, sf):
    return matches.unclocked(T.timeline(spark, sf), matches.part_bases(T.parts(spark, sf)))


@query("match_gear", f"""WITH RECURSIVE {MATCHES}, ge AS (
  SELECT ab.session, ab.src, ab.abs_t, ['红狼', '骇爪', '蜂医'][k % 3 + 1] AS hero,
    unnest([['M4A1', 'AKM', 'MP5', 'P90'][k % 4 + 1], ['AKM', 'M700'][(k + 1) % 2 + 1]]) AS weapon, unnest([0, 1]) AS pos,
    (SELECT count(*) FROM st WHERE st.session = ab.session AND st.enter <= ab.abs_t) AS no
  FROM ab WHERE kind = 'match_start' AND k % 2 = 0),
he AS (SELECT session, no, arg_min(hero, (abs_t, src, hero)) AS hero FROM ge GROUP BY 1, 2),
we AS (SELECT session, no, weapon, min((abs_t, pos)) AS first FROM ge GROUP BY 1, 2, 3)
SELECT session, no, hero, (SELECT string_agg(weapon, '+' ORDER BY first, weapon) FROM we WHERE we.session = he.session AND we.no = he.no) AS weapons
FROM he""")
def match_gear(spark, sf):
    g = matches.session_gear(T.timeline(spark, sf, with_gear=True), matches.part_bases(T.parts(spark, sf)), W)
    return g.select("session", "no", "hero", F.array_join("weapons", "+").alias("weapons"))


KNOCKS = f"""{T.TL}, {T.PARTS}, g AS (
  SELECT *, CASE WHEN t_start - lag(t_start) OVER (PARTITION BY session, src ORDER BY t_start, line_no) <= 12 THEN 0 ELSE 1 END AS o FROM tl WHERE kind = 'down'),
n AS (SELECT *, sum(o) OVER (PARTITION BY session, src ORDER BY t_start, line_no ROWS UNBOUNDED PRECEDING) AS seg,
  CASE WHEN k % 3 = 0 THEN '击中头部 ' ELSE '击倒 ' END || target AS txt FROM g),
c AS (
  SELECT session, src, seg, min(t_start) AS t0, max(t_start) AS t1, count(*) AS n, count(*) FILTER (k % 3 = 0) AS heads,
    string_agg(target, ',' ORDER BY t_start, '击倒 ' || target, k % 3 = 0, txt) AS targets,
    arg_min(target, (t_start, '击倒 ' || target, k % 3 = 0, txt)) AS first_target
  FROM n GROUP BY 1, 2, 3),
kc AS (
  SELECT c.*, p.part, row_number() OVER (PARTITION BY c.session ORDER BY p.part_seq, c.t0) AS seq,
    greatest(0, t0 - 6) AS cut0, least(p.duration_s, t1 + 10) AS cut1,
    CASE WHEN n = 1 THEN '击倒_' || first_target ELSE '击倒x' || n || '_' || first_target || '等' END AS label
  FROM c JOIN parts p USING (session, src))"""


def knocks(spark, sf):
    return clips.knock_clips(T.timeline(spark, sf), T.parts(spark, sf), width=120.0)


@query("knock_clips", f"""WITH {KNOCKS} SELECT session, src, seq, t0 AS t_start, t1 AS t_end, round(cut0, 2) AS cut0, round(cut1, 2) AS cut1,
  n, heads, targets, label, printf('%02d', seq) || '_P' || part || '_' || printf('%02dm%02ds', CAST(round_even(t0, 0) AS BIGINT) // 60, CAST(round_even(t0, 0) AS BIGINT) % 60)
  || '_' || label || '.mp4' AS file FROM kc""")
def knock_clips(spark, sf):
    c = knocks(spark, sf)
    return c.select(
        "session", "src", "seq", "t_start", "t_end", F.get("cut", F.lit(0)).alias("cut0"), F.get("cut", F.lit(1)).alias("cut1"),
        F.size("targets").cast("long").alias("n"),
        F.size(F.filter("events", lambda e: e.getField("headshot"))).cast("long").alias("heads"),
        F.array_join("targets", ",").alias("targets"), "label", "file",
    )


@query("clip_document_rows", f"""WITH {KNOCKS} SELECT session, count(*) OVER (PARTITION BY session) AS n_clips, seq, src, t0 AS t_start, t1 AS t_end, round(cut0, 2) AS cut0,
  round(cut1, 2) AS cut1, targets, label FROM kc""")
def clip_document_rows(spark, sf):
    """Clip indexes written as one JSON file per session and read back."""
    folder = new_folder(spark, "clips")
    c = knocks(spark, sf).withColumn("place", F.col("seq"))
    documents.write(media.clip_document_lines(c, "place", ["seq", "src", "t_start", "t_end", "cut", "targets", "label", "file"]), folder)
    docs = documents.read_json(
        spark, folder, "session string, n long, clips array<struct<seq:long,src:string,t_start:double,t_end:double,cut:array<double>,targets:array<string>,label:string>>"
    )
    rows = docs.select("session", F.col("n").alias("n_clips"), F.explode("clips").alias("c")).select("session", "n_clips", "c.*")
    return rows.withColumns({"cut0": F.get("cut", F.lit(0)), "cut1": F.get("cut", F.lit(1)), "targets": F.array_join("targets", ",")}).drop("cut")


def pickups(spark, sf, m=None):
    """Pickup sessions; ``m``: the matches, if they are at hand."""
    e, p = T.timeline(spark, sf, with_gear=True), T.parts(spark, sf)
    b = matches.part_bases(p)
    m = matches.build_matches(e, b, W) if m is None else m
    return clips.pickup_sessions(e, T.readings(spark, sf), p, b, m, width=120.0)


@query("pickup_sessions")
def pickup_sessions(spark, sf):
    return pickups(spark, sf).drop("events")


@query("pickup_index")
def pickup_index(spark, sf):
    return clips.pickup_index(pickups(spark, sf), T.parts(spark, sf)).drop("events")


@query("fallback_islands", f"""WITH {T.TL}, g AS (
  SELECT *, CASE WHEN t_start - lag(t_start) OVER (PARTITION BY session, src ORDER BY t_start, line_no) <= 25 THEN 0 ELSE 1 END AS o FROM tl WHERE kind = 'loot'),
n AS (SELECT *, sum(o) OVER (PARTITION BY session, src ORDER BY t_start, line_no ROWS UNBOUNDED PRECEDING) AS cluster FROM g)
SELECT session, src, CAST(cluster AS BIGINT) AS cluster, min(t_start) AS first_pick, max(t_start) AS last_pick, CAST(sum(1 + k % 2) AS BIGINT) AS jumps,
  string_agg(DISTINCT hall, '+' ORDER BY hall) AS containers FROM n GROUP BY 1, 2, 3""")
def fallback_islands(spark, sf):
    """Own jumps of every island: the rescue used where no interface session was read."""
    i = clips.loot_islands(T.timeline(spark, sf), width=120.0)
    return i.groupBy("session", "src", "cluster").agg(
        F.min("t_start").alias("first_pick"), F.max("t_start").alias("last_pick"),
        F.sum(F.col("cur") - F.col("prev")).alias("jumps"),
        F.array_join(F.sort_array(F.collect_set("container")), "+").alias("containers"),
    )


@query("queue_moments", f"""WITH {T.TL}, {T.RD}, {T.PARTS}, s AS (
  SELECT session, src, t_start AS tm, lag(t_start) OVER (PARTITION BY session, src ORDER BY t_start, line_no) AS before FROM tl WHERE kind = 'match_start'),
f AS (SELECT *, CAST(trunc(tm) AS BIGINT) AS w FROM s),
g AS (SELECT *, least(CASE WHEN before IS NULL THEN 0 ELSE greatest(CAST(trunc(before) AS BIGINT) + 60, w - 300) END, w - 1) AS flo FROM f),
fr AS (SELECT session, src, t, string_agg(text, '' ORDER BY seq) AS roi FROM rd WHERE cx / 1920 BETWEEN CAST(0.6 AS DOUBLE) AND 1 AND cy / 1080 BETWEEN CAST(0.74 AS DOUBLE) AND 1 GROUP BY 1, 2, 3),
b AS (SELECT *, CASE WHEN contains(roi, '匹配') THEN '匹配中' ELSE '出发' END AS trigger FROM fr WHERE contains(roi, '匹配') OR contains(roi, '出发')),
h AS (SELECT g.session, g.src, g.tm, g.before, g.flo, max(b.t) AS tq FROM g LEFT JOIN b ON b.session = g.session AND b.src = g.src AND b.t <= g.w - 1 AND b.t >= g.flo GROUP BY ALL)
SELECT h.session, h.src, h.tm AS t_match_start, h.flo AS floor, CAST(h.tq AS BIGINT) AS t_queue, b.trigger, substring(b.roi, 1, 60) AS roi_text
FROM h LEFT JOIN b ON b.session = h.session AND b.src = h.src AND b.t = h.tq""")
def queue_moments(spark, sf):
    q = clips.queue_moments(T.timeline(spark, sf), T.readings(spark, sf), T.parts(spark, sf), width=120.0)
    return q.select("session", "src", "t_match_start", "floor", "t_queue", "trigger", "roi_text")


@query("lobby_rows", f"""WITH {T.TL}, {T.RD}, m AS (SELECT src, t FROM rd WHERE text = '开始游戏' AND score > CAST(0.5 AS DOUBLE) AND cx / 1920 BETWEEN 0 AND CAST(0.7 AS DOUBLE) AND cy / 1080 BETWEEN 0 AND CAST(0.15 AS DOUBLE))
SELECT l.line_no, EXISTS (SELECT 1 FROM m WHERE m.src = l.src AND m.t BETWEEN l.t_start - 2 AND l.t_start + 1) AS lobby FROM tl l WHERE l.kind = 'loot'""")
def lobby_rows(spark, sf):
    e = T.timeline(spark, sf).where(F.col("kind") == "loot").select(
        "session", "src", "line_no", F.col("t_start").alias("first_pick"), F.col("t_start").alias("last_pick")
    )
    return clips.flag_lobby(e, T.readings(spark, sf), 120.0).select("line_no", "lobby")
