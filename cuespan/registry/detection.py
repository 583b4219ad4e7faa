"""Readings to events: bands, settlement tracking, raw detections, merging, speech, gear."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuespan import constants as K
from cuespan.plans import detect, loadout
from cuespan.registry import tables as T
from cuespan.registry.book import query

C = 120.0
EXTRACT = "regexp_matches(text, '撤离成功|撤离失败|任务失败|行动失败|行动成功')"

SETTLE = f"""{T.RD}, fr AS (SELECT session, src, t, bool_or(band) AS band FROM rd WHERE {EXTRACT} GROUP BY 1, 2, 3),
ch AS (SELECT *, sum(CASE WHEN d < 12 THEN 0 ELSE 1 END) OVER (PARTITION BY session, src ORDER BY t ROWS UNBOUNDED PRECEDING) AS chain FROM (
  SELECT *, t - lag(t) OVER (PARTITION BY session, src ORDER BY t) AS d FROM fr)),
sp AS (SELECT session, src, min(t) FILTER (band) AS lo, max(t) + 12 AS hi FROM ch GROUP BY session, src, chain HAVING min(t) FILTER (band) IS NOT NULL),
vi AS (SELECT rd.*, NOT band AS off_band FROM rd WHERE band OR EXISTS (SELECT 1 FROM sp WHERE sp.session = rd.session AND sp.src = rd.src AND rd.t > sp.lo AND rd.t < sp.hi))"""


@query("band_readings", f"WITH {T.RD} SELECT seq FROM rd WHERE band")
def band_readings(spark, sf):
    return T.readings(spark, sf).where(detect.in_region(K.INFO_BAND)).select(F.col("seq").cast("long").alias("seq"))


@query("settlement_spans", f"WITH {SETTLE} SELECT session, src, lo, hi FROM sp")
def settlement_spans(spark, sf):
    return detect.settlement_spans(T.readings(spark, sf), C)


@query("visible_readings", f"WITH {SETTLE} SELECT CAST(seq AS BIGINT) AS seq, off_band FROM vi")
def visible_readings(spark, sf):
    return detect.visible_readings(T.readings(spark, sf), C).select(F.col("seq").cast("long").alias("seq"), "off_band")


@query("down_texts", f"""WITH {T.RD} SELECT CAST(seq AS BIGINT) AS seq, 'T' || (k % 7) || '号' AS target FROM rd
WHERE starts_with(text, '击倒') AND abs(cx - 960) < 1920 * CAST(0.35 AS DOUBLE) AND cy > 1080 * CAST(0.62 AS DOUBLE) AND cy < 1080 * CAST(0.82 AS DOUBLE)""")
def down_texts(spark, sf):
    r = T.readings(spark, sf).where(detect.down_position() & detect.down_text(F.col("text")))
    return r.select(F.col("seq").cast("long").alias("seq"), F.regexp_extract("text", K.TARGET_TEXT, 1).alias("target"))


@query("container_reads", f"WITH {T.RD} SELECT CAST(seq AS BIGINT) AS seq, container, CAST(cur AS BIGINT) AS cur FROM rd WHERE container IS NOT NULL")
def container_reads(spark, sf):
    return detect.container_reads(T.readings(spark, sf)).select(F.col("seq").cast("long").alias("seq"), "container", F.col("cur").cast("long").alias("cur"))


@query("weapon_boxes", f"""WITH {T.RD} SELECT CAST(seq AS BIGINT) AS seq FROM rd WHERE box_h <= 1080 * CAST(0.03 AS DOUBLE) AND box_w <= 1920 * CAST(0.12 AS DOUBLE)""")
def weapon_boxes(spark, sf):
    return T.readings(spark, sf).where(detect.weapon_box()).select(F.col("seq").cast("long").alias("seq"))


@query("raw_event_counts", f"""WITH {SETTLE}, se AS (SELECT DISTINCT session, src, t FROM vi WHERE {EXTRACT}),
cf AS (SELECT *, lag(cur) OVER w AS prev, lead(cur) OVER w AS next FROM vi WHERE container IS NOT NULL WINDOW w AS (PARTITION BY session, src, container ORDER BY t, seq))
SELECT 'down' AS kind, src, count(*) AS n FROM vi WHERE starts_with(text, '击倒') AND abs(cx - 960) < 1920 * CAST(0.35 AS DOUBLE) AND cy > 1080 * CAST(0.62 AS DOUBLE)
  AND cy < 1080 * CAST(0.82 AS DOUBLE) AND NOT EXISTS (SELECT 1 FROM se WHERE se.session = vi.session AND se.src = vi.src AND se.t = vi.t) GROUP BY src
UNION ALL SELECT 'match_start', src, count(*) FROM vi WHERE text = '即将着陆' AND cy > 1080 * CAST(0.75 AS DOUBLE) GROUP BY src
UNION ALL SELECT 'extract', src, count(*) FROM vi WHERE {EXTRACT} GROUP BY src
UNION ALL SELECT 'dance', src, count(*) FROM vi WHERE text = '跳舞' GROUP BY src
UNION ALL SELECT 'loot', src, count(*) FROM cf WHERE cur > prev AND next >= cur GROUP BY src""")
def raw_event_counts(spark, sf):
    return detect.raw_events(T.readings(spark, sf), C).groupBy("kind", "src").agg(F.count("*").alias("n"))


@query("raw_loots", f"""WITH {SETTLE}, cf AS (SELECT *, lag(cur) OVER w AS prev, lead(cur) OVER w AS next FROM vi WHERE container IS NOT NULL WINDOW w AS (PARTITION BY session, src, container ORDER BY t, seq)),
tx AS (SELECT session, src, t, string_agg(text, ' ' ORDER BY seq) AS j, list(text ORDER BY seq) AS l FROM vi WHERE container IS NULL AND text <> '电竞冠军' GROUP BY 1, 2, 3)
SELECT cf.src, cf.t, container || ' ' || prev || '->' || cur AS detail, CASE WHEN contains(j, '大红') THEN 3500000 WHEN contains(j, '金条') THEN 800000 END AS price,
  coalesce(array_to_string(l[1:6], ','), '') AS context FROM cf LEFT JOIN tx USING (session, src, t) WHERE cur > prev AND next >= cur""")
def raw_loots(spark, sf):
    r = detect.raw_events(T.readings(spark, sf), C).where(F.col("kind") == "loot")
    return r.select("src", "t", "detail", "price", F.array_join("context", ",").alias("context"))


@query("extract_snapshots", f"""WITH {SETTLE}, h AS (SELECT vi.*, EXISTS (SELECT 1 FROM sp WHERE sp.session = vi.session AND sp.src = vi.src AND vi.t > sp.lo AND vi.t < sp.hi) AS ful,
  min(seq) OVER (PARTITION BY session, src, t) AS fs FROM vi WHERE {EXTRACT}),
sn AS (SELECT session, src, t, list(text ORDER BY seq)[1:30] AS l FROM rd WHERE score > CAST(0.6 AS DOUBLE) GROUP BY 1, 2, 3),
pt AS (SELECT session, src, t, arg_min(text, seq) AS p FROM vi WHERE contains(text, '撤离点') GROUP BY 1, 2, 3)
SELECT CAST(h.seq AS BIGINT) AS seq, coalesce(p, '') AS point, CASE WHEN ful OR h.seq = fs THEN array_to_string(l, '|') END AS snapshot
FROM h LEFT JOIN sn USING (session, src, t) LEFT JOIN pt USING (session, src, t)""")
def extract_snapshots(spark, sf):
    r = detect.raw_events(T.readings(spark, sf), C).where(F.col("kind") == "extract")
    return r.select(F.col("ord_seq").cast("long").alias("seq"), "point", F.array_join("snapshot", "|").alias("snapshot"))


@query("settlement_attributes", f"""WITH {T.RD}, g AS (SELECT src, t, bool_or(text = '收益 12,345') AS p, bool_or(text = '1:02:03') AS d, bool_or(text = '击败干员三') AS k3 FROM rd GROUP BY 1, 2)
SELECT src, t, CASE WHEN d THEN '1:02:03' END AS duration, CASE WHEN p THEN '12,345' END AS profit, CASE WHEN k3 THEN '三' END AS kills FROM g WHERE p OR d OR k3""")
def settlement_attributes(spark, sf):
    g = T.readings(spark, sf).groupBy("src", "t").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]).alias("texts"))
    a = detect.settlement_attributes(F.col("texts"))
    out = g.select("src", "t", a["duration"].alias("duration"), a["profit"].alias("profit"), a["kills_official"].alias("kills"))
    return out.where("duration is not null or profit is not null or kills is not null")


@query("detected_events")
def detected_events(spark, sf):
    e = detect.detect_events(T.readings(spark, sf), C)
    return e.select("session", "src", "kind", "t_start", "t_end", "detail", "confidence", "price", "meta.duration", "meta.profit")


@query("spoken_pickups", f"""WITH {T.TL}, {T.SE}, hs AS (SELECT * FROM se WHERE coalesce(speaker, 'host') = 'host' AND regexp_matches(text, '出金|大红|金条|显卡'))
SELECT src, start AS t_start, "end" AS t_end, '语音高价值: ' || substring(text, 1, 30) AS detail FROM hs WHERE length(text) <= 40
  AND NOT EXISTS (SELECT 1 FROM tl WHERE tl.kind = 'loot' AND tl.src = hs.src AND tl.session = hs.session AND (hs.start + hs."end") / 2 BETWEEN tl.t_start - 10 AND tl.t_end + 10)""")
def spoken_pickups(spark, sf):
    e = T.timeline(spark, sf)
    out = detect.apply_speech(e, T.sentences(spark, sf), C)
    return out.where(F.startswith("detail", F.lit("语音高价值"))).select("src", "t_start", "t_end", "detail")


@query("speech_hints", f"""WITH {T.TL}, {T.SE}, hs AS (SELECT * FROM se WHERE coalesce(speaker, 'host') = 'host' AND regexp_matches(text, '出金|大红|金条|显卡')),
hh AS (SELECT l.line_no, hs.id, hs.text, row_number() OVER (PARTITION BY l.line_no ORDER BY hs.id) AS rn FROM tl l JOIN hs ON hs.src = l.src AND hs.session = l.session
  AND (l.t_start + l.t_end) / 2 BETWEEN hs.start - 10 AND hs."end" + 10 WHERE l.kind = 'loot' AND coalesce(l.price, 0) = 0)
SELECT line_no, md5(string_agg(text, '|' ORDER BY id)) AS hints FROM hh WHERE rn <= 3 GROUP BY 1""")
def speech_hints(spark, sf):
    e = T.timeline(spark, sf)
    bare = e.withColumn("meta", F.col("meta").withField("voice_hint", F.lit(None).cast("array<string>")))
    out = detect.apply_speech(bare, T.sentences(spark, sf), C)
    return out.where(F.col("line_no").isNotNull() & F.col("meta.voice_hint").isNotNull()).select("line_no", F.md5(F.array_join("meta.voice_hint", "|")).alias("hints"))


@query("loadouts")
def loadouts(spark, sf):
    starts = T.timeline(spark, sf).where(F.col("kind") == "match_start")
    lo = loadout.loadouts(T.readings(spark, sf), starts)
    return lo.select("session", "src", "t_start", "detail", "confidence", "meta.hero", F.array_join("meta.weapons", "+").alias("weapons"))


@query("merged_tables", """SELECT n_name, CASE WHEN n_nationkey % 2 = 0 THEN 'x' || n_nationkey ELSE r_name END AS kind FROM nation JOIN region ON n_regionkey = r_regionkey""")
def merged_tables(spark, sf):
    n = T.table(spark, sf, "nation").join(T.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    base = n.select("n_name", F.col("r_name").alias("kind"))
    over = n.where("n_nationkey % 2 = 0").select("n_name", F.concat(F.lit("x"), F.col("n_nationkey").cast("string")).alias("kind"))
    return loadout.merged_table(base, over, "n_name", "kind")


@query("loot_near_container", f"""WITH {T.TL}, p AS (SELECT l.line_no, d.line_no AS hit, row_number() OVER (PARTITION BY l.line_no ORDER BY abs(l.t_start - d.t_start), d.t_start, d.line_no) AS rn
  FROM tl l JOIN tl d ON d.session = l.session AND d.hall = l.hall AND d.kind = 'extract' AND abs(l.t_start - d.t_start) <= 2.5 WHERE l.kind = 'loot')
SELECT line_no, hit FROM p WHERE rn = 1""")
def loot_near_container(spark, sf):
    from cuespan.operators.ordered import nearest

    e = T.timeline(spark, sf).withColumn("hall", F.element_at(F.array(*[F.lit(h) for h in T.HALLS]), F.col("k") % 3 + 1))
    lo = e.where(F.col("kind") == "loot").select("session", "hall", "t_start", "line_no")
    ex = e.where(F.col("kind") == "extract").select("session", "hall", F.col("t_start").alias("x_t"), F.col("line_no").alias("hit_no"))
    out = nearest(lo, ex, ["session", "hall"], "t_start", "x_t", ["hit_no"], C, tolerance=2.5, tie="hit_no")
    return out.where("hit is not null").select("line_no", F.col("hit.hit_no").alias("hit"))
