"""The seven edit templates and the steps they are made of."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuespan.plans import edl
from cuespan.registry import tables as T
from cuespan.registry.book import query
from cuespan.registry.matches import KNOCKS, knocks
from cuespan.registry.sources import label_files
from cuespan.session import cut_lineage, new_folder
from cuespan.sources import documents
from cuespan.sources.media import edl_document_lines, parse_labels

CL = f"""{T.TL}, cg AS (
  SELECT *, CASE WHEN src = lag(src) OVER w AND t_start - lag(t_start) OVER w <= 15 THEN 0 ELSE 1 END AS o
  FROM tl WHERE kind = 'down' WINDOW w AS (PARTITION BY session ORDER BY t_start, part_dir, line_no)),
cn AS (SELECT *, sum(o) OVER (PARTITION BY session ORDER BY t_start, part_dir, line_no ROWS UNBOUNDED PRECEDING) AS cl FROM cg),
cc AS (SELECT session, cl, min(src) AS src, min(t_start) AS a, max(t_start) AS b, count(*) AS n FROM cn GROUP BY 1, 2),
cr AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY n DESC, cl) AS pos FROM cc)"""

KILL = "CASE " + " ".join(f"WHEN n = {k} THEN '{w}'" for k, w in {1: "击倒", 2: "双杀", 3: "三杀", 4: "四杀", 5: "五杀"}.items()) + " ELSE n || '杀' END"

LOOTS = """vl AS (SELECT *, coalesce(price, 0) AS worth FROM tl WHERE kind = 'loot' AND (coalesce(price, 0) <> 0 OR hint IS NOT NULL)),
lr AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY worth DESC, part_dir, line_no) AS pos FROM vl),
le AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY part_dir DESC, line_no DESC) AS rn FROM tl WHERE kind = 'extract' AND ok)"""
LCAP = "CASE WHEN worth >= 3000000 THEN '出大红！' WHEN worth >= 1000000 THEN '出红！' ELSE '高价值！' END"


def snap_sql(inp: str, out: str, min_len: str = "2.5") -> str:
    """CTEs that fit segments of ``inp`` (session, seg, src, t0, t1, cap, ...) to sentences."""
    return f"""{out}1 AS (SELECT g.*, (SELECT arg_min(s.start, s.id) FROM se s WHERE s.session = g.session AND s.src = g.src AND s.start <= g.t0 AND g.t0 < s."end") AS x0,
    (SELECT arg_min(s."end", s.id) FROM se s WHERE s.session = g.session AND s.src = g.src AND s.start <= g.t1 AND g.t1 < s."end") AS x1 FROM {inp} g),
{out}2 AS (SELECT *, CASE WHEN coalesce(x1, t1) - x0 <= cap THEN x0 END AS s0 FROM {out}1),
{out}3 AS (SELECT *, coalesce(s0, greatest(0, t0)) AS a0, coalesce(CASE WHEN x1 - coalesce(s0, t0) <= cap THEN x1 END, t1) AS b0 FROM {out}2),
{out}4 AS (SELECT g.*, CASE WHEN b0 - a0 > cap THEN coalesce((SELECT arg_max(s."end", s.id) FROM se s WHERE s.session = g.session AND s.src = g.src AND s.start >= g.a0 AND s."end" <= g.a0 + g.cap), b0) ELSE b0 END AS b1 FROM {out}3 g),
{out} AS (SELECT *, round(a0, 2) AS t_in, round(greatest(least(b1, a0 + cap), a0 + {min_len}), 2) AS t_out FROM {out}4)"""


def pool(spark, sf):
    return T.timeline(spark, sf)


def show(df):
    return df.select("session", F.col("seg").cast("long").alias("seg"), "src", "t_in", "t_out", "kind", F.col("count"), "price", "caption")


@query("event_clusters", f"WITH {CL} SELECT session, CAST(cl AS BIGINT) AS cl, src, a AS t_first, b AS t_last, n FROM cc")
def event_clusters(spark, sf):
    return edl.clusters(pool(spark, sf), width=120.0)


@query("top_clusters", f"WITH {CL} SELECT session, CAST(cl AS BIGINT) AS cl, n, pos FROM cr WHERE pos <= 6")
def top_clusters(spark, sf):
    return edl.biggest(edl.clusters(pool(spark, sf), width=120.0), 6).select("session", "cl", "n", F.col("pos").cast("long").alias("pos"))


@query("plan_fast_cut", f"""WITH {CL}, {LOOTS}, {T.SE}, sg AS (
  SELECT session, src, a - 6 AS t0, b + 5 AS t1, least(15, greatest(10, b + 5 - (a - 6))) AS cap, 'kill' AS kind, n AS cnt, NULL::BIGINT AS price, {KILL} || '！' AS caption, pos AS ins FROM cr WHERE pos <= 2
  UNION ALL SELECT session, src, t_start - 6, t_end + 8, 14, 'loot', 1, price, {LCAP}, pos + 10 FROM lr WHERE pos <= 2
  UNION ALL SELECT session, src, t_start - 8, t_end + 6, 14, 'extract', 1, NULL, '安全撤离！', 20 FROM le WHERE rn = 1),
gs AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ins) AS seg0 FROM sg), {snap_sql("gs", "sn")},
hk AS (SELECT *, CASE WHEN kind = 'kill' AND row_number() OVER (PARTITION BY session, kind = 'kill' ORDER BY cnt DESC, t_out - t_in, ins) = 1 THEN 0 ELSE 1 END AS hook FROM sn),
fi AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY hook, t_out - t_in, ins) AS seg FROM hk)
SELECT session, seg, src, t_in, t_out, kind, cnt AS count, price, caption FROM fi WHERE seg <= 5""")
def plan_fast_cut(spark, sf):
    return show(edl.fast_cut(pool(spark, sf), T.sentences(spark, sf)))


NO = "coalesce(CAST(nullif((SELECT count(*) FROM tl m WHERE m.kind = 'match_start' AND m.session = {x}.session AND m.src = {x}.src AND m.t_start <= {x}.{t}), 0) AS VARCHAR), '')"


MIX = f"""{CL}, {T.SE}, gs AS (
  SELECT session, src, a - 6 AS t0, b + 5 AS t1, greatest(12, b + 5 - (a - 6)) AS cap, n, pos AS ins, {NO.format(x="cr", t="a")} AS no FROM cr WHERE pos <= 6), {snap_sql("gs", "sn")},
fi AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY src, t_in, ins) AS seg FROM sn)"""
MIX_ROWS = """session, seg, src, t_in, t_out, 'kill' AS kind, n AS count, NULL::BIGINT AS price, '击杀' || seg || ' 第' || no || '场 ' || """ + KILL + """ AS caption FROM fi"""


@query("plan_category_mix", f"WITH {MIX} SELECT {MIX_ROWS}")
def plan_category_mix(spark, sf):
    return show(edl.category_mix(pool(spark, sf), T.sentences(spark, sf)))


@query("edl_document_rows", f"""WITH {MIX}, ro AS (SELECT {MIX_ROWS}),
ps AS (SELECT session, count(*) FILTER (kind = 'down') AS n_down, count(*) FILTER (kind = 'extract' AND ok) AS n_extract_ok, count(*) AS n_events FROM tl GROUP BY 1)
SELECT 'category_mix' AS template, '1080x1920' AS resolution, n_down, n_extract_ok, n_events, ro.* FROM ro JOIN ps USING (session)""")
def edl_document_rows(spark, sf):
    """Edit decision lists written as one JSON file per session and read back, all segments in full."""
    folder = new_folder(spark, "edl")
    p = cut_lineage(pool(spark, sf))
    segs = show(edl.category_mix(p, T.sentences(spark, sf)))
    documents.write(edl_document_lines(segs, edl.pool_stats(p), "category_mix", F.lit("1080x1920")), folder)
    docs = documents.read_json(
        spark, folder, "session string, template string, resolution string, pool_stats struct<n_down:long,n_extract_ok:long,n_events:long>, "
        "segments array<struct<seg:long,src:string,t_in:double,t_out:double,kind:string,count:long,price:long,caption:string>>"
    )
    return docs.select("session", "template", "resolution", "pool_stats.*", F.explode("segments").alias("s")).select("*", "s.*").drop("s")


@query("plan_match_story", f"""WITH {CL}, {LOOTS}, {T.SE},
fm AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY part_dir, t_start, line_no) AS rn FROM tl WHERE kind = 'match_start'),
ee AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ok DESC, part_dir DESC, line_no DESC) AS rn FROM tl WHERE kind = 'extract'),
gs AS (
  SELECT session, src, t_start AS t0, t_start + 18 AS t1, CAST(18 AS DOUBLE) AS cap, 'match' AS kind, 0 AS cnt, NULL::BIGINT AS price, '今晚开肝' AS caption, 0 AS ins FROM fm WHERE rn = 1
  UNION ALL SELECT session, src, a - 6, b + 5, 25, 'kill', n, NULL, '第' || {NO.format(x="cr", t="a")} || '场 ' || {KILL} || '！', pos FROM cr WHERE pos <= 3
  UNION ALL SELECT session, src, t_start - 6, t_end + 8, 15, 'loot', 0, price, '第' || {NO.format(x="lr", t="t_start")} || '场 ' || {LCAP}, pos + 10 FROM lr WHERE pos <= 2
  UNION ALL SELECT session, src, t_start - 8, t_end + 6, 25, 'extract', 0, NULL, '第' || {NO.format(x="ee", t="t_start")} || '场收官：' || CASE WHEN ok THEN '撤离成功' ELSE '撤离失败' END, 20 FROM ee WHERE rn = 1),
{snap_sql("gs", "sn")}
SELECT session, row_number() OVER (PARTITION BY session ORDER BY CASE kind WHEN 'match' THEN 0 WHEN 'extract' THEN 2 ELSE 1 END, t_in, ins) AS seg, src, t_in, t_out, kind, cnt AS count, price, caption FROM sn""")
def plan_match_story(spark, sf):
    return show(edl.match_story(pool(spark, sf), T.sentences(spark, sf)))


@query("plan_multi_kill", f"""WITH {CL}, k2 AS (SELECT * FROM cc WHERE n >= 2)
SELECT session, row_number() OVER w AS seg, src, round(a - 8, 2) AS t_in, round(b + 4, 2) AS t_out, n AS count,
  CAST(sum(n) OVER (PARTITION BY session ORDER BY src, a ROWS UNBOUNDED PRECEDING) AS BIGINT) AS counter, {KILL} || '！' AS caption FROM k2 WINDOW w AS (PARTITION BY session ORDER BY src, a)""")
def plan_multi_kill(spark, sf):
    m = edl.multi_kill(pool(spark, sf), width=120.0)
    return m.select("session", "seg", "src", "t_in", "t_out", "count", "counter", "caption")


@query("speed_zones", f"""WITH {CL}, k2 AS (SELECT * FROM cc WHERE n >= 2), tt AS (
  SELECT cn.session, cn.cl, cn.t_start AS t, k2.a - 8 AS lo, k2.b + 4 AS hi, lag(cn.t_start) OVER (PARTITION BY cn.session, cn.cl ORDER BY cn.t_start, cn.line_no) AS p
  FROM cn JOIN k2 ON k2.session = cn.session AND k2.cl = cn.cl),
zr AS (SELECT *, sum(CASE WHEN p IS NULL OR t - 2 > p THEN 1 ELSE 0 END) OVER (PARTITION BY session, cl ORDER BY t ROWS UNBOUNDED PRECEDING) AS z FROM tt),
za AS (SELECT session, cl, z, min(t) - 2 AS a, max(t) AS b, min(lo) AS lo, min(hi) AS hi FROM zr GROUP BY 1, 2, 3),
zz AS (SELECT *, coalesce(lag(b) OVER w, lo) AS cur, lead(z) OVER w IS NULL AS fin FROM za WINDOW w AS (PARTITION BY session, cl ORDER BY z))
SELECT session, CAST(cl AS BIGINT) AS cl, round(cur, 2) AS t0, round(a, 2) AS t1, CAST(1.5 AS DOUBLE) AS speed FROM zz WHERE a > cur
UNION ALL SELECT session, CAST(cl AS BIGINT), round(greatest(a, lo), 2), round(b, 2), 0.5 FROM zz
UNION ALL SELECT session, CAST(cl AS BIGINT), round(b, 2), round(hi, 2), 1.5 FROM zz WHERE fin AND b < hi""")
def speed_zones(spark, sf):
    rows = cut_lineage(edl.cluster_rows(pool(spark, sf), "down", 15.0, 120.0))
    cl = rows.groupBy("session", "cl").agg(F.min("t_start").alias("t_first"), F.max("t_start").alias("t_last"), F.count("*").alias("n")).where("n >= 2")
    z = edl.speed_zones(rows.join(cl.drop("n"), ["session", "cl"]), 1.5, 0.5, 2.0, 8.0, 4.0)
    return z.select("session", "cl", F.explode("zones").alias("z")).select("session", "cl", "z.*")


def picks(spark, sf):
    lab = cut_lineage(edl.labelled(parse_labels(label_files(spark, sf)), knocks(spark, sf), T.parts(spark, sf)))
    return edl.picks_of(lab), edl.false_times(lab)


PICKS = f"""{KNOCKS}, pk AS (SELECT session, src, t0 AS a, t1 AS b, n, file, CASE WHEN seq % 2 = 0 THEN CAST(seq % 11 AS DOUBLE) END AS score
  FROM (SELECT *, printf('%02d', seq) || '_P' || part || '_' || printf('%02dm%02ds', CAST(round_even(t0, 0) AS BIGINT) // 60, CAST(round_even(t0, 0) AS BIGINT) % 60) || '_' || label || '.mp4' AS file FROM kc)
  WHERE seq % 3 = 0 AND seq % 5 <> 0),
fp AS (SELECT kc.session, kc.src, n.t_start AS t FROM kc JOIN n ON n.session = kc.session AND n.src = kc.src AND n.seg = kc.seg WHERE kc.seq % 5 = 0),
pr AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY score DESC NULLS LAST, file) AS pos FROM pk),
cg AS (
  SELECT *, CASE WHEN src = lag(src) OVER w AND t_start - lag(t_start) OVER w <= 15 THEN 0 ELSE 1 END AS o
  FROM tl WHERE kind = 'down' AND NOT EXISTS (SELECT 1 FROM fp WHERE fp.session = tl.session AND fp.src = tl.src AND fp.t BETWEEN tl.t_start - 5 AND tl.t_start + 5)
  WINDOW w AS (PARTITION BY session ORDER BY t_start, part_dir, line_no)),
cn AS (SELECT *, sum(o) OVER (PARTITION BY session ORDER BY t_start, part_dir, line_no ROWS UNBOUNDED PRECEDING) AS cl FROM cg),
cc AS (SELECT session, cl, min(src) AS src, min(t_start) AS a, max(t_start) AS b, count(*) AS n FROM cn GROUP BY 1, 2)"""


@query("label_picks", f"WITH {PICKS} SELECT session, src, a AS t_first, b AS t_last, n, score AS pick_score, pos FROM pr")
def label_picks(spark, sf):
    from cuespan.operators.ordered import lane, number_rows

    p, _ = picks(spark, sf)
    rows = p.withColumn("__o", -F.coalesce("pick_score", F.lit(-1.0)))
    return number_rows(rows, lane("session", ("__o", "file"), 4.0), "pos").select("session", "src", "t_first", "t_last", "n", "pick_score", "pos")


@query("plan_hot_kills", f"""WITH {PICKS}, {T.SE}, fr AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY n DESC, cl) AS pos FROM cc
  WHERE NOT EXISTS (SELECT 1 FROM pk WHERE pk.session = cc.session AND pk.src = cc.src AND abs(pk.a - cc.a) < 45)),
al AS (SELECT session, src, a, b, n, 0 AS auto, pos FROM pr WHERE pos <= 5 UNION ALL SELECT session, src, a, b, n, 1, pos FROM fr WHERE pos <= 5),
tp AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY auto, pos) AS top FROM al QUALIFY top <= 5),
zi AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY n DESC, top) - 1 AS i, count(*) OVER (PARTITION BY session) AS o FROM tp),
zg AS (SELECT *, CASE WHEN i < ceil(o / 2) THEN i * 2 ELSE (o - 1 - i) * 2 + 1 END AS zig FROM zi),
gs AS (SELECT session, src, a - 4 AS t0, b + 3 AS t1, CASE WHEN n < 3 THEN 8 ELSE greatest(8, least(15, b + 3 - (a - 4))) END AS cap, n, auto, zig,
  CAST(sum(n) OVER (PARTITION BY session ORDER BY zig ROWS UNBOUNDED PRECEDING) AS BIGINT) AS counter FROM zg), {snap_sql("gs", "sn")}
SELECT session, row_number() OVER (PARTITION BY session ORDER BY zig) AS seg, src, t_in, t_out, n AS count, counter, CASE WHEN auto = 0 THEN '★ ' ELSE '' END || {KILL} || '！' AS caption FROM sn""")
def plan_hot_kills(spark, sf):
    p, f = picks(spark, sf)
    h = edl.hot_kills(pool(spark, sf), T.sentences(spark, sf), p, f)
    return h.select("session", F.col("seg").cast("long").alias("seg"), "src", "t_in", "t_out", "count", "counter", "caption")


@query("plan_single_best", f"""WITH {PICKS}, {T.SE}, al AS (SELECT session, src, a, b, n, 0 AS auto FROM pr WHERE pos = 1
  UNION ALL SELECT session, src, a, b, n, 1 FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY n DESC, cl) AS rn FROM cc) WHERE rn = 1),
be AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY auto) AS rn FROM al QUALIFY rn = 1),
gs AS (SELECT *, a - 20 AS t0, b + 10 AS t1, CAST(90 AS DOUBLE) AS cap FROM be), {snap_sql("gs", "sn")}
SELECT session, src, t_in, t_out, n AS count, CASE WHEN auto = 0 THEN '★ ' ELSE '' END || CASE WHEN n > 5 THEN '名场面' ELSE {KILL} END || ' 完整版' AS caption FROM sn""")
def plan_single_best(spark, sf):
    p, f = picks(spark, sf)
    return edl.single_best(pool(spark, sf), T.sentences(spark, sf), p, f).select("session", "src", "t_in", "t_out", "count", "caption")


#: Greedy picks, one after the other: a pickup is taken if none within 30 s is.
GREEDY = """ro AS (SELECT *, row_number() OVER (PARTITION BY session, src ORDER BY worth, t_start, part_dir, line_no) AS rn FROM vl),
gr(session, src, rn, taken, ok) AS (
  SELECT DISTINCT session, src, CAST(0 AS BIGINT), CAST([] AS DOUBLE[]), false FROM ro
  UNION ALL SELECT r.session, r.src, r.rn, CASE WHEN near THEN taken ELSE list_append(taken, r.t_start) END, NOT near
  FROM (SELECT g.taken, ro.*, len(list_filter(g.taken, lambda x: abs(x - ro.t_start) < 30)) > 0 AS near FROM gr g JOIN ro ON ro.session = g.session AND ro.src = g.src AND ro.rn = g.rn + 1) r),
kp AS (SELECT ro.* FROM ro JOIN gr ON gr.session = ro.session AND gr.src = ro.src AND gr.rn = ro.rn WHERE gr.ok)"""


@query("plan_loot_run", f"""WITH RECURSIVE {T.TL}, {LOOTS}, {T.SE}, {GREEDY}, gs AS (
  SELECT session, src, t_start - 6 AS t0, t_end + 8 AS t1, CAST(12 AS DOUBLE) AS cap, 'loot' AS kind, price, {LCAP} AS caption,
    CASE WHEN worth <> 0 THEN '+' || CAST(round_even(worth / 10000, 0) AS BIGINT) || '万 ' ELSE '' END || coalesce(substr(hint, 1, 8), '高价值') AS price_tag,
    row_number() OVER (PARTITION BY session ORDER BY worth, t_start, part_dir, line_no) AS seg FROM kp
  UNION ALL SELECT session, src, t_start - 8, t_end + 6, 16, 'extract', NULL, '撤离成功！', NULL, 1 + (SELECT count(*) FROM kp WHERE kp.session = le.session) FROM le WHERE rn = 1),
{snap_sql("gs", "sn")},
cd AS (SELECT session, sum(worth) AS total FROM kp GROUP BY 1 HAVING sum(worth) > 0)
SELECT session, seg, src, t_in, t_out, kind, price, caption, price_tag, NULL::VARCHAR AS card, NULL::BIGINT AS price_total FROM sn
UNION ALL SELECT session, 1 + (SELECT count(*) FROM gs WHERE gs.session = cd.session), NULL, NULL, NULL, NULL, NULL, '本场搬砖合计 ≈ ' || CAST(round_even(total / 10000, 0) AS BIGINT) || '万哈夫币', NULL, 'profit', CAST(total AS BIGINT) FROM cd""")
def plan_loot_run(spark, sf):
    r = edl.loot_run(pool(spark, sf), T.sentences(spark, sf))
    return r.select("session", "seg", "src", "t_in", "t_out", "kind", "price", "caption", "price_tag", "card", "price_total")


@query("valued_loots", f"WITH {T.TL}, {LOOTS} SELECT line_no, worth FROM vl")
def valued_loots(spark, sf):
    return edl.valued_loots(pool(spark, sf)).select("line_no", F.coalesce("price", F.lit(0)).alias("worth"))


@query("last_success", f"WITH {T.TL}, {LOOTS} SELECT session, src, t_start, t_end FROM le WHERE rn = 1")
def last_success(spark, sf):
    return edl.last_in_pool(pool(spark, sf), edl.succeeded()).select("session", "src", "t_start", "t_end")


@query("snapped_windows", f"""WITH {T.TL}, {T.SE}, gs AS (SELECT session, line_no AS seg, src, t_start - 6 AS t0, t_end + 8 AS t1, CAST(14 AS DOUBLE) AS cap FROM tl), {snap_sql("gs", "sn")}
SELECT seg, t_in, t_out FROM sn""")
def snapped_windows(spark, sf):
    """Every event as a window of its own, fitted to the sentences of its source."""
    e = pool(spark, sf).select(
        "session", F.col("line_no").alias("seg"), "src", (F.col("t_start") - 6).alias("t0"), (F.col("t_end") + 8).alias("t1"), F.lit(14.0).alias("cap")
    )
    return edl.snap_windows(e, T.sentences(spark, sf)).select("seg", "t_in", "t_out")


def diffs(spark, sf):
    """Frame differences every tenth of a second, four to an event, around its start."""
    e = pool(spark, sf).select("src", "t_start", "line_no")
    i = F.explode(F.sequence(F.lit(0), F.lit(3)))
    return e.withColumn("i", i).select("src", (F.col("t_start") + (F.col("i") - 1) * 0.5).alias("t"), ((F.col("line_no") * 7 + F.col("i") * 13) % 17).cast("double").alias("diff"))


@query("shot_snapped", f"""WITH {T.TL}, {T.SE}, df AS (SELECT src, t_start + (i - 1) * CAST(0.5 AS DOUBLE) AS dt, CAST((line_no * 7 + i * 13) % 17 AS DOUBLE) AS diff FROM (SELECT src, t_start, line_no, unnest(range(4)) AS i FROM tl)),
g AS (SELECT l.line_no, l.src, l.session, l.t_start AS t, (SELECT max(s."end") FROM se s WHERE s.session = l.session AND s.src = l.src AND s."end" <= l.t_start + 1e-6) AS pe,
  (SELECT min(s.start) FROM se s WHERE s.session = l.session AND s.src = l.src AND s.start >= l.t_start - 1e-6) AS ns,
  EXISTS (SELECT 1 FROM se s WHERE s.session = l.session AND s.src = l.src) AS talk FROM tl l WHERE l.kind = 'loot'),
iv AS (SELECT *, greatest(t - CAST(1.2 AS DOUBLE), CASE WHEN talk THEN coalesce(pe, 0) ELSE t - CAST(1.2 AS DOUBLE) END) AS lo, least(t + CAST(1.2 AS DOUBLE), coalesce(ns, t + CAST(1.2 AS DOUBLE))) AS hi FROM g),
sn AS (SELECT iv.line_no, iv.t, d.dt, d.diff FROM iv JOIN df d ON d.src = iv.src AND d.dt BETWEEN iv.lo AND iv.hi WHERE iv.hi - iv.lo >= CAST(0.1 AS DOUBLE)),
br AS (SELECT line_no, count(*) AS n, greatest(quantile_cont(diff, 0.5) * 3, 2) AS bar FROM sn GROUP BY 1),
bs AS (SELECT sn.line_no, min((abs(dt - t), dt)) AS c FROM sn JOIN br USING (line_no) WHERE n >= 2 AND diff > bar GROUP BY 1)
SELECT iv.line_no, round(coalesce(bs.c[2], iv.t), 2) AS t FROM iv LEFT JOIN bs USING (line_no)""")
def shot_snapped(spark, sf):
    e = pool(spark, sf).where(F.col("kind") == "loot").select("session", F.col("line_no").alias("seg"), "src", F.col("t_start").alias("t"))
    return edl.snap_to_shots(e, diffs(spark, sf), T.sentences(spark, sf), "t", width=120.0).select(F.col("seg").alias("line_no"), F.round("t", 2).alias("t"))


@query("pool_stats", f"WITH {T.TL} SELECT session, count(*) FILTER (kind = 'down') AS n_down, count(*) FILTER (kind = 'extract' AND ok) AS n_extract_ok, count(*) AS n_events FROM tl GROUP BY 1")
def pool_stats(spark, sf):
    return edl.pool_stats(pool(spark, sf))


@query("publish_vars")
def publish_vars(spark, sf):
    p = pool(spark, sf)
    return edl.publish_vars(edl.fast_cut(p, T.sentences(spark, sf)), edl.pool_stats(p))


@query("cut_seconds", f"""WITH {CL}, k2 AS (SELECT * FROM cc WHERE n >= 2) SELECT session, count(*) AS n FROM k2 GROUP BY 1""")
def cut_seconds(spark, sf):
    """Length of the multi-kill cut; the SQL side checks which sessions have one and its segments."""
    m = cut_lineage(edl.multi_kill(pool(spark, sf), width=120.0))
    s = edl.cut_seconds(m).where(F.col("seconds") > 0)
    return m.groupBy("session").agg(F.count("*").alias("n")).join(s, "session").select("session", "n")


@query("event_summary", f"WITH {T.TL} SELECT kind, count(*) AS n, CAST(sum(CASE WHEN kind = 'loot' THEN coalesce(price, 0) ELSE 0 END) AS BIGINT) AS price_total FROM tl GROUP BY 1")
def event_summary(spark, sf):
    from cuespan.plans.detect import summarize

    return summarize(pool(spark, sf))
