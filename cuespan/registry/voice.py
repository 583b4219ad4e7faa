"""Voice signals, hype, candidates, scores, speakers."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuespan.plans import speakers, voice
from cuespan.registry import tables as T
from cuespan.registry.book import query
from cuespan.session import cut_lineage

_EMO = "(length(text) - length(replace(text, '卧槽', ''))) // 2 + CASE WHEN contains(text, '牛牛') THEN 1 ELSE 0 END"
HOST = f"""{T.AU}, hs AS (SELECT *, length(replace(text, ' ', '')) AS c, {_EMO} AS emo,
  CASE WHEN contains(text, '啊啊啊啊') THEN 2 ELSE 0 END + CASE WHEN contains(text, '牛牛') THEN 1 ELSE 0 END AS rep FROM se WHERE coalesce(speaker, 'host') = 'host')"""

CHARS = HOST + """, cx AS (SELECT hs.*, CAST(floor(duration_s / 0.5) AS BIGINT) + 1 AS nb FROM hs JOIN du USING (session, src)),
ci AS (SELECT *, greatest(0, CAST(floor(start / 0.5) AS BIGINT)) AS i0, least(nb, greatest(CAST(floor(start / 0.5) AS BIGINT) + 1, CAST(ceil("end" / 0.5) AS BIGINT))) AS i1 FROM cx WHERE c > 0),
cs AS (SELECT session, src, bin, sum(chars) AS chars, sum(emo) AS emo, sum(rep) AS rep FROM (
  SELECT session, src, unnest(range(i0, i1)) AS bin, c / CAST(i1 - i0 AS DOUBLE) AS chars, 0 AS emo, 0 AS rep FROM ci
  UNION ALL SELECT session, src, least(nb - 1, CAST(floor((start + "end") / 2 / 0.5) AS BIGINT)), 0, emo, rep FROM ci) GROUP BY 1, 2, 3)"""

WINS = CHARS + """, hb AS (SELECT DISTINCT session, src, unnest(range(CAST(floor(start / 0.25) AS BIGINT), CAST(floor("end" / 0.25) AS BIGINT) + 1)) AS bin FROM hs),
rb AS (SELECT au.session, au.src, quantile_cont(rms, 0.5) AS p50, quantile_cont(rms, 0.4) AS p40, quantile_cont(rms, 0.85) AS p85 FROM au JOIN hb USING (session, src, bin) GROUP BY 1, 2),
rr AS (SELECT session, src, quantile_cont(c / greatest(0.5, "end" - start), 0.5) AS rate_med FROM hs WHERE "end" - start >= 1 GROUP BY 1, 2),
ba AS (SELECT du.session, du.src, duration_s, coalesce(p40, 1e-6) AS p40, coalesce(p50, 1e-6) AS p50, coalesce(p85, 1e-6) AS p85, coalesce(rate_med, 3) AS rate_med,
  (SELECT max(bin) FROM au WHERE au.session = du.session AND au.src = du.src) AS mb FROM du LEFT JOIN rb USING (session, src) LEFT JOIN rr USING (session, src)),
wi AS (SELECT ba.*, unnest(range(CAST(floor((floor(duration_s / 0.5) + 1 - 16) / 4) AS BIGINT) + 1)) AS win FROM ba WHERE floor(duration_s / 0.5) + 1 >= 16),
wb AS (SELECT wi.session, wi.src, wi.win, au.bin, au.rms, hb.bin IS NOT NULL AS host, au.bin < wi.win * 8 AS ahead FROM wi JOIN au ON au.session = wi.session AND au.src = wi.src
  AND au.bin >= wi.win * 8 - 8 AND au.bin < wi.win * 8 + 32 LEFT JOIN hb ON hb.session = au.session AND hb.src = au.src AND hb.bin = au.bin),
wa AS (SELECT session, src, win, count(*) FILTER (host AND NOT ahead) AS nh, count(*) FILTER (NOT ahead) AS nm, quantile_cont(rms, 0.5) FILTER (host AND NOT ahead) AS med,
  quantile_cont(rms, 0.95) FILTER (host AND NOT ahead) AS p95, max(rms) FILTER (host AND NOT ahead) AS top, quantile_cont(rms, 0.5) FILTER (ahead) AS pre FROM wb GROUP BY 1, 2, 3),
wc AS (SELECT wi.session, wi.src, wi.win, sum(chars) AS chars, sum(emo) AS emo, sum(rep) AS rep FROM wi JOIN cs ON cs.session = wi.session AND cs.src = wi.src
  AND cs.bin >= wi.win * 4 AND cs.bin < wi.win * 4 + 16 GROUP BY 1, 2, 3),
wf AS (SELECT wi.session, wi.src, wi.win, wi.win * 2 + 4 AS t, coalesce(nh / CAST(nullif(nm, 0) AS DOUBLE), 0) AS hf, p50, rate_med, med, p95, top, pre, coalesce(chars, 0) AS chars, emo, rep
  FROM wi LEFT JOIN wa USING (session, src, win) LEFT JOIN wc USING (session, src, win)),
ws AS (SELECT session, src, win, t, hf, CASE WHEN hf > 0.5 AND med > p50 * 0.4 THEN p95 / p50 ELSE 0 END AS vol,
  CASE WHEN hf > 0.5 AND med > p50 * 0.4 THEN top / greatest(coalesce(pre, p50), 0.3 * p50) ELSE 0 END AS burst,
  CASE WHEN chars > 0 THEN chars / 8 / rate_med ELSE 0 END AS spd, CASE WHEN chars > 0 THEN emo * 7.5 ELSE 0 END AS emo_pm, CASE WHEN chars > 0 THEN rep * 7.5 ELSE 0 END AS rep_pm FROM wf)"""


def inputs(spark, sf):
    return T.sentences(spark, sf), T.audio(spark, sf), T.durations(spark, sf)


def windows(spark, sf):
    s, a, d = inputs(spark, sf)
    host = voice.host_rows(s)
    base = cut_lineage(voice.session_base(a, host))
    return voice.window_signals(a, voice.char_bins(host, d), host, d, base)


@query("char_bins", f"WITH {CHARS} SELECT src, bin, round(chars, 6) AS chars, CAST(emo AS BIGINT) AS emo, CAST(rep AS BIGINT) AS rep FROM cs")
def char_bins(spark, sf):
    s = T.sentences(spark, sf)
    c = voice.char_bins(voice.host_rows(s), T.durations(spark, sf))
    return c.select("src", "bin", F.round("chars", 6).alias("chars"), "emo", "rep")


@query("rms_bins", """SELECT user_id AS src, i // 4 AS bin, round(sqrt(avg(value * value)), 6) AS rms FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events)
GROUP BY 1, 2 HAVING count(*) = 4""")
def rms_bins(spark, sf):
    from cuespan.operators.ordered import lane, number_rows

    e = T.table(spark, sf, "events").select(F.col("user_id").alias("src"), F.lit("s").alias("session"), F.col("value").alias("x"), "event_id")
    e = number_rows(e, lane("src", ("event_id",), 4096.0), "i").withColumn("i", F.col("i") - 1)
    return voice.rms_bins(e, 4, 4000).select("src", "bin", F.round("rms", 6).alias("rms"))


@query("session_base", f"WITH {WINS} SELECT src, round(p40, 6) AS p40, round(p50, 6) AS p50, round(p85, 6) AS p85, round(rate_med, 6) AS rate_med FROM ba")
def session_base(spark, sf):
    s, a, _ = inputs(spark, sf)
    b = voice.session_base(a, voice.host_rows(s))
    return b.select("src", *[F.round(c, 6).alias(c) for c in ("p40", "p50", "p85", "rate_med")])


@query("window_signals", f"""WITH {WINS} SELECT src, win, round(hf + 1e-7, 5) AS host_frac, round(vol + 1e-7, 5) AS vol, round(burst + 1e-7, 5) AS burst, round(spd + 1e-7, 5) AS spd, round(emo_pm + 1e-7, 5) AS emo_pm, round(rep_pm + 1e-7, 5) AS rep_pm FROM ws""")
def window_signals(spark, sf):
    w = windows(spark, sf)
    return w.select("src", "win", *[F.round(F.col(c) + 1e-7, 5).alias(c) for c in ("host_frac", "vol", "burst", "spd", "emo_pm", "rep_pm")])


def _rank(c):
    return f"(SELECT count(*) FILTER (r.{c} < w.{c}) / CAST(count(*) AS DOUBLE) FROM rf r WHERE r.session = w.session AND r.src = w.src)"


@query("window_hype", f"""WITH {WINS}, rf AS (SELECT * FROM (SELECT session, src, hf, round(vol, 9) AS vol, round(burst, 9) AS burst, round(spd, 9) AS spd, emo_pm, rep_pm, win FROM ws) WHERE hf > 0.5),
w AS (SELECT session, src, hf, win, round(vol, 9) AS vol, round(burst, 9) AS burst, round(spd, 9) AS spd, emo_pm, rep_pm FROM ws)
SELECT src, win, round(CASE WHEN hf > 0.5 THEN 0.35 * {_rank("vol")} + 0.15 * {_rank("burst")} + 0.2 * {_rank("spd")} + 0.2 * {_rank("emo_pm")} + 0.1 * {_rank("rep_pm")} ELSE 0.3 END + 1e-7, 5) AS hype FROM w""")
def window_hype(spark, sf):
    w = windows(spark, sf)
    w = cut_lineage(w.select(*[F.round(c, 9).alias(c) if c in ("vol", "burst", "spd") else F.col(c) for c in w.columns]))
    return voice.hype(w).select("src", "win", F.round(F.col("hype") + 1e-7, 5).alias("hype"))


@query("voice_segments")
def voice_segments(spark, sf):
    s, _, _ = inputs(spark, sf)
    hyped = cut_lineage(voice.hype(cut_lineage(windows(spark, sf))))
    return voice.pick_segments(hyped, voice.host_rows(s), 120.0)


@query("voice_clips")
def voice_clips(spark, sf):
    s, a, d = inputs(spark, sf)
    return voice.voice_clips(s, a, d, width=120.0).drop("evidence", "words", "cut")


@query("talk_chains", f"""WITH {T.SE}, c AS (SELECT *, sum(CASE WHEN start - p <= 1.2 THEN 0 ELSE 1 END) OVER (PARTITION BY src ORDER BY id ROWS UNBOUNDED PRECEDING) AS g FROM (
  SELECT *, lag("end") OVER (PARTITION BY src ORDER BY start, id) AS p FROM se))
SELECT src, round(max(s), 5) AS dense FROM (SELECT src, g, sum("end" - start) AS s FROM c GROUP BY 1, 2) GROUP BY 1""")
def talk_chains(spark, sf):
    d = voice.talk_chains(T.sentences(spark, sf), ("session", "src"), width=60.0)
    return d.select("src", F.round("dense_sec", 5).alias("dense"))


@query("scored_orders", """WITH c AS (SELECT o_orderkey, o_custkey, o_totalprice AS v, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey % 101 AS DOUBLE) END AS b FROM orders),
r AS (SELECT *, (SELECT count(*) FILTER (x.v < c.v) / CAST(count(*) AS DOUBLE) FROM c x WHERE x.o_custkey = c.o_custkey) AS rv,
  CASE WHEN b IS NULL THEN 0.5 ELSE (SELECT count(*) FILTER (x.b < c.b) / CAST(count(x.b) AS DOUBLE) FROM c x WHERE x.o_custkey = c.o_custkey) END AS rb FROM c),
d AS (SELECT *, round_even(greatest(0.3, least(1, rv)), 3) AS dv, round_even(greatest(0.3, least(1, rb)), 3) AS db FROM r),
t AS (SELECT *, (0.3 * (dv + db) / 2 + 0.25 * 0.5 + 0.2 * 0.5 + 0.25 * 0.5) * 100 AS total FROM d)
SELECT o_orderkey, round(total, 4) AS total, CASE WHEN total >= 78 THEN 'S' WHEN total >= 64 THEN 'A' WHEN total >= 48 THEN 'B' ELSE 'C' END AS grade FROM t""")
def scored_orders(spark, sf):
    """Dimension ranks, group weights and grades over orders as candidates of their customers."""
    o = T.table(spark, sf, "orders")
    none = F.lit(None).cast("double")
    c = o.select(
        "o_custkey", "o_orderkey", F.col("o_totalprice").alias("peak_ratio"), F.when(F.col("o_orderkey") % 7 != 0, (F.col("o_orderkey") % 101).cast("double")).alias("burst"),
        *[none.alias(x) for x in ("pitch_up", "shout", "rate", "dense_sec", "emo_pm", "rep_pm")],
    )
    s = voice.score_segments(c, ("o_custkey",), "o_orderkey")
    return s.select("o_orderkey", F.round("total", 4).alias("total"), "grade")


@query("score_top", """SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3""")
def score_top(spark, sf):
    from cuespan.operators.intervals import first_k

    return first_k(T.table(spark, sf, "orders"), ["o_custkey"], [F.col("o_totalprice").desc(), "o_orderkey"], 3).select("o_custkey", "o_orderkey")


@query("review_filter", """SELECT o_custkey AS session, o_orderkey AS seg, o_totalprice AS score FROM orders WHERE o_totalprice >= 100000 AND o_orderstatus IN ('F', 'O')""")
def review_filter(spark, sf):
    o = T.table(spark, sf, "orders").select(F.col("o_custkey").alias("session"), F.col("o_orderkey").alias("seg"), F.col("o_totalprice").alias("score"), F.col("o_orderstatus").alias("grade"))
    return voice.review(o, 100000.0, ["F", "O"]).drop("grade")


@query("pitch_baseline")
def pitch_baseline(spark, sf):
    s, a, d = inputs(spark, sf)
    host = voice.host_rows(s)
    base = cut_lineage(voice.session_base(a, host))
    w = cut_lineage(voice.window_signals(a, voice.char_bins(host, d), host, d, base))
    return voice.f0_baseline(w, a, base)


def linkage_sql(vectors: str) -> str:
    """CTEs that merge the nearest pair of every group, one pair a step; ``vectors`` gives (grp, id, v)."""
    return f"""u AS (SELECT grp, id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM ({vectors})),
st(step, grp, cid, n, sm, members) AS (
  SELECT 0, grp, id, 1, v, [id] FROM u
  UNION ALL
  (WITH pr AS (SELECT a.grp, a.cid AS x, b.cid AS y, round(1 - list_inner_product(a.sm, b.sm) / (a.n * b.n), 12) AS d FROM st a JOIN st b ON a.grp = b.grp AND a.cid < b.cid),
   bp AS (SELECT grp, arg_min({{'x': x, 'y': y}}, {{'d': d, 'x': x, 'y': y}}) AS p FROM pr WHERE d < 0.65 GROUP BY grp)
   SELECT a.step + 1, a.grp, a.cid, CASE WHEN a.cid = p.x THEN a.n + b.n ELSE a.n END, CASE WHEN a.cid = p.x THEN list_transform(list_zip(a.sm, b.sm), lambda z: z[1] + z[2]) ELSE a.sm END,
     CASE WHEN a.cid = p.x THEN list_concat(a.members, b.members) ELSE a.members END
   FROM st a JOIN bp ON bp.grp = a.grp LEFT JOIN st b ON b.grp = a.grp AND b.cid = p.y AND a.cid = p.x WHERE a.cid <> p.y)),
la AS (SELECT *, max(step) OVER (PARTITION BY grp) AS top FROM st),
ac AS (SELECT grp, unnest(members) AS id, cid AS cluster FROM la WHERE step = top)"""


@query("speaker_clusters", f"""WITH RECURSIVE {linkage_sql("SELECT label AS grp, vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings")} SELECT grp, id, cluster FROM ac""")
def speaker_clusters(spark, sf):
    e = T.table(spark, sf, "embeddings").select(F.col("label").alias("grp"), F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return speakers.cluster(e, 0.65)


@query("dominant_label", """SELECT src, label, weight FROM (SELECT vec_id % 40 AS src, label, CAST(sum(vec_id % 9 + 1) AS BIGINT) AS weight,
  row_number() OVER (PARTITION BY vec_id % 40 ORDER BY sum(vec_id % 9 + 1) DESC, label) AS rn FROM embeddings GROUP BY 1, 2) WHERE rn = 1""")
def dominant_label(spark, sf):
    e = T.table(spark, sf, "embeddings").select((F.col("vec_id") % 40).alias("src"), "label", (F.col("vec_id") % 9 + 1).alias("sec"))
    return speakers.dominant(e, ["src"], "label", "sec")


PRINTS = """SELECT session || chr(1) || src AS grp, CAST(id AS BIGINT) AS id, CAST(embedding AS DOUBLE[]) AS v FROM se
  JOIN embeddings ON vec_id = (CAST(substr(src, 2) AS BIGINT) * 7 + id) % (SELECT count(*) FROM embeddings) WHERE "end" - start >= 1.5"""


@query("labelled_speakers", f"""WITH RECURSIVE {T.SE}, {linkage_sql(PRINTS)},
sp AS (SELECT ac.*, "end" - start AS sec, count(*) OVER (PARTITION BY ac.grp) AS many FROM ac JOIN se ON ac.grp = session || chr(1) || src AND ac.id = se.id),
ho AS (SELECT grp, cluster AS host FROM sp WHERE many >= 2 GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY grp ORDER BY round(sum(sec), 6) DESC, cluster) = 1),
mk AS (SELECT sp.grp, sp.id, CASE WHEN cluster = host THEN 'host' ELSE 'other' END AS mark FROM sp JOIN ho ON ho.grp = sp.grp)
SELECT session, src, se.id, start, "end", text, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY session, src ORDER BY se.id ROWS UNBOUNDED PRECEDING), 'host') AS speaker
FROM se LEFT JOIN mk ON mk.grp = session || chr(1) || src AND mk.id = se.id""")
def labelled_speakers(spark, sf):
    s = T.sentences(spark, sf)
    v = T.table(spark, sf, "embeddings").select(F.col("vec_id"), "embedding")
    n = v.count()  # ids are 0 to n - 1
    rows = s.withColumn("vec_id", (F.expr("cast(substring(src, 2) as bigint)") * 7 + F.col("id")) % n).join(v, "vec_id")
    return speakers.label_speakers(s, rows.select("session", "src", "id", "embedding"))


@query("speaker_seconds", f"""WITH {T.SE} SELECT src, coalesce(sum(CASE WHEN speaker = 'host' THEN floor("end") - floor(start) ELSE 0 END), 0) AS host_sec, coalesce(sum(CASE WHEN speaker = 'other' THEN floor("end") - floor(start) ELSE 0 END), 0) AS other_sec FROM se GROUP BY 1""")
def speaker_seconds(spark, sf):
    s = T.sentences(spark, sf)
    return speakers.speaker_seconds(s.withColumn("end", F.floor("end") + 0.0).withColumn("start", F.floor("start") + 0.0)).select("src", "host_sec", "other_sec")
