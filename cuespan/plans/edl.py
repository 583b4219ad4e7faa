"""Edit decision lists: seven templates over the event pool, sentence and shot snapping.

All of them partition by session. The pool needs session, src, part_dir, line_no, kind, t_start,
t_end, detail, price, voice_hint. Only ranked clusters (a few rows per session) reach the sorting
and snapping steps.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuespan import constants as K
from cuespan.functions import clock
from cuespan.functions import text as tx
from cuespan.operators.intervals import first_k, stab
from cuespan.operators.greedy import keep_apart
from cuespan.operators.ordered import asof, has_within, lane, number_rows, scan
from cuespan.plans.matches import span_numbers
from cuespan.session import cut_lineage

PART = ("session", "src")
CHUNK = 3600.0
S = ["session"]


def clusters(pool: DataFrame, kind: str = "down", gap: float = 15.0, width: float = CHUNK) -> DataFrame:
    """Runs of one kind in session order by relative time; another source breaks a run.

    Returns (session, cl, src, t_first, t_last, n), ``cl`` numbering the runs in time order.
    """
    out = cluster_rows(pool, kind, gap, width).groupBy("session", "cl").agg(
        F.min("src").alias("src"), F.min("t_start").alias("t_first"),
        F.max("t_start").alias("t_last"), F.count("*").alias("n"),
    )
    # one row per cluster, ranked and joined several times by the templates
    return cut_lineage(out)


def cluster_rows(pool: DataFrame, kind: str, gap: float, width: float = CHUNK) -> DataFrame:
    rows = pool.where(F.col("kind") == kind).select(*PART, "t_start", "part_dir", "line_no")
    ln = lane(S, ("t_start", "part_dir", "line_no"), width)
    rows = scan(rows, ln, prev={"__ps": F.col("src"), "__pt": F.col("t_start")})
    rows = cut_lineage(rows)
    opens = F.when(
        F.col("__ps").isNull()
        | (F.col("__ps") != F.col("src"))
        | (F.col("t_start") - F.col("__pt") > gap),
        1,
    ).otherwise(0)
    rows = rows.withColumn("__o", opens).drop("__ps", "__pt")
    return scan(rows, ln, running={"cl": F.col("__o").cast("long")}).drop("__o")


def biggest(cl: DataFrame, k: int, rank: str = "pos") -> DataFrame:
    return first_k(cl, S, [F.col("n").desc(), "cl"], k, rank)


def valued_loots(pool: DataFrame) -> DataFrame:
    """Pickups with a price or something said about them."""
    return pool.where(
        (F.col("kind") == "loot")
        & ((F.coalesce("price", F.lit(0)) != 0) | (F.coalesce(F.size("voice_hint"), F.lit(0)) > 0))
    )


def last_in_pool(pool: DataFrame, cond: Column) -> DataFrame:
    """Last matching event of a session in pool order (directory name, then line)."""
    order = F.struct("part_dir", "line_no")
    cols = ["src", "t_start", "t_end", "detail"]
    return (
        pool.where(cond)
        .groupBy(*S)
        .agg(F.max_by(F.struct(*cols), order).alias("x"))
        .select("session", "x.*")
    )


def succeeded() -> Column:
    return (F.col("kind") == "extract") & F.contains("detail", F.lit(K.SUCCESS))


def snap_windows(segs: DataFrame, sentences: DataFrame, min_len: float = 2.5) -> DataFrame:
    """Fit (session, seg, src, t0, t1, cap) to sentence boundaries; adds t_in and t_out.

    Growing to a boundary is given up where it would break the cap; an over-long window loses whole
    sentences from its end. Sources without sentences keep their times.
    """
    key = ["session", "seg"]
    segs = cut_lineage(segs)  # read five times below
    talk = sentences.select(
        *PART, F.col("id").alias("sid"), F.col("start").alias("sa"), F.col("end").alias("sb")
    )
    ends = segs.select(*key, "src", F.col("t0").alias("at"), F.lit(0).alias("w")).unionByName(
        segs.select(*key, "src", F.col("t1").alias("at"), F.lit(1).alias("w"))
    )
    held = (
        stab(ends, talk, PART, "at", "sa", "sb", 30.0, open_hi=True)
        .groupBy(*key)
        .agg(
            F.min_by("sa", F.when(F.col("w") == 0, F.col("sid"))).alias("s0"),
            F.min_by("sb", F.when(F.col("w") == 1, F.col("sid"))).alias("s1"),
        )
    )
    spoken = talk.select(*PART).distinct().withColumn("talk", F.lit(True))
    rows = segs.join(held, key, "left").join(spoken, list(PART), "left")
    s0 = F.when(F.coalesce("s1", "t1") - F.col("s0") <= F.col("cap"), F.col("s0"))
    rows = rows.withColumn("s0", s0)
    s1 = F.when(F.col("s1") - F.coalesce("s0", "t0") <= F.col("cap"), F.col("s1"))
    rows = rows.withColumn("s1", s1)
    rows = rows.withColumn("a", F.coalesce("s0", F.greatest(F.lit(0.0), "t0"))).withColumn(
        "b", F.coalesce("s1", "t1")
    )
    rows = cut_lineage(rows.withColumn("lim", F.col("a") + F.col("cap")))
    inside = (
        stab(talk, rows.where(F.col("b") - F.col("a") > F.col("cap")).select(*key, "src", "a", "lim"),
             PART, "sa", "a", "lim", 30.0)
        .where(F.col("sb") <= F.col("lim"))
        .groupBy(*key)
        .agg(F.max_by("sb", "sid").alias("fit"))
    )
    rows = rows.join(inside, key, "left")
    over = F.col("b") - F.col("a") > F.col("cap")
    b = F.when(over, F.coalesce("fit", "b")).otherwise(F.col("b"))
    rows = rows.withColumn("b", b)
    rows = rows.withColumn("b", F.least("b", "lim"))
    rows = rows.withColumn("b", F.greatest("b", F.col("a") + min_len))
    return rows.select(
        *segs.columns, F.bround("a", 2).alias("t_in"), F.bround("b", 2).alias("t_out")
    )


EDL = {
    "src": "string", "t0": "double", "t1": "double", "cap": "double", "kind": "string",
    "count": "bigint", "price": "bigint", "caption": "string", "price_tag": "string",
    "counter": "bigint", "card": "string", "price_total": "bigint", "ins": "bigint",
}


def _segs(df: DataFrame, **cols: Column) -> DataFrame:
    return df.select(
        "session",
        *[cols.get(c, F.lit(None)).cast(t).alias(c) for c, t in EDL.items()],
    )


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _numbered(rows: DataFrame, *order) -> DataFrame:
    """``seg`` = position inside the session; only ranked rows get here, a few per session."""
    return rows.withColumn("seg", F.row_number().over(W.partitionBy("session").orderBy(*order)))


def kill_caption(n: Column) -> Column:
    return F.concat(tx.kill_word(n), F.lit("！"))


def _loot_segs(loots: DataFrame, cap: float, ins: Column, caption: Column | None = None) -> DataFrame:
    cap_text = tx.loot_caption(F.col("price"))
    hint = F.when(
        F.coalesce(F.size("voice_hint"), F.lit(0)) > 0,
        F.substring(F.get("voice_hint", F.lit(0)), 1, 8),
    ).otherwise("高价值")
    tag = F.when(
        F.coalesce("price", F.lit(0)) != 0, F.concat(tx.wan_tag(F.col("price")), F.lit(" "), hint)
    ).otherwise(hint)
    return _segs(
        loots, src=F.col("src"), t0=F.col("t_start") - 6, t1=F.col("t_end") + 8, cap=F.lit(cap),
        kind=F.lit("loot"), count=F.lit(1), price=F.col("price"),
        caption=cap_text if caption is None else caption, price_tag=tag, ins=ins,
    )


def fast_cut(pool: DataFrame, sentences: DataFrame, count: int = 5) -> DataFrame:
    """Top clusters, top pickups and the last success, short first, the strongest kill in front."""
    kills = biggest(clusters(pool), 2)
    t0, t1 = F.col("t_first") - 6, F.col("t_last") + 5
    kill = _segs(
        kills, src=F.col("src"), t0=t0, t1=t1,
        cap=F.least(F.lit(15.0), F.greatest(F.lit(10.0), t1 - t0)), kind=F.lit("kill"),
        count=F.col("n"), caption=kill_caption(F.col("n")), ins=F.col("pos"),
    )
    loots = first_k(
        valued_loots(pool), S,
        [F.coalesce("price", F.lit(0)).desc(), "part_dir", "line_no"], 2, "pos",
    )
    loot = _loot_segs(loots, 14.0, F.col("pos") + 10).withColumn("price_tag", F.lit(None).cast("string"))
    ext = last_in_pool(pool, succeeded())
    out = _segs(
        ext, src=F.col("src"), t0=F.col("t_start") - 8, t1=F.col("t_end") + 6, cap=F.lit(14.0),
        kind=F.lit("extract"), count=F.lit(1), caption=F.lit("安全撤离！"), ins=F.lit(20),
    )
    rows = snap_windows(_numbered(_union([kill, loot, out]), "ins"), sentences)
    length = F.col("t_out") - F.col("t_in")
    by_strength = W.partitionBy("session", F.col("kind") == "kill").orderBy(
        F.col("count").desc(), length, "ins"
    )
    rows = rows.withColumn(
        "hook", F.when((F.col("kind") == "kill") & (F.row_number().over(by_strength) == 1), 0).otherwise(1)
    ).drop("seg")
    return _numbered(rows, "hook", length, "ins").where(F.col("seg") <= count)


def labelled(labels: DataFrame, clips: DataFrame, parts: DataFrame) -> DataFrame:
    """Labels joined to their clips and to the source that holds them.

    The source is the first part of the session whose name contains the session and carries the
    clip's part number.
    """
    clip = clips.select(
        "session", "file", "part", F.transform("events", lambda e: e.getField("t")).alias("ts")
    )
    rows = labels.join(clip, ["session", "file"]).where(F.size("ts") > 0)
    named = parts.select(
        "session", F.col("src").alias("src"), "part_seq", "filename",
        clock.part_no(F.col("filename")).alias("part"),
    ).where(F.contains(F.col("filename"), F.col("session")))
    src = named.groupBy("session", "part").agg(F.min_by("src", "part_seq").alias("src"))
    return rows.join(src, ["session", "part"])


def picks_of(lab: DataFrame) -> DataFrame:
    """Hand-picked clips per session, scored ones first, best first."""
    return lab.where(
        F.coalesce("picked", F.lit(False))
        & (F.coalesce("verdict", F.lit("")) != "false_positive")
    ).select(
        "session", "src", F.get("ts", F.lit(0)).alias("t_first"),
        F.element_at("ts", -1).alias("t_last"), F.size("ts").cast("long").alias("n"), "file",
        F.col("score_override").alias("pick_score"),
    )


def pick_order() -> list[Column]:
    return [F.col("pick_score").desc_nulls_last(), F.col("file").asc()]


def false_times(lab: DataFrame) -> DataFrame:
    return lab.where(F.col("verdict") == "false_positive").select(
        "session", "src", F.explode("ts").alias("fp_t")
    )


def drop_false(pool: DataFrame, fps: DataFrame, radius: float = 5.0, width: float = CHUNK) -> DataFrame:
    """Events of any kind without a false-positive mark within 5 s on their source."""
    rows = pool.withColumn("__lo", F.col("t_start") - radius).withColumn(
        "__hi", F.col("t_start") + radius
    )
    out = has_within(rows, fps, list(PART), "__lo", "__hi", "fp_t", width, name="__fp")
    return cut_lineage(out.where(~F.col("__fp")).drop("__lo", "__hi", "__fp"))


def merge_picked(picks: DataFrame, cl: DataFrame, count: int, radius: float = 45.0) -> DataFrame:
    """Picks first, then clusters that start less than 45 s from no pick of their source."""
    mine = first_k(picks, S, pick_order(), count, "pos").select(
        "session", "src", "t_first", "t_last", "n", F.lit(0).alias("auto"),
        F.col("pos").cast("long").alias("pos"), F.lit(True).alias("picked"),
    )
    marks = picks.select(*PART, F.col("t_first").alias("pick_t"))
    wide = asof(cl, marks, list(PART), "t_first", "pick_t", [], CHUNK, name="__b")
    wide = asof(wide, marks, list(PART), "t_first", "pick_t", [], CHUNK, name="__a", forward=True)
    near = F.least(F.col("t_first") - F.col("__b.pick_t"), F.col("__a.pick_t") - F.col("t_first"))
    free = wide.where(~F.coalesce(near < radius, F.lit(False))).drop("__a", "__b")
    auto = first_k(free, S, [F.col("n").desc(), "cl"], count, "pos").select(
        "session", "src", "t_first", "t_last", "n", F.lit(1).alias("auto"),
        F.col("pos").cast("long").alias("pos"), F.lit(False).alias("picked"),
    )
    return first_k(mine.unionByName(auto), S, ["auto", "pos"], count, "top")


def zigzag(rank: Column, n: Column) -> Column:
    """Big, small, next big, next small: place of 0-based rank among n."""
    half = F.ceil(n / 2)
    return F.when(rank < half, rank * 2).otherwise((n - 1 - rank) * 2 + 1)


def hot_kills(
    pool: DataFrame, sentences: DataFrame, picks: DataFrame, fps: DataFrame, count: int = 5,
    trim: tuple[float, float] = (3.0, 8.0), pre: float = 4.0, post: float = 3.0,
) -> DataFrame:
    """Picks and biggest clusters in zig-zag order with a running kill counter."""
    top = merge_picked(picks, clusters(drop_false(pool, fps)), count)
    by_size = W.partitionBy("session").orderBy(F.col("n").desc(), "top")
    top = top.withColumn("i", F.row_number().over(by_size) - 1).withColumn(
        "of", F.count("*").over(W.partitionBy("session"))
    )
    top = top.withColumn("zig", zigzag(F.col("i"), F.col("of")))
    run = W.partitionBy("session").orderBy("zig").rowsBetween(W.unboundedPreceding, W.currentRow)
    t0, t1 = F.col("t_first") - pre, F.col("t_last") + post
    cap = F.when(F.col("n") < 3, F.lit(trim[1])).otherwise(
        F.greatest(F.lit(trim[1]), F.least(F.lit(15.0), t1 - t0))
    )
    star = F.when(F.col("picked"), "★ ").otherwise("")
    rows = _segs(
        top.withColumn("total", F.sum("n").over(run)),
        src=F.col("src"), t0=t0, t1=t1, cap=cap, kind=F.lit("kill"), count=F.col("n"),
        caption=F.concat(star, kill_caption(F.col("n"))), counter=F.col("total"), ins=F.col("zig"),
    )
    return snap_windows(_numbered(rows, "ins"), sentences)


def loot_run(pool: DataFrame, sentences: DataFrame, cap: float = 12.0) -> DataFrame:
    """Valued pickups at least 30 s apart, cheapest first, the last success and a total card."""
    loots = valued_loots(pool).select(
        *PART, "t_start", "t_end", "price", "voice_hint", "part_dir", "line_no",
        F.coalesce("price", F.lit(0)).alias("worth"),
    )
    kept = cut_lineage(
        keep_apart(loots, PART, "t_start", ["worth", "t_start", "part_dir", "line_no"], 30.0)
    )
    placed = number_rows(
        kept.withColumn("__w", F.col("worth").cast("double")),
        lane(S, ("__w", "t_start", "part_dir", "line_no"), 10000.0), "pos",
    )
    loot = _loot_segs(placed, cap, F.col("pos"))
    tail = F.lit(2**40)
    ext = last_in_pool(pool, succeeded())
    out = _segs(
        ext, src=F.col("src"), t0=F.col("t_start") - 8, t1=F.col("t_end") + 6, cap=F.lit(16.0),
        kind=F.lit("extract"), count=F.lit(1), caption=F.lit("撤离成功！"), ins=tail,
    )
    sums = kept.groupBy("session").agg(F.sum("worth").alias("sum")).where(F.col("sum") > 0)
    card = _segs(
        sums, card=F.lit("profit"), price_total=F.col("sum"), ins=tail + 1,
        caption=F.concat(F.lit("本场搬砖合计 ≈ "), tx.in_wan(F.col("sum")).cast("string"), F.lit("万哈夫币")),
    )
    rows = number_rows(
        cut_lineage(_union([loot, out, card])).withColumn("__i", F.col("ins").cast("double")),
        lane(S, ("__i",), 1024.0), "seg",
    ).drop("__i")
    rows = cut_lineage(rows)
    snapped = snap_windows(rows.where(F.col("card").isNull()), sentences)
    return snapped.unionByName(rows.where(F.col("card").isNotNull()), allowMissingColumns=True)


def _with_no(rows: DataFrame, pool: DataFrame, t: str) -> DataFrame:
    return span_numbers(pool, rows, t).withColumn(
        "no", F.coalesce(F.col("match_no").cast("string"), F.lit(""))
    )


def match_story(pool: DataFrame, sentences: DataFrame) -> DataFrame:
    """Opening, fights, finds and the end of a whole evening."""
    first = (
        pool.where(F.col("kind") == "match_start")
        .groupBy(*S)
        .agg(F.min_by(F.struct("src", "t_start"), F.struct("part_dir", "t_start", "line_no")).alias("x"))
        .select("session", "x.*")
    )
    opening = _segs(
        first, src=F.col("src"), t0=F.col("t_start"), t1=F.col("t_start") + 18, cap=F.lit(18.0),
        kind=F.lit("match"), count=F.lit(0), caption=F.lit("今晚开肝"), ins=F.lit(0),
    )
    kills = _with_no(biggest(clusters(pool), 3), pool, "t_first")
    fight = _segs(
        kills, src=F.col("src"), t0=F.col("t_first") - 6, t1=F.col("t_last") + 5, cap=F.lit(25.0),
        kind=F.lit("kill"), count=F.col("n"), ins=F.col("pos"),
        caption=F.concat(F.lit("第"), "no", F.lit("场 "), kill_caption(F.col("n"))),
    )
    loots = first_k(
        valued_loots(pool), S, [F.coalesce("price", F.lit(0)).desc(), "part_dir", "line_no"], 2, "pos"
    )
    loots = _with_no(loots, pool, "t_start")
    find = _loot_segs(
        loots, 15.0, F.col("pos") + 10,
        F.concat(F.lit("第"), "no", F.lit("场 "), tx.loot_caption(F.col("price"))),
    ).withColumn("price_tag", F.lit(None).cast("string")).withColumn("count", F.lit(0).cast("long"))
    is_ext = F.col("kind") == "extract"
    order = F.struct(F.contains("detail", F.lit(K.SUCCESS)).alias("ok"), "part_dir", "line_no")
    ext = (
        pool.where(is_ext).groupBy(*S)
        .agg(F.max_by(F.struct("src", "t_start", "t_end", "detail"), order).alias("x"))
        .select("session", "x.*")
    )
    ext = _with_no(ext, pool, "t_start")
    end = _segs(
        ext, src=F.col("src"), t0=F.col("t_start") - 8, t1=F.col("t_end") + 6, cap=F.lit(25.0),
        kind=F.lit("extract"), count=F.lit(0), ins=F.lit(20),
        caption=F.concat(F.lit("第"), "no", F.lit("场收官："), F.substring("detail", 1, 4)),
    )
    rows = snap_windows(_numbered(_union([opening, fight, find, end]), "ins"), sentences).drop("seg")
    arc = F.when(F.col("kind") == "match", 0).when(F.col("kind") == "extract", 2).otherwise(1)
    return _numbered(rows, arc, "t_in", "ins")


def category_mix(pool: DataFrame, sentences: DataFrame, count: int = 6, kind: str = "down") -> DataFrame:
    """The biggest clusters in source and time order with numbered captions; downs only."""
    if kind != "down":
        raise ValueError(f"only downs can be mixed, got {kind}")
    top = _with_no(biggest(clusters(pool), count), pool, "t_first")
    t0, t1 = F.col("t_first") - 6, F.col("t_last") + 5
    rows = _segs(
        top, src=F.col("src"), t0=t0, t1=t1, cap=F.greatest(F.lit(12.0), t1 - t0),
        kind=F.lit("kill"), count=F.col("n"), ins=F.col("pos"), caption=F.col("no"),
    )
    rows = snap_windows(_numbered(rows, "ins"), sentences).drop("seg")
    rows = _numbered(rows, "src", "t_in", "ins")
    return rows.withColumn(
        "caption",
        F.concat(F.lit("击杀"), F.col("seg").cast("string"), F.lit(" 第"), "caption", F.lit("场 "),
                 tx.kill_word(F.col("count"))),
    )


def single_best(
    pool: DataFrame, sentences: DataFrame, picks: DataFrame, fps: DataFrame, pre: float = 20.0,
    post: float = 10.0, max_len: float = 90.0,
) -> DataFrame:
    """The first pick of a session, else its biggest cluster."""
    mine = first_k(picks, S, pick_order(), 1, "pos").select(
        "session", "src", "t_first", "t_last", "n", F.lit(0).alias("auto")
    )
    auto = biggest(clusters(drop_false(pool, fps)), 1).select(
        "session", "src", "t_first", "t_last", "n", F.lit(1).alias("auto")
    )
    best = first_k(mine.unionByName(auto), S, ["auto"], 1, "pos")
    word = F.concat(tx.kill_word(F.col("n"), F.lit("名场面")), F.lit(" 完整版"))
    rows = _segs(
        best, src=F.col("src"), t0=F.col("t_first") - pre, t1=F.col("t_last") + post,
        cap=F.lit(max_len), kind=F.lit("kill"), count=F.col("n"), ins=F.lit(1),
        caption=F.concat(F.when(F.col("auto") == 0, "★ ").otherwise(""), word),
    )
    return snap_windows(_numbered(rows, "ins"), sentences)


def multi_kill(
    pool: DataFrame, gap: float = 15.0, fast: float = 1.5, slow: float = 0.5, before: float = 2.0,
    pre: float = 8.0, post: float = 4.0, width: float = CHUNK,
) -> DataFrame:
    """Every cluster of two or more in source and time order, slowed down before each kill."""
    rows = cluster_rows(pool, "down", gap, width)
    key = ["session", "cl"]
    cl = rows.groupBy(*key).agg(
        F.min("src").alias("src"), F.min("t_start").alias("t_first"),
        F.max("t_start").alias("t_last"), F.count("*").alias("n"),
    ).where(F.col("n") >= 2)
    zones = speed_zones(rows.join(cl.select(*key, "t_first", "t_last"), key), fast, slow, before, pre, post)
    cl = cl.join(zones, key)
    # numbered by source, then time: relative times of a source fit the chunked order per source
    cl = scan(cl, lane(PART, ("t_first",), width), running={"__n": F.col("n"), "__k": F.lit(1).cast("long")})
    per_src = cl.groupBy(*PART).agg(F.max("__n").alias("sn"), F.max("__k").alias("sk"))
    before_src = W.partitionBy("session").orderBy("src").rowsBetween(W.unboundedPreceding, -1)
    per_src = per_src.select(
        *PART, F.coalesce(F.sum("sn").over(before_src), F.lit(0)).alias("on"),
        F.coalesce(F.sum("sk").over(before_src), F.lit(0)).alias("ok"),
    )
    out = cl.join(per_src, list(PART))
    return out.select(
        "session", (F.col("__k") + F.col("ok")).alias("seg"), "src",
        F.bround(F.col("t_first") - pre, 2).alias("t_in"),
        F.bround(F.col("t_last") + post, 2).alias("t_out"),
        F.lit("kill").alias("kind"), F.col("n").alias("count"),
        (F.col("__n") + F.col("on")).alias("counter"), kill_caption(F.col("n")).alias("caption"),
        "zones",
    )


def speed_zones(
    rows: DataFrame, fast: float, slow: float, before: float, pre: float, post: float
) -> DataFrame:
    """Zones per cluster: ``[t-2, t]`` slow (merged where they meet), the rest fast."""
    key = ["session", "cl"]
    w = W.partitionBy(*key).orderBy("t_start")
    runs = rows.withColumn("__p", F.lag("t_start").over(w)).withColumn(
        "__o", F.when(F.col("__p").isNull() | (F.col("t_start") - before > F.col("__p")), 1).otherwise(0)
    )
    runs = runs.withColumn("z", F.sum("__o").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    runs = runs.groupBy(*key, "z").agg(
        (F.min("t_start") - before).alias("a"), F.max("t_start").alias("b"),
        (F.first("t_first") - pre).alias("lo"), (F.first("t_last") + post).alias("hi"),
    )
    wz = W.partitionBy(*key).orderBy("z")
    runs = runs.withColumn("cur", F.coalesce(F.lag("b").over(wz), "lo")).withColumn(
        "is_last", F.lead("z").over(wz).isNull()
    )

    def zone(x: Column, y: Column, speed: float) -> Column:
        return F.struct(F.bround(x, 2).alias("t0"), F.bround(y, 2).alias("t1"), F.lit(speed).alias("speed"))

    c = F.col
    made = F.array_compact(
        F.array(
            F.when(c("a") > c("cur"), zone(c("cur"), c("a"), fast)),
            zone(F.greatest("a", "lo"), c("b"), slow),
            F.when(c("is_last") & (c("b") < c("hi")), zone(c("b"), c("hi"), fast)),
        )
    )
    return runs.select(*key, F.explode(made).alias("zone")).groupBy(*key).agg(
        F.array_sort(F.collect_list("zone")).alias("zones")
    )


def snap_to_shots(
    segs: DataFrame, diffs: DataFrame, sentences: DataFrame, t: str, shift: float = 1.2,
    width: float = CHUNK,
) -> DataFrame:
    """Move ``t`` of (session, seg, src, ...) to the nearest shot change within its speech gap."""
    key = ["session", "seg"]
    talk = sentences.select(*PART, "id", F.col("start").alias("sa"), F.col("end").alias("sb"))
    rows = segs.withColumn("__tb", F.col(t) + 1e-6).withColumn("__ta", F.col(t) - 1e-6)
    rows = asof(rows, talk, list(PART), "__tb", "sb", [], width, name="__b")
    rows = asof(rows, talk, list(PART), "__ta", "sa", [], width, name="__a", forward=True)
    spoken = talk.select(*PART).distinct().withColumn("__talk", F.lit(True))
    rows = rows.join(spoken, list(PART), "left")
    lo = F.greatest(
        F.col(t) - shift, F.when(F.col("__talk"), F.coalesce(F.col("__b.sb"), F.lit(0.0)))
    )
    hi = F.least(F.col(t) + shift, F.col("__a.sa"))
    rows = cut_lineage(rows.withColumn("__lo", lo).withColumn("__hi", hi))
    iv = rows.where(F.col("__hi") - F.col("__lo") >= 0.1).select(
        *key, "src", F.col(t).alias("__t"), "__lo", "__hi"
    )
    d = diffs.select("src", F.col("t").alias("__dt"), "diff")
    seen = stab(d, iv, ["src"], "__dt", "__lo", "__hi", 5.0)
    bar = seen.groupBy(*key).agg(
        F.count("*").alias("__n"), F.greatest(F.percentile("diff", 0.5) * 3.0, F.lit(2.0)).alias("__bar")
    )
    best = (
        seen.join(bar, key)
        .where((F.col("__n") >= 2) & (F.col("diff") > F.col("__bar")))
        .groupBy(*key)
        .agg(F.min(F.struct(F.abs(F.col("__dt") - F.col("__t")).alias("d"), F.col("__dt").alias("c"))).alias("__c"))
    )
    out = rows.join(best, key, "left")
    return out.select(
        *[F.coalesce(F.bround("__c.c", 2), F.col(t)).alias(c) if c == t else F.col(c) for c in segs.columns]
    )


def pool_stats(pool: DataFrame) -> DataFrame:
    return pool.groupBy("session").agg(
        F.count_if(F.col("kind") == "down").alias("n_down"),
        F.count_if(succeeded()).alias("n_extract_ok"),
        F.count("*").alias("n_events"),
    )


def publish_vars(segs: DataFrame, stats: DataFrame) -> DataFrame:
    """Variables for titles: streamer, hook, kill sum, segments, profit in units of 10,000."""
    shown = F.col("card").isNull()
    first_src = F.min_by("src", F.when(shown & (F.coalesce("src", F.lit("")) != ""), F.col("seg")))
    hook = F.min_by("caption", F.when(shown & (F.coalesce("caption", F.lit("")) != ""), F.col("seg")))
    out = segs.groupBy("session").agg(
        first_src.alias("s"), F.coalesce(hook, F.lit("")).alias("hook"),
        F.sum(F.when(shown & (F.col("kind") == "kill"), F.coalesce("count", F.lit(0))).otherwise(0)).alias("n_kills"),
        F.count_if(shown).alias("n_segments"),
        tx.in_wan(F.sum(F.coalesce("price", F.lit(0)))).alias("profit_wan"),
    )
    name = F.get(F.split(clock.base_name(F.coalesce("s", F.lit(""))), "（"), F.lit(0))
    return out.join(stats, ["session"], "left").select(
        "session", F.when(name == "", "主播").otherwise(name).alias("streamer"), "hook", "n_kills",
        "n_segments", F.col("n_down").alias("n_down_total"), "n_extract_ok", "profit_wan",
    )


def cut_seconds(segs: DataFrame) -> DataFrame:
    """Length of the finished cut: zones by their speed, other segments by their length."""
    by_zone = F.aggregate(
        F.coalesce("zones", F.array().cast("array<struct<t0:double,t1:double,speed:double>>")),
        F.lit(0.0),
        lambda a, z: a + (z.getField("t1") - z.getField("t0")) / z.getField("speed"),
    )
    plain = F.coalesce(F.col("t_out") - F.col("t_in"), F.lit(0.0))
    one = F.when(F.coalesce(F.size("zones"), F.lit(0)) > 0, by_zone).otherwise(plain)
    return segs.groupBy("session").agg(F.sum(one).alias("seconds"))
