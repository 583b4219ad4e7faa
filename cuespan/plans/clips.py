"""Knock-down clips, pickup sessions and queue moments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuespan import constants as K
from cuespan.functions import clock
from cuespan.functions import text as tx
from cuespan.operators.intervals import stab
from cuespan.operators.ordered import asof, gap_groups, has_within, lane, nearest, scan
from cuespan.plans.detect import container_reads, in_region
from cuespan.session import cut_lineage

PART = ("session", "src")
CHUNK = 600.0


def ordered_clips(clips: DataFrame, t: str, parts: DataFrame, width: float = 86400.0) -> DataFrame:
    """Clips with part facts and a session-wide number in part, then time order."""
    facts = parts.select(*PART, "part_seq", "duration_s", clock.part_no(F.col("filename")).alias("part"))
    rows = clips.join(facts, list(PART))
    return scan(
        rows.withColumn("__seq", F.col("part_seq").cast("double")),
        lane("session", ("__seq", t, "src"), 16.0),
        running={"seq": F.lit(1).cast("long")},
    ).drop("__seq")


def clip_file(seq: Column, part: Column, t: Column, label: Column, cut: int, suffix: str) -> Column:
    return F.concat(
        F.format_string("%02d_P", seq), part, F.lit("_"), clock.mmss(t), F.lit("_"),
        tx.slug(label, cut), F.lit(suffix),
    )


def knock_clips(
    events: DataFrame,
    parts: DataFrame,
    merge_sec: float = 12.0,
    pre: float = 6.0,
    post: float = 10.0,
    width: float = CHUNK,
) -> DataFrame:
    """Downs at most ``merge_sec`` apart become one clip with its cut, label and targets."""
    downs = events.where(F.col("kind") == "down").select(
        *PART, "t_start", "detail",
        F.coalesce("meta.target", F.lit("")).alias("target"),
        F.coalesce("meta.text", F.lit("")).alias("text"),
    )
    entry = F.struct(
        F.col("t_start").alias("t"), "detail",
        F.contains("text", F.lit("头")).alias("headshot"),
        F.when(F.col("text") != "", F.col("text")).otherwise(F.col("detail")).alias("text"),
        F.when(F.col("target") != "", F.col("target")).otherwise("?").alias("target"),
    )
    segs = (
        gap_groups(downs, lane(PART, ("t_start", "detail", "text"), width), merge_sec, "seg")
        .groupBy(*PART, "seg")
        .agg(
            F.min("t_start").alias("t_start"), F.max("t_start").alias("t_end"),
            F.array_sort(F.collect_list(entry)).alias("items"),
        )
    )
    rows = ordered_clips(segs, "t_start", parts)
    first = F.get("items", F.lit(0)).getField("target")
    n = F.size("items")
    label = F.when(n == 1, F.concat(F.lit("击倒_"), first)).otherwise(
        F.concat(F.lit("击倒x"), n.cast("string"), F.lit("_"), first, F.lit("等"))
    )
    return rows.select(
        "session", "src", "seq",
        clip_file(F.col("seq"), F.col("part"), F.col("t_start"), label, 44, ".mp4").alias("file"),
        "part", "t_start", "t_end",
        F.array(
            F.bround(F.greatest(F.lit(0.0), F.col("t_start") - pre), 2),
            F.bround(F.least(F.col("duration_s"), F.col("t_end") + post), 2),
        ).alias("cut"),
        F.transform("items", lambda x: x.getField("target")).alias("targets"),
        F.transform(
            "items",
            lambda x: F.struct(
                x.getField("t").alias("t"), x.getField("detail").alias("detail"),
                x.getField("headshot").alias("headshot"), x.getField("text").alias("text"),
            ),
        ).alias("events"),
        label.alias("label"),
    )


def loot_islands(events: DataFrame, merge_sec: float = 25.0, width: float = CHUNK) -> DataFrame:
    """Pickups with their coarse cluster (gap 25 s) and the island (gap 30 s) inside it."""
    loots = events.where(F.col("kind") == "loot").select(
        *PART, "t_start", F.col("meta.container").alias("container"),
        F.col("meta.prev").alias("prev"), F.col("meta.cur").alias("cur"),
        F.col("meta.context").alias("context"), F.col("meta.voice_hint").alias("voice_hint"),
        "price", "price_source",
    )
    clustered = gap_groups(loots, lane(PART, "t_start", width), merge_sec, "cluster")
    if merge_sec <= 30.0:
        # no pause inside a cluster can then exceed the 30 s that part islands
        return clustered.withColumn("island", F.lit(1).cast("long"))
    return gap_groups(clustered, lane((*PART, "cluster"), "t_start", width), 30.0, "island")


ISLAND = (*PART, "cluster", "island")


def interface_sessions(
    readings: DataFrame,
    islands: DataFrame,
    look_back: float = 35.0,
    look_fwd: float = 15.0,
    fps: float = 1.0,
    width: float = CHUNK,
) -> tuple[DataFrame, DataFrame]:
    """Open/close sessions of the container view around each island, and their confirmed jumps.

    Returns ``(sessions, jumps)``. A pause of more than 2.2 s between container readings closes the
    view. Sessions carry the net gain between their first and last frame and whether any count
    fell; jumps are increases the next reading confirms.
    """
    spans = islands.groupBy(*ISLAND).agg(
        F.bround(F.greatest(F.lit(0.0), F.min("t_start") - look_back), 2).alias("lo"),
        F.bround(F.max("t_start") + look_fwd, 2).alias("hi"),
    )
    strip = container_reads(readings.where(in_region(K.CONTAINER_STRIP) & (F.col("score") >= 0.5)))
    per_frame = strip.groupBy(*PART, "t", "container").agg(F.max_by("cur", "seq").alias("cur"))
    near = stab(per_frame, spans, PART, "t", "lo", "hi", 60.0, levels=1).drop("lo", "hi")
    # container readings near islands are a small part of all readings; read twice below
    reads = cut_lineage(gap_groups(near, lane(ISLAND, "t", width), 2.2, "view"))
    view = (*ISLAND, "view")
    moved = cut_lineage(
        scan(
            reads, lane((*view, "container"), "t", width),
            prev={"before": F.col("cur")},
            following={"next": F.col("cur"), "next_t": F.col("t")},
        )
    )
    # frames first, then views: first and last frame need no join back to the readings
    frames = moved.groupBy(*view, "t").agg(
        F.sum("cur").alias("sum"),
        F.max(F.coalesce(F.col("cur") < F.col("before"), F.lit(False))).alias("fell"),
    )
    # a frame without a count adds nothing, unless there is no other frame
    none = F.when(F.min("t") < F.max("t"), F.lit(0).cast("long"))
    edges = frames.groupBy(*view).agg(
        F.min("t").alias("t_first"), F.max("t").alias("t_last"),
        F.coalesce(F.max_by("sum", "t"), none).alias("__end"),
        F.coalesce(F.min_by("sum", "t"), none).alias("__beg"),
        F.max("fell").alias("organizing"),
    )
    hop = 1.0 / fps
    sessions = edges.select(
        *view,
        F.bround(F.col("t_first") - hop, 2).alias("ui0"),
        F.bround(F.col("t_last") + hop, 2).alias("ui1"),
        (F.col("__end") - F.col("__beg")).alias("net_gain"),
        "organizing",
    )
    # the rule of ``confirmed_increases``, on the neighbours already at hand
    jumps = moved.where((F.col("cur") > F.col("before")) & (F.col("next") >= F.col("cur"))).select(
        *view, "container", "t", F.col("before").alias("prev"), "cur", "next_t"
    )
    return sessions, jumps


def pickup_sessions(
    events: DataFrame,
    readings: DataFrame,
    parts: DataFrame,
    bases: DataFrame,
    matches: DataFrame,
    *,
    merge_sec: float = 25.0,
    max_sec: float = 90.0,
    width: float = CHUNK,
) -> DataFrame:
    """Pickup clips with their cut, match, nearest down, jumps and a ``lobby`` audit flag."""
    islands = cut_lineage(loot_islands(events, merge_sec, width))
    sessions, jumps = interface_sessions(readings, islands, width=width)
    view = [*ISLAND, "view"]
    usable = sessions.join(jumps.select(*view).distinct(), view, "left_semi").withColumn(
        "fallback", F.lit(False)
    )
    own = islands.where(F.col("prev").isNotNull() & F.col("cur").isNotNull()).join(
        usable.select(*ISLAND).distinct(), list(ISLAND), "left_anti"
    )
    rescued = own.groupBy(*ISLAND).agg(
        F.lit(0).cast("long").alias("view"),
        F.min("t_start").alias("ui0"), F.max("t_start").alias("ui1"),
        F.sum(F.col("cur") - F.col("prev")).alias("net_gain"),
        F.lit(False).alias("organizing"), F.lit(True).alias("fallback"),
    )
    candidates = usable.unionByName(rescued)
    # the first session of a two-second slot wins, in island and then time order
    slot = F.floor(F.col("ui0") / 2)
    kept = candidates.groupBy(*PART, slot.alias("slot")).agg(
        F.min_by(F.struct(*[c for c in candidates.columns if c not in PART]),
                 F.struct("cluster", "island", "view")).alias("s")
    ).select(*PART, "s.*")
    kept = cut_lineage(kept)
    picks = jumps.select(*view, "container", "t", "prev", "cur").unionByName(
        own.select(
            *ISLAND, F.lit(0).cast("long").alias("view"),
            F.coalesce("container", F.lit("?")).alias("container"),
            F.col("t_start").alias("t"), "prev", "cur",
        )
    )
    picks = picks.join(kept.select(*view), view, "left_semi")
    known = islands.select(
        *ISLAND, F.coalesce("container", F.lit("?")).alias("container"), "t_start", "context",
        "voice_hint", "price", "price_source",
    ).withColumn("ord", F.col("t_start"))
    detailed = nearest(
        picks, known, [*ISLAND, "container"], "t", "t_start",
        ["context", "voice_hint", "price", "price_source"], width, tolerance=2.5, name="hit",
    )
    words = F.array_join(
        F.concat(
            F.coalesce("hit.context", F.array().cast("array<string>")),
            F.coalesce("hit.voice_hint", F.array().cast("array<string>")),
        ),
        " ",
    )
    item = F.struct(
        F.bround("t", 1).alias("t"),
        F.concat("container", F.lit(" "), F.col("prev").cast("string"), F.lit("->"),
                 F.col("cur").cast("string")).alias("detail"),
        "container", "prev", "cur", (F.col("cur") - F.col("prev")).alias("jump"),
        F.col("hit.context").alias("context"), F.col("hit.voice_hint").alias("voice_hint"),
        F.col("hit.price").alias("price"), F.col("hit.price_source").alias("price_source"),
    )
    rolled = detailed.withColumn("named", tx.dearest_named(words)).groupBy(*view).agg(
        F.min(F.bround("t", 1)).alias("first_pick"), F.max(F.bround("t", 1)).alias("last_pick"),
        F.sum(F.col("cur") - F.col("prev")).alias("jumps"),
        F.count("*").alias("n_picks"),
        F.sort_array(F.collect_set("container")).alias("containers"),
        F.min_by("named", F.when(F.col("named").isNotNull(), F.struct("t", "container"))).alias("named"),
        F.array_sort(F.collect_list(item)).alias("events"),
    )
    rows = cut_lineage(kept.join(rolled, view).withColumn("label", session_label()))
    rows = flag_lobby(rows, readings, width)
    # facts of a part meet first: the wide rows are joined once
    base = bases.select(*PART, "zero_base").join(parts.select(*PART, "duration_s"), list(PART))
    rows = rows.join(base, list(PART)).withColumn("abs_t", F.col("zero_base") + F.col("first_pick"))
    rows = asof(
        rows, matches.select("session", "no", "enter"), ["session"], "abs_t", "enter", ["no"],
        86400.0, name="m", tie="no",
    )
    downs = events.where(F.col("kind") == "down").select(*PART, F.col("t_start").alias("down_t"))
    rows = asof(rows, downs, list(PART), "first_pick", "down_t", [], width, name="d")
    since = F.col("first_pick") - F.col("d.down_t")
    t0, t1 = pickup_cut(max_sec)
    return rows.select(
        *PART, "cluster", "island", "view", "fallback", "label", "lobby",
        F.col("first_pick").alias("t_start"), F.col("last_pick").alias("t_end"),
        F.array(F.bround(t0, 2), F.bround(t1, 2)).alias("cut"),
        F.array(F.bround("ui0", 1), F.bround("ui1", 1)).alias("ui"),
        F.bround("abs_t", 1).alias("abs_t"), F.col("m.no").alias("match_no"),
        "jumps", "net_gain", "organizing", F.bround(F.col("ui1") - F.col("ui0"), 1).alias("ui_sec"),
        "containers", F.when(since <= 25.0, F.bround(since, 1)).alias("near_down"), "events",
    )


def session_label() -> Column:
    """Dearest named item, else the number of picks, else container and size."""
    return (
        F.when(F.col("named").isNotNull(), F.concat(F.lit("拾取_"), F.col("named")))
        .when(
            (F.col("n_picks") >= 3) | (F.size("containers") > 1),
            F.concat(F.lit("连拾x"), F.col("n_picks").cast("string")),
        )
        .otherwise(
            F.concat(F.lit("拾取_"), F.get("containers", F.lit(0)), F.lit("+"),
                     F.col("jumps").cast("string"))
        )
    )


def pickup_cut(max_sec: float = 90.0) -> tuple[Column, Column]:
    first, last = F.col("first_pick"), F.col("last_pick")
    t0 = F.greatest(F.lit(0.0), F.least(F.col("ui0") - 2.0, first - 4.5))
    t1 = F.least(F.col("duration_s"), F.greatest(F.col("ui1") + 2.5, last + 6.0))
    capped = F.least(t1, F.greatest(t0 + max_sec, last + 4.0))
    return t0, F.when(t1 - t0 > max_sec, capped).otherwise(t1)


def lobby_readings(readings: DataFrame) -> DataFrame:
    return readings.where(
        in_region(K.LOBBY_BAND) & F.col("text").rlike(K.LOBBY_TEXT) & (F.col("score") > 0.5)
    ).select(*PART, F.col("t").alias("lobby_t"))


def flag_lobby(rows: DataFrame, readings: DataFrame, width: float = CHUNK) -> DataFrame:
    """``lobby`` is true where a menu reading lies in ``[first_pick - 2, last_pick + 1]``."""
    marked = rows.withColumn("__lo", F.col("first_pick") - 2.0).withColumn(
        "__hi", F.col("last_pick") + 1.0
    )
    return has_within(
        marked, lobby_readings(readings), list(PART), "__lo", "__hi", "lobby_t", width, name="lobby"
    ).drop("__lo", "__hi")


def pickup_index(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """Numbered, named pickup clips without the lobby ones."""
    out = ordered_clips(rows.where(~F.col("lobby")).drop("duration_s"), "t_start", parts)
    return out.withColumn(
        "file", clip_file(F.col("seq"), F.col("part"), F.col("t_start"), F.col("label"), 44, ".mp4")
    )


def queue_moments(
    events: DataFrame,
    readings: DataFrame,
    parts: DataFrame,
    window_sec: int = 300,
    guard: int = 60,
    width: float = CHUNK,
) -> DataFrame:
    """Latest second with a queue button before each match start, or why there is none.

    The look-back stops 60 s after the match start before, at most 300 s back (at 0 for the first
    match). One look-back over the rare button readings replaces a range join.
    """
    starts = events.where(F.col("kind") == "match_start").select(
        *PART, F.col("t_start").alias("tm")
    )
    starts = scan(starts, lane(PART, "tm", width), prev={"before": F.col("tm")})
    whole = F.col("tm").cast("long")
    floor = F.when(F.col("before").isNull(), F.lit(0).cast("long")).otherwise(
        F.greatest(F.col("before").cast("long") + guard, whole - window_sec)
    )
    starts = starts.withColumn("floor", F.least(floor, whole - 1)).withColumn(
        "last_sec", (whole - 1).cast("double")
    )
    frames = (
        readings.where(in_region(K.QUEUE_BUTTONS))
        .groupBy(*PART, F.floor("t").cast("double").alias("sec"))
        .agg(F.array_join(F.array_sort(F.collect_list(F.struct("t", "seq", "text"))).getField("text"), "").alias("roi"))
    )
    trigger = None
    for word, label in K.QUEUE_WORDS:
        hit = F.contains("roi", F.lit(word))
        trigger = F.when(hit, label) if trigger is None else trigger.when(hit, label)
    buttons = frames.withColumn("trigger", trigger).where(F.col("trigger").isNotNull())
    found = asof(starts, buttons, list(PART), "last_sec", "sec", ["sec", "trigger", "roi"], width, name="b")
    ok = F.col("b.sec") >= F.col("floor")
    part = parts.select(*PART, clock.part_no(F.col("filename")).alias("part"))
    out = found.join(part, list(PART), "left")
    steps = (F.col("tm").cast("long") - F.col("floor")).cast("string")
    return out.select(
        *PART, "part",
        F.concat(F.lit("P"), F.col("part"), F.lit("#"), F.col("tm").cast("long").cast("string")).alias("key"),
        F.col("tm").alias("t_match_start"), "floor",
        F.when(ok, F.col("b.sec").cast("long")).alias("t_queue"),
        F.when(ok, F.col("b.trigger")).alias("trigger"),
        F.when(ok, F.substring(F.col("b.roi"), 1, 60)).alias("roi_text"),
        F.when(~F.coalesce(ok, F.lit(False)),
               F.concat(F.lit("窗口内未见匹配按钮（回溯 "), steps, F.lit(" 帧）"))).alias("skip"),
    )


def merge_queue_index(old: DataFrame, new: DataFrame, force: bool = False) -> DataFrame:
    """Keep finished shots and add new ones by key; ``force`` replaces the old rows."""
    keys = ["session", "key"]
    done = old.where(F.col("file").isNotNull() | F.col("skip").isNotNull())
    if force:
        return old.join(new, keys, "left_anti").unionByName(new, allowMissingColumns=True)
    fresh = new.join(done, keys, "left_anti")
    return old.join(fresh, keys, "left_anti").unionByName(fresh, allowMissingColumns=True)
