"""Events out of text readings: settlement tracking, raw detections, merging, prices, speech.

``readings`` is by far the largest table. It is filtered to the information band where it is read;
only the few off-band rows inside a settlement interval are joined back in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuespan import constants as K
from cuespan.functions import text as tx
from cuespan.operators.intervals import first_k, stab
from cuespan.operators.merging import merge_raw_events
from cuespan.operators.ordered import gap_groups, lane, scan
from cuespan.session import cut_lineage

PART = ("session", "src")
READ_CHUNK = 600.0
SETTLE_SEC = 12.0


def in_region(box: tuple[float, float, float, float]) -> Column:
    """Centre inside a relative box."""
    x0, y0, x1, y1 = box
    rx, ry = F.col("cx") / F.col("frame_w"), F.col("cy") / F.col("frame_h")
    return rx.between(x0, x1) & ry.between(y0, y1)


def down_text(text: Column) -> Column:
    return text.rlike(K.DOWN_TEXT) & ~text.rlike(K.LABEL_ONLY_TEXT)


def down_position() -> Column:
    w, h = F.col("frame_w"), F.col("frame_h")
    return (
        (F.abs(F.col("cx") - w / 2) < w * 0.35)
        & (F.col("cy") > h * 0.62)
        & (F.col("cy") < h * 0.82)
    )


def weapon_box() -> Column:
    return (F.col("box_h") <= F.col("frame_h") * 0.03) & (F.col("box_w") <= F.col("frame_w") * 0.12)


def settlement_spans(readings: DataFrame, width: float = READ_CHUNK) -> DataFrame:
    """Intervals in which the whole frame counts: open start, until 12 s after the last hit.

    A chain of settlement frames less than 12 s apart is tracked from its first hit inside the
    band; off-band hits prolong it but cannot start it.
    """
    frames = (
        readings.where(F.col("text").rlike(K.EXTRACT_TEXT))
        .groupBy(*PART, "t")
        .agg(F.max(in_region(K.INFO_BAND)).alias("band"))
    )
    grouped = gap_groups(frames, lane(PART, "t", width), SETTLE_SEC, "chain", strict=True)
    return (
        grouped.groupBy(*PART, "chain")
        .agg(F.min(F.when(F.col("band"), F.col("t"))).alias("lo"), F.max("t").alias("last"))
        .where(F.col("lo").isNotNull())
        .select(*PART, "lo", (F.col("last") + SETTLE_SEC).alias("hi"))
    )


def visible_readings(
    readings: DataFrame, width: float = READ_CHUNK, spans: DataFrame | None = None
) -> DataFrame:
    """Readings in the band, plus off-band ones inside a settlement interval."""
    spans = settlement_spans(readings, width) if spans is None else spans
    band = F.coalesce(in_region(K.INFO_BAND), F.lit(False))
    inside = readings.where(band).withColumn("off_band", F.lit(False))
    tracked = (
        stab(readings.where(~band), spans, PART, "t", "lo", "hi", 60.0, open_hi=True, levels=1)
        .where(F.col("t") > F.col("lo"))
        .drop("lo", "hi")
        .withColumn("off_band", F.lit(True))
    )
    return inside.unionByName(tracked)


def confirmed_increases(
    df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], value: str, width: float
) -> DataFrame:
    """Rows whose value rose and whose next row of the same key keeps or raises it.

    The last row of a key is never confirmed. Adds ``prev``, ``next`` and the order columns of the
    confirming row as ``next_<col>``.
    """
    v = F.col(value)
    out = scan(
        df,
        lane(keys, order, width),
        prev={"prev": v},
        following={"next": v, **{f"next_{c}": F.col(c) for c in order}},
    )
    return out.where((v > F.col("prev")) & (F.col("next") >= v))


def container_reads(readings: DataFrame) -> DataFrame:
    m = F.col("text")
    return readings.where(m.rlike(K.CONTAINER_TEXT)).select(
        "*",
        F.regexp_extract(m, K.CONTAINER_TEXT, 1).alias("container"),
        F.regexp_extract(m, K.CONTAINER_TEXT, 2).try_cast("int").alias("cur"),
    )


_RAW = [
    *PART, "t", "rank", "ord_t", "ord_seq", "kind", "detail", "conf", "target", "text", "point",
    "snapshot", "container", "prev", "cur", "context", "price", "price_source",
]


def _raw(df: DataFrame, kind: str, rank: int, detail: Column, **cols: Column) -> DataFrame:
    types = {
        "snapshot": "array<string>", "context": "array<string>", "prev": "int", "cur": "int",
        "price": "long",
    }
    have = {
        "rank": F.lit(rank), "ord_t": F.col("t"), "ord_seq": F.col("seq"), "kind": F.lit(kind),
        "detail": detail, "conf": F.col("score"), **cols,
    }
    out = []
    for c in _RAW:
        if c in have:
            out.append(have[c].alias(c))
        elif c in (*PART, "t"):
            out.append(F.col(c))
        else:
            out.append(F.lit(None).cast(types.get(c, "string")).alias(c))
    return df.select(*out)


def raw_events(readings: DataFrame, width: float = READ_CHUNK) -> DataFrame:
    """Single detections per frame: downs, match starts, settlements, dances, pickups."""
    # the visible readings are the small part of all readings every rule below starts from
    spans = cut_lineage(settlement_spans(readings, width))
    vis = cut_lineage(visible_readings(readings, width, spans))
    txt = F.col("text")
    frame = W.partitionBy(*PART, "t")
    marked = vis.withColumn(
        "settled", F.max(txt.rlike(K.EXTRACT_TEXT)).over(frame)
    )
    target = F.regexp_extract(txt, K.TARGET_TEXT, 1)
    downs = _raw(
        marked.where(~F.col("settled") & down_position() & down_text(txt)),
        "down", 0, F.btrim(F.concat(F.lit("击倒 "), target)), target=target, text=txt,
    )
    starts = _raw(
        vis.where((F.col("cy") > F.col("frame_h") * 0.75) & txt.rlike(K.MATCH_TEXT)),
        "match_start", 1, F.lit("进入对局（部署）"), text=txt,
    )
    dances = _raw(
        vis.where(tx.contains_any(txt, K.DANCE_WORDS) & ~txt.rlike(K.HUD_NOISE)), "dance", 3, txt
    )
    return (
        downs.unionByName(starts)
        .unionByName(_extracts(readings, vis, spans))
        .unionByName(dances)
        .unionByName(_pickups(vis, width))
    )


def _extracts(readings: DataFrame, vis: DataFrame, spans: DataFrame) -> DataFrame:
    """Settlement hits with the frame's texts; a hit before tracking starts keeps one snapshot."""
    hits = vis.where(F.col("text").rlike(K.EXTRACT_TEXT))
    hit_frames = hits.select(*PART, "t").distinct()
    at_frame = [*PART, "t"]
    sure = readings.join(hit_frames, at_frame, "left_semi").where(F.col("score") > 0.6)
    snaps = (
        first_k(sure, at_frame, ["seq"], 30)
        .groupBy(*at_frame)
        .agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("s"))
        .select(*at_frame, F.col("s.text").alias("snap"))
    )
    points = (
        vis.join(hit_frames, at_frame, "left_semi")
        .where(F.contains(F.col("text"), F.lit(K.EXTRACT_POINT)))
        .groupBy(*at_frame)
        .agg(F.min_by("text", "seq").alias("p"))
    )
    frames = hits.groupBy(*at_frame).agg(F.min("seq").alias("first_seq"))
    full = (
        stab(frames, spans, PART, "t", "lo", "hi", 60.0, open_hi=True, levels=1)
        .where(F.col("t") > F.col("lo"))
        .select(*at_frame)
        .distinct()
        .withColumn("full", F.lit(True))
    )
    frames = frames.join(full, at_frame, "left")
    rows = hits.join(frames, at_frame).join(snaps, at_frame, "left").join(points, at_frame, "left")
    keeps = F.coalesce(F.col("full"), F.lit(False)) | (F.col("seq") == F.col("first_seq"))
    return _raw(
        rows, "extract", 2, F.col("text"),
        point=F.coalesce(F.col("p"), F.lit("")),
        snapshot=F.when(keeps & (F.size("snap") > 0), F.col("snap")),
    )


def _pickups(vis: DataFrame, width: float) -> DataFrame:
    reads = container_reads(vis)
    rises = confirmed_increases(reads, (*PART, "container"), ("t", "seq"), "cur", width)
    at_frame = [*PART, "t"]
    usable = vis.join(rises.select(*at_frame).distinct(), at_frame, "left_semi").where(
        ~F.col("text").rlike(K.HUD_NOISE) & ~F.col("text").rlike(K.CONTAINER_TEXT)
    )
    frames = (
        usable.groupBy(*at_frame)
        .agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("s"))
        .select(*at_frame, F.col("s.text").alias("texts"))
    )
    rows = rises.join(frames, at_frame, "left")
    texts = F.coalesce(F.col("texts"), F.array().cast("array<string>"))
    price = tx.estimate_price(F.array_join(texts, " "))
    return _raw(
        rows, "loot", 4,
        F.concat("container", F.lit(" "), F.col("prev").cast("string"), F.lit("->"),
                 F.col("cur").cast("string")),
        ord_t=F.col("next_t"), ord_seq=F.col("next_seq"),
        container=F.col("container"), prev=F.col("prev"), cur=F.col("cur"),
        context=F.slice(texts, 1, 6),
        price=price.getField("price"), price_source=price.getField("price_source"),
    )


def settlement_attributes(snapshot: Column) -> dict[str, Column]:
    """Duration, profit and kills read off the texts of a settlement."""
    texts = F.coalesce(snapshot, F.array().cast("array<string>"))

    def hits(pattern: str) -> Column:
        return F.filter(texts, lambda x: x.rlike(pattern))

    durations = F.transform(
        hits(K.DURATION_TEXT), lambda x: F.regexp_extract(x, K.DURATION_TEXT, 1)
    )
    worded = F.get(hits(K.PROFIT_TEXT), F.lit(0))
    numbers = F.filter(
        texts,
        lambda x: x.rlike(K.PROFIT_NUMBER)
        & (F.regexp_replace(x, "[,，]", "").try_cast("long") >= 1000),
    )
    kills = F.get(hits(K.KILLS_TEXT), F.lit(0))
    return {
        "duration": F.array_max(durations),
        "profit": F.coalesce(
            F.regexp_extract(worded, K.PROFIT_TEXT, 1), F.get(numbers, F.lit(0))
        ),
        "kills_official": F.regexp_extract(kills, K.KILLS_TEXT, 1),
    }


def detect_events(readings: DataFrame, width: float = READ_CHUNK) -> DataFrame:
    """Readings to merged events with settlement attributes and visual prices."""
    merged = merge_raw_events(cut_lineage(raw_events(readings, width)), width)
    attrs = settlement_attributes(F.col("snapshot"))
    is_extract = F.col("kind") == "extract"
    meta = F.struct(
        "target", "text", "point", "snapshot",
        *[F.when(is_extract, c).alias(n) for n, c in attrs.items()],
        "container", "prev", "cur", "context",
        F.lit(None).cast("array<string>").alias("voice_hint"),
    )
    return merged.select(
        *PART, "kind", "t_start", "t_end", "detail", "confidence",
        F.when(F.col("kind") == "loot", F.col("price")).alias("price"),
        F.when(F.col("kind") == "loot", F.col("price_source")).alias("price_source"),
        meta.alias("meta"),
    )


def apply_speech(events: DataFrame, sentences: DataFrame, width: float = READ_CHUNK) -> DataFrame:
    """Price pickups from what was said around them, and add pickups only the voice noticed.

    ``events`` needs ``meta.voice_hint``; only host sentences with a high-value word count.
    """
    said = sentences.where(
        (F.coalesce(F.col("speaker"), F.lit("host")) == "host")
        & F.col("text").rlike(K.LOOT_SPEECH)
    ).select(*PART, "id", "start", "end", "text")
    loots = events.where(F.col("kind") == "loot")
    bare = loots.where(F.coalesce(F.col("price"), F.lit(0)) == 0).select(
        *PART, "t_start", "t_end", "detail", ((F.col("t_start") + F.col("t_end")) / 2).alias("mid")
    ).distinct()
    spans = said.select(
        *PART, F.col("id").alias("sid"), F.col("text").alias("stext"),
        (F.col("start") - 10).alias("lo"), (F.col("end") + 10).alias("hi"),
    )
    at = [*PART, "t_start", "t_end", "detail"]
    # the price looks at every sentence, for the best-placed word; the first three sentences are the hints
    pairs = stab(bare, spans, PART, "mid", "lo", "hi", 30.0, levels=1).withColumn(
        "pos", F.min(_price_position(F.col("stext"))).over(W.partitionBy(*at))
    )
    hints = first_k(pairs, at, ["sid"], 3).groupBy(*at).agg(
        F.array_sort(F.collect_list(F.struct("sid", "stext"))).alias("h"), F.min("pos").alias("pos")
    ).select(*at, F.col("h.stext").alias("hints"), "pos")
    got = events.join(hints, at, "left")
    mine = (
        (F.col("kind") == "loot")
        & (F.coalesce(F.col("price"), F.lit(0)) == 0)
        & F.col("hints").isNotNull()
    )
    hit = mine & F.col("pos.price").isNotNull()
    voiced = got.select(
        *[
            {
                "price": F.when(hit, F.col("pos.price")).otherwise(F.col("price")),
                "price_source": F.when(hit, F.col("pos.price_source")).otherwise(
                    F.col("price_source")
                ),
                "detail": F.when(hit, F.concat("detail", F.lit("（语音高价值）"))).otherwise(
                    F.col("detail")
                ),
                "meta": F.when(mine, F.col("meta").withField("voice_hint", F.col("hints"))).otherwise(
                    F.col("meta")
                ),
            }.get(c, F.col(c)).alias(c)
            for c in events.columns
        ]
    )
    return voiced.unionByName(_spoken_only(loots, said, width), allowMissingColumns=True)


def _price_position(text: Column) -> Column:
    """(position, price, source) of the first listed word; NULL fields when nothing is listed."""
    table = [(n, p, "table") for n, p in K.PRICES] + [(n, p, "quality") for n, p in K.QUALITY_PRICES]
    hits = [
        F.when(
            F.contains(text, F.lit(n)),
            F.struct(
                F.lit(i).alias("i"), F.lit(p).cast("long").alias("price"),
                F.lit(s).alias("price_source"),
            ),
        )
        for i, (n, p, s) in enumerate(table)
    ]
    return F.coalesce(*hits)


def _spoken_only(loots: DataFrame, said: DataFrame, width: float) -> DataFrame:
    """Short high-value sentences without a pickup within 10 s become pickups themselves."""
    short = said.where(F.length("text") <= 40).withColumn(
        "mid", (F.col("start") + F.col("end")) / 2
    )
    spans = loots.select(
        *PART, (F.col("t_start") - 10).alias("lo"), (F.col("t_end") + 10).alias("hi")
    ).distinct()
    covered = stab(short, spans, PART, "mid", "lo", "hi", 30.0, levels=1).select(*PART, "id").distinct()
    alone = short.join(covered, [*PART, "id"], "left_anti")
    price = tx.estimate_price(F.col("text"))
    meta_type = loots.schema["meta"].dataType
    fields = [
        F.array(F.col("text")).alias("voice_hint")
        if f.name == "voice_hint"
        else F.lit(None).cast(f.dataType).alias(f.name)
        for f in meta_type.fields
    ]
    return alone.select(
        *PART, F.lit("loot").alias("kind"),
        F.col("start").alias("t_start"), F.col("end").alias("t_end"),
        F.concat(F.lit("语音高价值: "), F.substring("text", 1, 30)).alias("detail"),
        F.lit(0.7).alias("confidence"),
        price.getField("price").alias("price"), price.getField("price_source").alias("price_source"),
        F.struct(*fields).alias("meta"),
    )


def summarize(events: DataFrame) -> DataFrame:
    """Count per kind and the price total of pickups."""
    return events.groupBy("kind").agg(
        F.count("*").alias("n"),
        F.sum(F.when(F.col("kind") == "loot", F.coalesce("price", F.lit(0))).otherwise(0)).alias(
            "price_total"
        ),
    )

