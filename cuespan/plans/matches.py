"""Clock bases of parts, match intervals and the per-match report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuespan import constants as K
from cuespan.functions import clock
from cuespan.functions import text as tx
from cuespan.operators.intervals import count_in_spans
from cuespan.operators.ordered import gap_groups, lane, scan
from cuespan.session import cut_lineage

DAY = 86400
HALF_DAY = 43200
PARTS_CHUNK = 4096.0
BURST_GAP = 20.0


def roll_over(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], base: str) -> DataFrame:
    """Put part clocks on one axis: a fall of more than half a day adds one day.

    The comparison is with the *adjusted* base before, so this is a fold. Its only state is whether
    the base before carries the extra day, and each row maps that bit to one of three outcomes:
    always off, always on, or unchanged. The state is therefore the outcome of the latest row that
    decides it, a carried ``last`` instead of a sequential loop. Adds ``adjusted``.
    """
    b = F.col(base)
    ln = lane(keys, order, PARTS_CHUNK)
    rows = scan(df, ln, prev={"__pb": b})
    if_off = F.coalesce(b < F.col("__pb") - HALF_DAY, F.lit(False))
    if_on = F.coalesce(b < F.col("__pb") + DAY - HALF_DAY, F.lit(False))
    decided = F.when(if_off == if_on, if_off.cast("int"))
    rows = scan(rows, ln, last={"__day": decided})
    return rows.withColumn("adjusted", b + F.col("__day") * DAY).drop("__pb", "__day")


def part_bases(parts: DataFrame) -> DataFrame:
    """(session, src, base, zero_base): NULL base for parts without a stamp; zero counts them as 0."""
    stamped = cut_lineage(
        parts.select("session", "src", "part_seq", clock.clock_base(F.col("filename")).alias("__base"))
    )
    keys, order = ("session",), ("part_seq",)
    strict = roll_over(stamped.where(F.col("__base").isNotNull()), keys, order, "__base").select(
        "session", "src", F.col("adjusted").alias("base")
    )
    zero = stamped.withColumn("__base", F.coalesce("__base", F.lit(0).cast("long")))
    zero = roll_over(zero, keys, order, "__base").select(
        "session", "src", "part_seq", F.col("adjusted").alias("zero_base")
    )
    out = zero.join(strict, ["session", "src"], "left").select(
        "session", "src", "part_seq", "base", "zero_base"
    )
    # one row per part, read by every step after this one
    return cut_lineage(out)


def on_clock(events: DataFrame, bases: DataFrame) -> DataFrame:
    """Events with ``base`` and ``abs_t``; events of unstamped parts get NULL."""
    b = bases.select("session", "src", "base")
    return events.join(b, ["session", "src"], "left").withColumn(
        "abs_t", F.col("base") + F.col("t_start")
    )


def match_starts(timed: DataFrame, width: float) -> DataFrame:
    """Numbered match starts of each session in clock order."""
    starts = timed.where((F.col("kind") == "match_start") & F.col("abs_t").isNotNull()).select(
        "session", "src", "t_start", F.col("abs_t").alias("enter")
    )
    ln = lane("session", ("enter", "src"), width)
    return scan(
        starts,
        ln,
        running={"no": F.lit(1).cast("long")},
        following={"next_enter": F.col("enter")},
    )


def numbered_events(timed: DataFrame, width: float) -> DataFrame:
    """Starts, downs, pickups and settlements with the number of the match they fall in.

    A settlement counts where it ends, everything else where it starts; a start opens its own
    match, so starts come first among rows of one instant. One carried count does it for all.
    """
    is_ext = F.col("kind") == "extract"
    is_start = F.col("kind") == "match_start"
    rows = timed.where(
        F.col("abs_t").isNotNull() & F.col("kind").isin("match_start", "down", "loot", "extract")
    ).select(
        "session", "src", "kind", "t_start",
        F.when(is_ext, F.col("base") + F.col("t_end")).otherwise(F.col("abs_t")).alias("at"),
        F.when(is_start, 0).otherwise(1).alias("side"),
        F.when(is_ext, F.contains("detail", F.lit(K.SUCCESS))).alias("ok"),
        F.when(is_ext, F.col("meta.profit")).alias("profit_text"),
        F.when(is_ext, F.col("meta.kills_official")).alias("kills_text"),
    )
    out = scan(
        rows, lane("session", ("at", "side", "src", "t_start"), width),
        running={"no": F.when(is_start, 1).otherwise(0).cast("long")},
    )
    return out.where(F.col("no") > 0)


def build_matches(events: DataFrame, bases: DataFrame, width: float = 86400.0) -> DataFrame:
    """One row per match: entry, duration, downs, bursts, pickups, outcome and gear.

    ``events`` needs session, src, kind, t_start, t_end, detail and meta with profit,
    kills_official, operator, operator_class, primary_weapon. Events of parts without a clock are
    left out (count them with :func:`unclocked`).
    """
    at = ["session", "no"]
    numbered = cut_lineage(numbered_events(on_clock(events, bases), width))
    start, end = F.col("kind") == "match_start", F.col("kind") == "extract"
    act = F.when(F.col("kind").isin("down", "loot"), F.col("src"))
    per = numbered.groupBy(*at).agg(
        F.min_by(F.struct("src", "t_start", F.col("at").alias("enter")), F.when(start, F.col("at"))).alias("s"),
        F.count_if(F.col("kind") == "down").alias("downs"),
        F.count_if(F.col("kind") == "loot").alias("loots"),
        F.coalesce(F.min(act) != F.max(act), F.lit(False)).alias("cross_part"),
        F.min_by(
            F.struct(F.col("at").alias("abs_end"), "ok", "profit_text", "kills_text"),
            F.when(end, F.struct("at", "src", "t_start")),
        ).alias("x"),
    ).select(*at, "s.*", "downs", "loots", "cross_part", "x.*")
    per = scan(
        per.withColumn("__no", F.col("no").cast("double")), lane("session", ("__no",), 1024.0),
        following={"next_enter": F.col("enter")},
    )
    bursts = (
        gap_groups(
            numbered.where(F.col("kind") == "down").select(*at, "t_start"),
            lane(("session", "no"), "t_start", width), BURST_GAP, "burst",
        )
        .groupBy(*at, "burst")
        .agg(F.count("*").alias("size"))
        .where(F.col("size") >= 2)
        .groupBy(*at)
        .agg(
            F.count("*").alias("multi"),
            F.array_sort(F.collect_list(F.struct("burst", "size"))).getField("size").alias(
                "multi_sizes"
            ),
        )
    )
    later = F.col("line_no") if "line_no" in events.columns else F.col("t_end")
    gear = events.where(F.col("kind") == "loadout").groupBy("session", "src", "t_start").agg(
        F.max_by(
            F.struct("meta.operator", "meta.operator_class", "meta.primary_weapon"), later
        ).alias("g")
    )
    m = per.join(bursts, at, "left").join(gear, ["session", "src", "t_start"], "left")

    def gear_text(name: str) -> Column:
        return F.coalesce(F.col("g").getField(name), F.lit("")).alias(name)

    won = F.col("ok")
    profit = F.when(won & (F.coalesce("profit_text", F.lit("")) != ""), tx.to_count(F.col("profit_text")))
    return m.select(
        "session", "no", "src", "t_start", "enter", "next_enter",
        (F.coalesce("abs_end", "next_enter") - F.col("enter")).alias("dur"),
        gear_text("operator"), gear_text("operator_class"), gear_text("primary_weapon"),
        "downs", F.coalesce("multi", F.lit(0)).alias("multi"),
        F.coalesce("multi_sizes", F.array().cast("array<bigint>")).alias("multi_sizes"),
        F.when(won, tx.to_count(F.col("kills_text"))).alias("kills_official"),
        "loots", "ok", profit.alias("profit"), "cross_part",
    )


def unclocked(events: DataFrame, bases: DataFrame) -> DataFrame:
    """How many events per session and kind have no clock and stay out of the matches."""
    timed = on_clock(events, bases)
    return timed.where(F.col("abs_t").isNull()).groupBy("session", "kind").agg(
        F.count("*").alias("n")
    )


def report_totals(matches: DataFrame) -> DataFrame:
    """Totals per session and over everything (session NULL)."""
    return matches.rollup("session").agg(
        F.sum("downs").alias("downs"),
        F.sum("multi").alias("multi"),
        F.sum("loots").alias("loots"),
        F.count_if(F.col("ok")).alias("ok"),
        F.count("*").alias("matches"),
        F.sum(F.coalesce("profit", F.lit(0))).alias("profit"),
    )


def report_lines(matches: DataFrame) -> DataFrame:
    """Markdown row per match (line_no = match number) and the totals row of each session."""
    c = F.col
    sizes = F.array_join(F.transform("multi_sizes", lambda x: x.cast("string")), "+")
    multi = F.when(
        c("multi") > 0, F.concat(c("multi").cast("string"), F.lit("次("), sizes, F.lit(")"))
    ).otherwise("0")
    profit = (
        F.when(c("profit").isNotNull(), F.format_number("profit", 0))
        .when(~c("ok"), "0（装备损失）")
        .otherwise("-")
    )
    operator = F.when(
        c("operator") != "", F.concat("operator", F.lit("("), "operator_class", F.lit(")"))
    ).otherwise("-")
    cells = [
        c("no").cast("string"), clock.wall_clock(c("enter")), operator,
        F.when(c("primary_weapon") != "", c("primary_weapon")).otherwise("-"),
        F.coalesce(clock.minutes_text(c("dur")), F.lit("-")),
        c("downs").cast("string"), multi,
        F.coalesce(c("kills_official").cast("string"), F.lit("-")), c("loots").cast("string"),
        F.when(c("ok"), "✅").when(~c("ok"), "❌").otherwise("-"), profit,
    ]
    rows = matches.select(
        "session", c("no").alias("line_no"),
        F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"),
    )
    total = report_totals(matches).where(c("session").isNotNull()).select(
        "session", (c("matches") + 1).alias("line_no"),
        F.format_string(
            "| **合计** | | | | | **%d** | **%d次** | | **%d** | **%d/%d** | **%s** |",
            "downs", "multi", "loots", "ok", "matches", F.format_number("profit", 0),
        ).alias("line"),
    )
    return rows.unionByName(total)


REPORT_HEAD = [
    "| 局 | 进入 | 干员 | 主武器 | 时长 | 击倒 | 多击倒(20s) | 官方击杀 | 拾取 | 撤离 | 本局收获 |",
    "| --- | --- | --- | --- | --- | --- | --- | --- | --- | --- | --- |",
]


def report_document(matches: DataFrame) -> DataFrame:
    """One markdown text per session."""
    body = F.array_sort(F.collect_list(F.struct("line_no", "line"))).getField("line")
    text = F.array_join(F.concat(F.array(*[F.lit(x) for x in REPORT_HEAD]), body), "\n")
    return report_lines(matches).groupBy("session").agg(F.concat(text, F.lit("\n")).alias("markdown"))


def session_gear(events: DataFrame, bases: DataFrame, width: float = 86400.0) -> DataFrame:
    """Hero and weapons per match: first hero, weapons once each in order of first sight."""
    timed = on_clock(events, bases)
    marks = match_starts(timed, width).select("session", "enter")
    rows = timed.where((F.col("kind") == "loadout") & F.col("abs_t").isNotNull()).select(
        "session", "abs_t", "src", F.col("meta.hero").alias("hero"),
        F.col("meta.weapons").alias("weapons"),
    )
    inside = count_in_spans(marks, rows, ["session"], "enter", "abs_t", width)
    heroes = inside.where(F.coalesce("hero", F.lit("")) != "").groupBy("session", "no").agg(
        F.min_by("hero", F.struct("abs_t", "src", "hero")).alias("hero")
    )
    seen = (
        inside.select("session", "no", "abs_t", F.posexplode("weapons").alias("pos", "weapon"))
        .groupBy("session", "no", "weapon")
        .agg(F.min(F.struct("abs_t", "pos")).alias("first"))
        .groupBy("session", "no")
        .agg(F.array_sort(F.collect_list(F.struct("first", "weapon"))).getField("weapon").alias("weapons"))
    )
    return heroes.join(seen, ["session", "no"], "full")


def span_numbers(events: DataFrame, targets: DataFrame, t: str, width: float = 3600.0) -> DataFrame:
    """Targets with the number of the match running at ``t`` on their source, NULL before any."""
    keys = ["session", "src"]
    marks = events.where(F.col("kind") == "match_start").select(
        *keys, F.col("t_start").alias("__t"), F.lit(0).alias("__side")
    )
    rows = targets.select(
        *keys, F.col(t).alias("__t"), F.lit(1).alias("__side"), F.struct("*").alias("__e")
    )
    both = marks.unionByName(rows, allowMissingColumns=True)
    n = F.when(F.col("__side") == 0, 1).otherwise(0).cast("long")
    out = scan(both, lane(keys, ("__t", "__side"), width), running={"match_no": n})
    return out.where(F.col("__side") == 1).select(
        "__e.*", F.when(F.col("match_no") > 0, F.col("match_no")).alias("match_no")
    )

