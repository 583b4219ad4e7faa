"""Interval joins through bucket keys, never a nested loop."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuespan.operators.ordered import lane, number_rows, scan


STEP = 4.0
TOP = 40


def stab(
    points: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    t: str,
    lo: str,
    hi: str,
    width: float,
    *,
    open_hi: bool = False,
    levels: int | None = None,
    rows_a_cell: int | None = None,
) -> DataFrame:
    """Pairs of a point and an interval that holds it.

    The axis is cut into cells of ``width``, of four times ``width``, and so on. An interval is listed in cells
    about as long as itself, in two of them at most (three where a length rounds), however long it is. A point is
    listed once for each level that has intervals, usually one; the levels are a scalar subquery, at most 41 numbers.
    The join is an equi join on keys, level and cell. Without an upper or lower end (infinite, NaN) an
    interval is at the top level, whose two cells hold every point.

    ``levels`` spares the look at the intervals where their rule keeps them short: only so many levels are used, and
    a longer interval is listed in more cells of the highest of them.

    With ``rows_a_cell``, cells with more points than that are counted first and split by a hash of the point in as
    many parts as they need; only these cells' intervals are listed several times.
    """
    keys = list(keys)
    w = float(width)
    length = F.col(hi) - F.col(lo)
    level = F.when(F.isnan(length), TOP).when(length <= w, 0).otherwise(F.ceil(F.log(STEP, length / w)))
    top = TOP if levels is None else levels - 1
    iv = intervals.where(F.col(hi) >= F.col(lo)).withColumn("__level", F.least(F.lit(top), level).cast("int"))
    if levels is None:
        used_levels = iv.agg(F.collect_set("__level")).scalar()
    else:
        used_levels = F.array(*[F.lit(i) for i in range(levels)])

    def cell(at: str, level: str) -> Column:
        c = F.floor(F.col(at) / (F.lit(w) * F.pow(F.lit(STEP), F.col(level))))
        return F.when(F.col(level) == TOP, F.least(F.lit(0), F.greatest(F.lit(-1), c))).otherwise(c).cast("long")

    iv = iv.withColumn("__cell", F.explode(F.sequence(cell(lo, "__level"), cell(hi, "__level"))))
    iv = iv.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys], "__level", "__cell",
        *[c for c in intervals.columns if c not in keys],
    )
    pt = points.withColumn("__pl", F.explode(used_levels)).withColumn("__pc", cell(t, "__pl"))
    cond = (F.col("__pl") == F.col("__level")) & (F.col("__pc") == F.col("__cell"))
    if rows_a_cell is not None:
        hot = pt.groupBy(*keys, "__pl", "__pc").agg(F.count("*").alias("__n")).where(F.col("__n") > rows_a_cell)
        hot = hot.select(
            *[F.col(k).alias(f"__h_{k}") for k in keys], F.col("__pl").alias("__hl"), F.col("__pc").alias("__hc"),
            F.ceil(F.col("__n") / rows_a_cell).alias("__parts"),
        )
        parts = F.coalesce("__parts", F.lit(1).cast("long"))
        used = ["__hl", "__hc", "__parts", *[f"__h_{k}" for k in keys]]

        def at_hot(level: str, cell: str, prefix: str) -> Column:
            same = (F.col(level) == F.col("__hl")) & (F.col(cell) == F.col("__hc"))
            for k in keys:
                same = same & F.col(prefix + k).eqNullSafe(F.col(f"__h_{k}"))
            return same

        iv = iv.join(hot, at_hot("__level", "__cell", "__k_"), "left").withColumn(
            "__part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))
        ).drop(*used)
        pt = pt.join(hot, at_hot("__pl", "__pc", ""), "left").withColumn(
            "__pp", F.pmod(F.xxhash64(*points.columns), parts)
        ).drop(*used)
        cond = cond & (F.col("__pp") == F.col("__part"))
    inside = F.col(t) < F.col(hi) if open_hi else F.col(t) <= F.col(hi)
    cond = cond & (F.col(t) >= F.col(lo)) & inside
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    out = pt.join(iv, cond)
    return out.drop("__pl", "__pc", "__pp", "__level", "__cell", "__part", *[f"__k_{k}" for k in keys])


def count_in_spans(
    marks: DataFrame,
    events: DataFrame,
    keys: Sequence[str],
    mark_t: str,
    event_t: str,
    width: float,
    name: str = "no",
    mark_tie: str | None = None,
) -> DataFrame:
    """Number each event by the marks at or before it (half-open spans between marks).

    Returns the events with ``name`` = 1 for the first span, and rows before any mark dropped.
    """
    keys = list(keys)
    m = marks.select(*keys, F.col(mark_t).alias("__t"), F.lit(0).alias("__side"))
    e = events.select(
        *keys, F.col(event_t).alias("__t"), F.lit(1).alias("__side"), F.struct("*").alias("__e")
    )
    both = m.unionByName(e, allowMissingColumns=True)
    numbered = scan(
        both,
        lane(keys, ("__t", "__side"), width),
        running={name: F.when(F.col("__side") == 0, 1).otherwise(0).cast("long")},
    )
    return numbered.where((F.col("__side") == 1) & (F.col(name) > 0)).select("__e.*", name)


def merge_spans(
    df: DataFrame, keys: Sequence[str], lo: str, hi: str, width: float, name: str = "island"
) -> DataFrame:
    """Number the islands of overlapping spans; spans that only touch are not one island."""
    # the running maximum of the ends seen so far is kept per chunk and carried
    ck = F.floor(F.col("__pos") / F.lit(float(width)))
    rows = df.withColumn("__pos", F.col(lo)).withColumn("__ck", ck)
    per = rows.groupBy(*keys, "__ck").agg(F.max(hi).alias("__mx"))
    per = per.withColumn(
        "__carry",
        F.max("__mx").over(
            W.partitionBy(*keys).orderBy("__ck").rowsBetween(W.unboundedPreceding, -1)
        ),
    ).drop("__mx")
    inner = W.partitionBy(*keys, "__ck").orderBy("__pos", hi)
    rows = rows.withColumn(
        "__mine", F.max(hi).over(inner.rowsBetween(W.unboundedPreceding, -1))
    ).join(per, [*keys, "__ck"], "left")
    seen = F.greatest(F.col("__mine"), F.col("__carry"))
    rows = rows.withColumn("__opens", F.when(seen.isNull() | (seen <= F.col(lo)), 1).otherwise(0))
    rows = rows.drop("__ck", "__mine", "__carry")
    return scan(
        rows, lane(keys, ("__pos", hi), width), running={name: F.col("__opens").cast("long")}
    ).drop("__pos", "__opens")


def first_k(
    df: DataFrame, keys: Sequence[str], order: Sequence, k: int, rank: str = "__rank"
) -> DataFrame:
    """First k rows per key; the row-number filter is pushed below the shuffle by Spark."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


__all__ = ["stab", "count_in_spans", "merge_spans", "first_k", "number_rows"]
