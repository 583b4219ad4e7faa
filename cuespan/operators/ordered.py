"""Ordered operators that never need a whole key in one task.

A plain ``Window.partitionBy(src).orderBy(t)`` sorts every row of a source in one task, so a
source that holds a third of the table decides the run time of the job. Everything here works in
two levels instead:

1. rows are windowed inside ``(keys, chunk)``, where the chunk is a slice of the order axis;
2. each chunk is reduced (map-side combined) to one summary row, a window over those few rows per
   key yields what has to be carried into each chunk, and the carry is joined back.

The wide rows are shuffled once; the summaries are small and AQE broadcasts them when they are
under the broadcast threshold.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_CHUNK = "__chunk"
_LANE = "__lane"


@dataclass(frozen=True)
class Lane:
    """Rows of one key in order; ``order[0]`` is numeric and is cut every ``width`` units."""

    keys: tuple[str, ...]
    order: tuple[str, ...]
    width: float
    chunk: Column | None = field(default=None, compare=False)

    def chunk_column(self) -> Column:
        if self.chunk is not None:
            return self.chunk
        return F.floor(F.col(self.order[0]) / F.lit(float(self.width)))

    def ordering(self) -> Column:
        if len(self.order) == 1:
            return F.col(self.order[0])
        return F.struct(*[F.col(c) for c in self.order])


def lane(keys: Sequence[str] | str, order: Sequence[str] | str, width: float) -> Lane:
    keys = (keys,) if isinstance(keys, str) else tuple(keys)
    order = (order,) if isinstance(order, str) else tuple(order)
    return Lane(keys, order, width)


def _laned(df: DataFrame, ln: Lane) -> DataFrame:
    """Rows with their chunk and the lane they belong to: keys and chunk as one column that is never null.

    Windows, summary and join all use this one column with plain equality, so the partitioning and
    sort of the window serve the join as well.
    """
    rows = df.withColumn(_CHUNK, ln.chunk_column())
    return rows.withColumn(_LANE, F.struct(*ln.keys, _CHUNK))


def _attach(rows: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of per-chunk carry columns on the lane."""
    return rows.join(carry.drop(*keys, _CHUNK), _LANE, "left").drop(_LANE)


def scan(
    df: DataFrame,
    ln: Lane,
    *,
    last: Mapping[str, Column] | None = None,
    prev: Mapping[str, Column] | None = None,
    following: Mapping[str, Column] | None = None,
    upcoming: Mapping[str, Column] | None = None,
    running: Mapping[str, Column] | None = None,
    total: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add ordered columns per key.

    ``last``: latest non-null value up to and including the row; ``prev``/``following``: value of
    the row before/after; ``upcoming``: first non-null value from the row on; ``running``:
    inclusive cumulative sum; ``total``: sum over the whole key.
    """
    last, prev, following = last or {}, prev or {}, following or {}
    upcoming, running, total = upcoming or {}, running or {}, total or {}
    keys = list(ln.keys)
    rows = _laned(df, ln)
    inputs = {**last, **prev, **following, **upcoming, **running, **total}
    rows = rows.select("*", *[e.alias(f"__v_{n}") for n, e in inputs.items()])
    o = ln.ordering()

    def v(n: str) -> Column:
        return F.col(f"__v_{n}")

    aggs = [F.max_by(v(n), F.when(v(n).isNotNull(), o)).alias(f"__s_{n}") for n in last]
    aggs += [F.max_by(F.struct(v(n)), o).alias(f"__s_{n}") for n in prev]
    aggs += [F.min_by(F.struct(v(n)), o).alias(f"__s_{n}") for n in following]
    aggs += [F.min_by(v(n), F.when(v(n).isNotNull(), o)).alias(f"__s_{n}") for n in upcoming]
    aggs += [F.sum(v(n)).alias(f"__s_{n}") for n in [*running, *total]]
    summary = rows.groupBy(_LANE).agg(*aggs).select("*", f"{_LANE}.*")

    part = W.partitionBy(*keys)
    fwd = part.orderBy(_CHUNK)
    back = part.orderBy(F.col(_CHUNK).desc())
    before = fwd.rowsBetween(W.unboundedPreceding, -1)
    after = back.rowsBetween(W.unboundedPreceding, -1)

    def s(n: str) -> Column:
        return F.col(f"__s_{n}")

    carry_cols = [F.last(s(n), True).over(before).alias(f"__c_{n}") for n in last]
    carry_cols += [F.lag(s(n)).over(fwd).getField(f"__v_{n}").alias(f"__c_{n}") for n in prev]
    carry_cols += [F.lead(s(n)).over(fwd).getField(f"__v_{n}").alias(f"__c_{n}") for n in following]
    carry_cols += [F.last(s(n), True).over(after).alias(f"__c_{n}") for n in upcoming]
    carry_cols += [
        F.coalesce(F.sum(s(n)).over(before), F.lit(0)).alias(f"__c_{n}") for n in running
    ]
    carry_cols += [F.sum(s(n)).over(part).alias(f"__c_{n}") for n in total]
    carry = summary.select(_LANE, *keys, _CHUNK, *carry_cols)

    inner = W.partitionBy(_LANE)
    asc = inner.orderBy(*ln.order)
    desc = inner.orderBy(*[F.col(c).desc() for c in ln.order])
    upto = asc.rowsBetween(W.unboundedPreceding, W.currentRow)
    onward = desc.rowsBetween(W.unboundedPreceding, W.currentRow)
    local = [F.last(v(n), True).over(upto).alias(f"__l_{n}") for n in last]
    local += [F.lag(F.struct(v(n))).over(asc).alias(f"__l_{n}") for n in prev]
    local += [F.lead(F.struct(v(n))).over(asc).alias(f"__l_{n}") for n in following]
    local += [F.last(v(n), True).over(onward).alias(f"__l_{n}") for n in upcoming]
    local += [F.sum(v(n)).over(upto).alias(f"__l_{n}") for n in running]
    rows = rows.select("*", *local)

    joined = _attach(rows, carry, keys)

    def result(n: str) -> Column:
        mine, carried = F.col(f"__l_{n}"), F.col(f"__c_{n}")
        if n in prev or n in following:
            return F.when(mine.isNotNull(), mine.getField(f"__v_{n}")).otherwise(carried).alias(n)
        if n in running:
            return (F.coalesce(mine, F.lit(0)) + carried).alias(n)
        if n in total:
            return carried.alias(n)
        return F.coalesce(mine, carried).alias(n)

    keep = [c for c in df.columns if c not in inputs]
    return joined.select(*keep, *[result(n) for n in inputs])


def number_rows(df: DataFrame, ln: Lane, name: str = "no") -> DataFrame:
    """1-based position inside the key (a skew-proof ``row_number``); order must be total."""
    return scan(df, ln, running={name: F.lit(1).cast("long")})


def gap_groups(
    df: DataFrame, ln: Lane, gap: float, name: str = "grp", strict: bool = False
) -> DataFrame:
    """Number the runs of rows whose distance to the row before is at most ``gap``.

    A distance of exactly ``gap`` stays together (with ``strict`` it starts a new group). Groups
    are numbered from 1 inside the key.
    """
    keys = list(ln.keys)
    t = F.col(ln.order[0])
    g = F.lit(float(gap))

    def far(d: Column) -> Column:
        return d >= g if strict else d > g

    rows = _laned(df, ln)
    inner = W.partitionBy(_LANE).orderBy(*ln.order)
    opens = F.when(far(t - F.lag(t).over(inner)), F.lit(1).cast("long")).otherwise(F.lit(0))
    rows = rows.withColumn("__opens", opens).withColumn(
        "__local", F.sum("__opens").over(inner.rowsBetween(W.unboundedPreceding, W.currentRow))
    )
    summary = rows.groupBy(_LANE).agg(
        F.min(t).alias("__first"), F.max(t).alias("__last"), F.max("__local").alias("__n")
    ).select("*", f"{_LANE}.*")
    fwd = W.partitionBy(*keys).orderBy(_CHUNK)
    prior = F.lag("__last").over(fwd)
    summary = summary.withColumn(
        "__edge", F.when(prior.isNull() | far(F.col("__first") - prior), 1).otherwise(0)
    )
    upto = fwd.rowsBetween(W.unboundedPreceding, W.currentRow)
    before = fwd.rowsBetween(W.unboundedPreceding, -1)
    carry = summary.select(
        _LANE,
        *keys,
        _CHUNK,
        (
            F.sum("__edge").over(upto) + F.coalesce(F.sum("__n").over(before), F.lit(0))
        ).alias("__offset"),
    )
    return (
        _attach(rows, carry, keys)
        .withColumn(name, F.col("__local") + F.col("__offset"))
        .drop(_CHUNK, "__opens", "__local", "__offset")
    )


def asof(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_t: str,
    right_t: str,
    payload: Sequence[str],
    width: float,
    *,
    name: str = "hit",
    forward: bool = False,
    strict: bool = False,
    tie: str | None = None,
) -> DataFrame:
    """Left rows with the struct ``name`` of the nearest right row before (or after) them.

    ``strict`` leaves out right rows at the very instant of the left row. Among right rows of one
    instant the one latest in ``tie`` wins looking back, the earliest looking ahead. It is a union
    and a carried ``last``: no pair is ever built.
    """
    keys = list(keys)
    right_first = (not forward) != strict
    r_side, l_side = (0, 1) if right_first else (1, 0)
    r = right.select(
        *keys,
        F.col(right_t).cast("double").alias("__t"),
        F.lit(r_side).alias("__side"),
        (F.col(tie) if tie else F.lit(0)).cast("long").alias("__tie"),
        F.struct(F.col(right_t).alias(right_t), *[F.col(c) for c in payload if c != right_t]).alias(
            "__payload"
        ),
    )
    lf = left.select(
        *keys,
        F.col(left_t).cast("double").alias("__t"),
        F.lit(l_side).alias("__side"),
        F.lit(0).cast("long").alias("__tie"),
        F.struct(*left.columns).alias("__left"),
    )
    both = lf.unionByName(r, allowMissingColumns=True)
    ln = lane(keys, ("__t", "__side", "__tie"), width)
    spec = {name: F.col("__payload")}
    out = scan(both, ln, upcoming=spec) if forward else scan(both, ln, last=spec)
    return out.where(F.col("__left").isNotNull()).select("__left.*", name)


def has_within(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    lo: str,
    hi: str,
    right_t: str,
    width: float,
    *,
    name: str = "has",
    open_hi: bool = False,
) -> DataFrame:
    """Flag left rows whose interval ``[lo, hi]`` holds any right instant.

    The first right instant from ``lo`` on decides, so one look-ahead per row replaces the range
    join.
    """
    out = asof(left, right, keys, lo, right_t, [right_t], width, name="__first", forward=True)
    first = F.col("__first").getField(right_t)
    inside = first < F.col(hi) if open_hi else first <= F.col(hi)
    return out.withColumn(name, F.coalesce(inside, F.lit(False))).drop("__first")


def nearest(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_t: str,
    right_t: str,
    payload: Sequence[str],
    width: float,
    *,
    tolerance: float,
    name: str = "hit",
    tie: str | None = None,
) -> DataFrame:
    """Nearest right row in either direction within ``tolerance``; the earlier one wins a tie."""
    keys = list(keys)
    fields = list(dict.fromkeys([right_t, *payload]))
    rest = [c for c in fields if c != right_t]
    first = right.groupBy(*keys, right_t).agg(
        F.min_by(F.struct(F.lit(1).alias("__one"), *rest), F.col(tie) if tie else F.col(right_t)).alias(
            "__r"
        )
    )
    first = first.select(*keys, right_t, *[F.col("__r").getField(c).alias(c) for c in rest])
    # one union and one scan for both neighbours: right rows stand ahead of left rows of their instant
    payload_of = F.struct(*fields).alias("__payload")
    both = left.select(*keys, F.col(left_t).cast("double").alias("__t"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__left")).unionByName(
        first.select(*keys, F.col(right_t).cast("double").alias("__t"), F.lit(0).alias("__side"), payload_of), allowMissingColumns=True
    )
    found = F.col("__payload")
    out = scan(both, lane(keys, ("__t", "__side"), width), last={"__back": found}, upcoming={"__ahead": found})
    out = out.where(F.col("__left").isNotNull()).select("__left.*", "__back", "__ahead")
    t = F.col(left_t)
    db = t - F.col("__back").getField(right_t)
    da = F.col("__ahead").getField(right_t) - t
    best = F.when(db.isNotNull() & (da.isNull() | (db <= da)), F.col("__back")).otherwise(
        F.col("__ahead")
    )
    dist = F.least(db, da)
    return out.withColumn(name, F.when(dist <= F.lit(float(tolerance)), best)).drop(
        "__back", "__ahead"
    )
