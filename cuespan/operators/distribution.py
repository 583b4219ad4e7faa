"""Exact percentiles and strict ranks over groups of any size.

Values are first counted (map-side combined), so copies of one value cost one row. The distinct
values are then scanned in order in slices of the value axis; no group is ever buffered whole.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuespan.operators.ordered import Lane, scan


def value_slice(v: Column, unit: float = 1e-3, per_octave: int = 512) -> Column:
    """Monotone slice number of a value, finer near zero; a pure function of the value."""
    mag = F.floor(F.log2(F.lit(1.0) + F.abs(v) / F.lit(unit)) * F.lit(per_octave))
    return F.when(v < 0, -mag).otherwise(mag)


def _ordered_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    counted = (
        df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
        .groupBy(*keys, F.col(value).cast("double").alias("__value"))
        .agg(F.count("*").alias("__n"))
    )
    ln = Lane(tuple(keys), ("__value",), 1.0, chunk=value_slice(F.col("__value")))
    return scan(counted, ln, running={"__upto": F.col("__n")}, total={"__all": F.col("__n")})


def percentiles(
    df: DataFrame, keys: Sequence[str], value: str, wanted: Mapping[str, float]
) -> DataFrame:
    """One row per key with each wanted percentile, linear between the two nearest ranks."""
    ranked = _ordered_counts(df, keys, value)
    below, upto, n = F.col("__upto") - F.col("__n"), F.col("__upto"), F.col("__all")
    aggs = []
    for name, p in wanted.items():
        pos = F.lit(float(p)) * (n - 1)
        for tag, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            hit = F.when((below <= at) & (at < upto), F.col("__value"))
            aggs.append(F.max(hit).alias(f"__{tag}_{name}"))
    aggs.append(F.max(n).alias("__count"))
    got = ranked.groupBy(*keys).agg(*aggs)

    def lerp(name: str, p: float) -> Column:
        pos = F.lit(float(p)) * (F.col("__count") - 1)
        lo, hi = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        return (lo + (hi - lo) * (pos - F.floor(pos))).alias(name)

    return got.select(*keys, *[lerp(name, p) for name, p in wanted.items()])


def strict_rank(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    name: str = "rank01",
    reference: Column | None = None,
    empty: float = 0.5,
) -> DataFrame:
    """Share of the key's reference values strictly below the row's value.

    ``reference`` picks the rows that form the distribution (all by default). A missing value or an
    empty reference gives ``empty``.
    """
    keys = list(keys)
    in_ref = F.lit(True) if reference is None else F.coalesce(reference, F.lit(False))
    v = F.col(value).cast("double")
    counted = (
        df.where(v.isNotNull())
        .groupBy(*keys, v.alias("__value"))
        .agg(F.sum(F.when(in_ref, 1).otherwise(0)).cast("long").alias("__n"))
    )
    ln = Lane(tuple(keys), ("__value",), 1.0, chunk=value_slice(F.col("__value")))
    ranked = scan(counted, ln, running={"__upto": F.col("__n")}, total={"__all": F.col("__n")})
    share = F.when(F.col("__all") > 0, (F.col("__upto") - F.col("__n")) / F.col("__all"))
    ranked = ranked.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__value"), share.alias(name)
    )
    cond = v.eqNullSafe(F.col("__value"))
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    joined = df.join(ranked, cond, "left").drop("__value", *[f"__k_{k}" for k in keys])
    return joined.withColumn(name, F.coalesce(F.col(name), F.lit(float(empty))))


def strict_ranks(
    df: DataFrame,
    keys: Sequence[str],
    ids: Sequence[str],
    signals: Mapping[str, str],
    reference: Column | None = None,
    empty: float = 0.5,
) -> DataFrame:
    """Strict ranks of several columns at once; ``ids`` name a row within its key.

    ``signals`` maps new column names to value columns. The columns are stacked, ranked together in
    one pass keyed by column, and folded back by row, so the input is read three times however many
    columns there are.
    """
    keys, ids = list(keys), list(ids)
    in_ref = F.lit(True) if reference is None else F.coalesce(reference, F.lit(False))
    stacked = df.select(
        *keys, *ids, in_ref.alias("__ref"),
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(n).alias("sig"), F.col(c).cast("double").alias("val"))
                    for n, c in signals.items()
                ]
            )
        ).alias("__x"),
    ).select(*keys, *ids, "__ref", F.col("__x.sig").alias("__sig"), F.col("__x.val").alias("__val"))
    ranked = strict_rank(
        stacked.where(F.col("__val").isNotNull()), [*keys, "__sig"], "__val", "__rank",
        reference=F.col("__ref"), empty=empty,
    )
    folded = ranked.groupBy(*keys, *ids).agg(
        *[F.max(F.when(F.col("__sig") == n, F.col("__rank"))).alias(n) for n in signals]
    )
    out = df.join(folded, [*keys, *ids], "left")
    return out.select(
        *df.columns, *[F.coalesce(F.col(n), F.lit(float(empty))).alias(n) for n in signals]
    )
