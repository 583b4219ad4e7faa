"""Greedy picks by rank, decided in parallel.

A greedy pick takes rows in the order of their rank and skips one that meets a row already taken. What becomes of a row depends on the
better rows that it meets, and on nothing else; so all rows whose better neighbours are decided can be decided at once.

The axis is cut into slices. A row goes to every slice that it or its reach touches; a task streams a slice in rank order and
says of each row that it is out (it meets a taken row), free (it meets none, and none that waits) or waiting. A row that lies in
one slice is taken if it is free there; one that lies in several if it is free in all. Only chains of rows that reach
over a slice's edge wait for the next round, whose slices are twice as wide and cut elsewhere. A task
holds the taken and the waiting spans of its slice, which are disjoint, never its rows.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuespan.session import stored

OUT, WAITING, FREE = 0, 1, 2


class Spans:
    """Spans in time order, none of which overlaps another."""

    def __init__(self, apart: float) -> None:
        self.apart, self.spans = apart, []

    def meets(self, lo: float, hi: float) -> bool:
        """Whether a span lies less than ``apart`` from one of these (overlaps it, for 0)."""
        at = bisect.bisect_right(self.spans, (lo, hi))
        before = at > 0 and not lo - self.spans[at - 1][1] >= self.apart
        return before or (at < len(self.spans) and not self.spans[at][0] - hi >= self.apart)

    def add(self, lo: float, hi: float) -> None:
        bisect.insort(self.spans, (lo, hi))

    def cover(self, lo: float, hi: float) -> None:
        """Add a span that may overlap others: those become one."""
        a = b = bisect.bisect_left(self.spans, (lo, hi))
        while a > 0 and self.spans[a - 1][1] > lo:
            a -= 1
        while b < len(self.spans) and self.spans[b][0] < hi:
            b += 1
        if a < b:
            lo, hi = min(lo, self.spans[a][0]), max(hi, *(s[1] for s in self.spans[a:b]))
        self.spans[a:b] = [(lo, hi)]


def _verdicts(rows: DataFrame, keys: list[str], order: list[Column], apart: float, width: float, shift: float) -> DataFrame:
    """``__id`` and ``__v`` of every undecided row, over all slices that it touches."""
    slice_of = lambda t: F.floor((t + F.lit(shift)) / F.lit(width))
    touched = F.sequence(slice_of(F.col("__lo") - apart), slice_of(F.greatest("__lo", "__hi") + apart))
    dealt = rows.withColumn("__of", touched).withColumn("__n", F.size("__of")).withColumn("__slice", F.explode("__of"))
    by = [*keys, "__slice"]
    dealt = dealt.repartition(*by).sortWithinPartitions(*by, F.desc("__taken"), *order, "__id")
    schema = pa.schema([("__id", pa.int64()), ("__v", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, taken, waiting = None, Spans(apart), Spans(apart)
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            ids, out = [], []
            for *here, i, lo, hi, n, known in zip(*columns, strict=True):
                if here != group:
                    group, taken, waiting = here, Spans(apart), Spans(apart)
                if known:
                    taken.add(lo, hi)
                    continue
                if taken.meets(lo, hi):
                    v = OUT
                elif waiting.meets(lo, hi):
                    v = WAITING
                    waiting.cover(lo, hi)
                else:
                    v = FREE
                    (taken.add if n == 1 else waiting.cover)(lo, hi)
                ids.append(i)
                out.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.int32())], schema=schema)

    found = dealt.select(*by, "__id", "__lo", "__hi", "__n", "__taken").mapInArrow(run, "__id long, __v int")
    return found.groupBy("__id").agg(F.min("__v").alias("__v"))


def _greedy(df: DataFrame, keys: Sequence[str], lo: str, hi: str, order: list[Column], apart: float, width: float) -> DataFrame:
    # written out: rows are told apart by a number that must not change between rounds
    rows = stored(df.withColumn("__id", F.monotonically_increasing_id()))
    use = [F.col(c).cast("double") for c in (lo, hi)]
    here = [c.isNotNull() & ~F.isnan(c) for c in use]
    left = rows.where(here[0] & here[1]).withColumns({"__lo": use[0], "__hi": use[1], "__taken": F.lit(False)})
    shift = 0.0
    while True:
        told = _verdicts(left, list(keys), order, apart, width, shift)
        known = left.join(told, "__id", "left").where("__v is null or __v > 0")
        left = stored(known.withColumn("__taken", F.coalesce(F.col("__v") == FREE, F.lit(True))).drop("__v"))
        if left.where("not __taken").isEmpty():
            return left.drop("__id", "__lo", "__hi", "__taken")
        width *= 2
        shift = width / 3 - shift


def keep_apart(df: DataFrame, keys: Sequence[str], t: str, order: Sequence[str], radius: float, width: float = 600.0) -> DataFrame:
    """Greedy pick in the given order: skip a row closer than ``radius`` to one already kept.

    Rows that agree in all of ``order`` stand in the order of the input. Rows without a time are never kept.
    """
    return _greedy(df, keys, t, t, [F.col(c) for c in order], float(radius), float(width))


def keep_disjoint(df: DataFrame, keys: Sequence[str], lo: str, hi: str, order: Sequence[str], ascending: Sequence[bool], width: float = 600.0) -> DataFrame:
    """Greedy pick of spans in the given order, skipping those that overlap a kept one; spans may touch.

    A span may be longer than ``width``. Spans without an end are never kept.
    """
    by = [F.col(c) if up else F.desc(c) for c, up in zip(order, ascending, strict=True)]
    return _greedy(df, keys, lo, hi, by, 0.0, float(width))
