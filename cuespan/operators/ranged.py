"""Operators over range partitions: numbers of a whole table, hashes of long listings.

Spark deals the rows by ranges of an order, so no key and no table meets in one task; what has to be
carried from range to range is one count, or one short text, per range.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from cuespan.operators.ordered import Lane, number_rows
from cuespan.session import stored

LINES_A_BLOCK = 256


def number_all(df: DataFrame, order: Sequence[str], name: str = "no") -> DataFrame:
    """1-based position of every row in the order of the whole table; ``order`` must be total.

    The rows are written once with the range they fell in, as a second sampling could cut the ranges
    elsewhere. One count per range meets in one task, never the rows. Nulls come first.
    """
    rows = stored(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    return number_rows(rows, Lane((), tuple(order), 1.0, F.col("__range")), name).drop("__range", "__chunk")


def listing_digests(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    line: Column,
    algorithm: str,
    *,
    lead: Column | None = None,
    sep: str = "",
    name: str = "digest",
) -> DataFrame:
    """Hex digest per key of ``lead`` and the key's lines in order, joined by ``sep``.

    Ranges of (key, order) join their lines to blocks in parallel, so a long listing is spread over
    tasks; one digest a key is then updated block by block. No listing is ever held: a task keeps a
    batch of blocks. Null lines are left out, as is a null lead; a key without lines hashes its lead.
    """
    keys = list(keys)
    group = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    by = [f"__o{i}" for i in range(len(order))]
    rows = df.select(
        *keys, group.alias("__g"), *[c.alias(b) for c, b in zip(order, by, strict=True)],
        (F.lit(None) if lead is None else lead).cast("string").alias("__lead"), line.alias("__line"),
    )
    dealt = rows.repartitionByRange("__g", *by).sortWithinPartitions("__g", *by)
    dealt = dealt.withColumn("__at", F.spark_partition_id()).drop(*by)
    fields = [df.schema[k] for k in keys]
    text = [t.StructField(n, t.StringType()) for n in ("__g", "__lead", "__text")]
    place = [t.StructField("__at", t.IntegerType()), t.StructField("__no", t.LongType())]
    blocks = dealt.mapInArrow(_block_maker(keys, sep), t.StructType([*fields, *text, *place]))
    met = blocks.repartition("__g").sortWithinPartitions("__g", "__at", "__no")
    return met.mapInArrow(
        _hasher(keys, algorithm, sep, name), t.StructType([*fields, t.StructField(name, t.StringType())])
    )


def _block_maker(keys: list[str], sep: str):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0
        for b in batches:
            n = b.num_rows
            if n == 0:
                continue
            g = b.column("__g")
            turns = pc.not_equal(g.slice(1), g.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            starts = np.union1d(np.arange(0, n, LINES_A_BLOCK), np.flatnonzero(turns) + 1)
            ends = np.append(starts[1:], n)
            lines = b.column("__line").to_pylist()
            texts = []
            for i, j in zip(starts, ends, strict=True):
                kept = [x for x in lines[i:j] if x is not None]
                texts.append(sep.join(kept) if kept else None)
            first = pa.array(starts)
            kept_columns = [*keys, "__g", "__lead"]
            yield pa.RecordBatch.from_arrays(
                [b.column(c).take(first) for c in kept_columns]
                + [pa.array(texts, pa.string()), b.column("__at").take(first),
                   pa.array(np.arange(made, made + len(starts)), pa.int64())],
                names=[*kept_columns, "__text", "__at", "__no"],
            )
            made += len(starts)

    return blocks


def _hasher(keys: list[str], algorithm: str, sep: str, name: str):
    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = current = row = None
        fields, texts = None, False

        def finished(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(rows, pa.schema([*fields, pa.field(name, pa.string())]))

        for b in batches:
            fields = [b.schema.field(k) for k in keys]
            done = []
            groups, leads, blocks = (b.column(c).to_pylist() for c in ("__g", "__lead", "__text"))
            for i, g in enumerate(groups):
                if state is None or g != current:
                    if state is not None:
                        done.append(row | {name: state.hexdigest()})
                    state, current, texts = hashlib.new(algorithm), g, False
                    row = {k: b.column(k)[i].as_py() for k in keys}
                    state.update((leads[i] or "").encode())
                if blocks[i] is not None:
                    if texts:
                        state.update(sep.encode())
                    state.update(blocks[i].encode())
                    texts = True
            if done:
                yield finished(done)
        if state is not None:
            yield finished([row | {name: state.hexdigest()}])

    return digests
