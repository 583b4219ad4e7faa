"""Connected components by alternating large-star and small-star rounds over edges that tasks have contracted."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import batch_of, column_of, staged

_CHUNK = 200_000
_EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _trees(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same connections as a star each: every node but the least, and the least of its part."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    up = np.arange(len(nodes))
    while True:
        x, y = up[a], up[b]
        if (x == y).all():
            break
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while (up != (nxt := up[up])).any():
            up = nxt
    on = np.flatnonzero(up != np.arange(len(nodes)))
    return nodes[on], nodes[up[on]]


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (u, v) of a task, in chunks, as stars around their least nodes: as connected, and fewer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            held.append((column_of(batch, "u").to_numpy(), column_of(batch, "v").to_numpy()))
            size += batch.num_rows
            if size >= _CHUNK:
                yield batch_of(_EDGES, _trees(*map(np.concatenate, zip(*held, strict=True))))
                held, size = [], 0
        if held:
            yield batch_of(_EDGES, _trees(*map(np.concatenate, zip(*held, strict=True))))

    return edges.mapInArrow(run, "u long, v long")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Every node hands its neighbours to the smallest of them and itself. Only the minimum travels: a
    grouped minimum (combined before the shuffle) and a join by the node, so no neighbour list is built. The minima are
    written out: both sides of the join are then plain shuffles, of which Spark splits what is skewed."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if large else both.where("v < u")
    least = staged(near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")
    far = both.where("v > u") if large else near
    moved = far.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        moved = moved.union(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node``, ``root`` for every node of an edge between different nodes; root is the component's least.

    Rounds repeat until no edge changes; a chain of n nodes takes about log n of them. Nodes without
    an edge are not returned: the caller keeps them as their own component. Edges with a null end and
    loops link nothing; repeated edges count once.
    """
    first = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"), F.col(a).alias("a"), F.col(b).alias("b"))
    now = staged(contracted(first.where("a is not null and b is not null and u <> v").select("u", "v")).distinct(), "edges")
    sign = None
    while True:
        seen = Observation()
        moved = contracted(_star(staged(_star(now, True), "large-stars"), False)).distinct()
        # how many edges there are, and which, is learned with the write
        now = staged(moved.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("h"), F.sum(F.col("v").cast("decimal(38,0)")).alias("v")), "stars")
        if seen.get == sign:
            break
        sign = seen.get
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
