"""Near-duplicate vectors: random-hyperplane signs in several tables, exact cosine, components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, column_of, partitions, staged
from .components import components

_CLASS = pa.schema([("rep", pa.int64()), ("n", pa.int64()), ("v", pa.binary())])
_LINKS = pa.schema([("rep", pa.int64()), ("other", pa.int64()), ("links", pa.int64())])


def finite(vector: str):  # noqa: ANN201
    """Not null and every component finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True))


def usable(vector: str):  # noqa: ANN201
    """Finite, and not all zero."""
    return finite(vector) & F.exists(vector, lambda x: x != 0)


def plan_tables(n: int, threshold: float, loss: float, per_bucket: int = 64) -> tuple[int, int]:
    """Bits and tables. Bits grow with the number of classes, so that a bucket of unrelated vectors
    stays at about ``per_bucket``; tables so that a pair at the threshold is missed in all of them with
    probability ``loss`` at most (pairs above it far more rarely)."""
    bits = max(4, math.ceil(math.log2(max(n, 1) / per_bucket + 1)))
    p = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(loss) / math.log1p(-p)))


def planes(table: int, bits: int, width: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, table, width]).normal(size=(width, bits))


def signatures(unit: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    """One bucket number for each row and table."""
    powers = 1 << np.arange(bits, dtype=np.int64)
    return np.stack([((unit @ planes(t, bits, unit.shape[1], seed)) > 0) @ powers for t in range(tables)], 1)


def _unit(blobs: list[bytes]) -> np.ndarray:
    v = np.stack([np.frombuffer(b, "<f8") for b in blobs])
    v = v / np.abs(v).max(1, keepdims=True)  # keeps tiny and huge components exact before squaring
    return v / np.sqrt((v * v).sum(1, keepdims=True))


class _Forest:
    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        """Hang the links i, j: least label, spread until nothing changes."""
        while True:
            a, b = self.up[i], self.up[j]
            if (a == b).all():
                return
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))
            while (self.up != (nxt := self.up[self.up])).any():
                self.up = nxt


def _compare(left: dict, right: dict | None, table: int, threshold: float, square: int) -> Iterator[tuple]:
    """Links of one bucket, or of two blocks of it. A pair counts in the first table that it shares, so
    that no pair counts twice. Yields for each vector with links: the vector it hangs on, their number."""
    other = right or left
    n, m = len(left["rep"]), len(other["rep"])
    at_r = n if right else 0  # where the right side's vectors are in the forest
    counts, forest = np.zeros(at_r + m, np.int64), _Forest(at_r + m)
    for lo in range(0, n, square):
        for lo2 in range(0 if right else lo, m, square):
            a, b = slice(lo, lo + square), slice(lo2, lo2 + square)
            near = left["unit"][a] @ other["unit"][b].T >= threshold
            if not right and lo == lo2:
                near = np.triu(near, 1)
            i, j = np.nonzero(near)
            if table and len(i):
                new = ~(left["sig"][a][i, :table] == other["sig"][b][j, :table]).any(1)
                i, j = i[new], j[new]
            if not len(i):
                continue
            i, j = i + lo, j + lo2
            counts[:n] += np.bincount(i, other["n"][j], n).astype(np.int64)
            counts[at_r:] += np.bincount(j, left["n"][i], m).astype(np.int64)
            forest.join(i, j + at_r)
    reps = np.concatenate([left["rep"], other["rep"]]) if right else left["rep"]
    at = np.flatnonzero(counts)
    yield reps[at], reps[forest.up[at]], counts[at]


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", loss: float = 1e-4, block: int = 4096, seed: int = 11) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` for every row.

    Rows with equal vectors are one class and meet as one representative, counted with its copies. Every
    table keys a representative by its signs against random hyperplanes; inside a bucket all
    vectors meet in matrix products in double precision, and links at ``threshold`` or more
    leave the task as one row per vector (its number of links, the vector it hangs on), never as pairs.
    Buckets of over ``block`` vectors are split, and blocks meet in pairs of blocks over many tasks.

    The vectors of a bucket's connected part hang on one of them, which keeps every component. Vectors that are null, zero, or hold null or
    non-finite components link with nothing; so do vectors of another length. Null ids keep their
    row, alone. Repeated ids are rows of their own that share the component. An empty table gives no row.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    good = usable("v") & F.col("vec_id").isNotNull()
    # -0.0 and 0.0 are equal numbers: adding zero makes them one
    plain = F.transform("v", lambda x: x + F.lit(0.0))
    key = F.struct(F.xxhash64(plain), F.hash(plain, F.size("v")), F.size("v"))
    keyed = staged(rows.select("vec_id", F.when(good, key).alias("key"), F.when(good, plain).alias("v")), "vectors")
    classes = keyed.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v"))
    classes = staged(classes, "vector-classes")
    total = classes.count()
    bits, tables = plan_tables(total, threshold, loss)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("rep", pa.int64()), ("n", pa.int64()), ("width", pa.int32()), ("v", pa.binary()), ("sigs", pa.list_(pa.int64()))])
        for batch in batches:
            reps, ns = column_of(batch, "rep").to_pylist(), column_of(batch, "n").to_pylist()
            vs = [np.array(v, "<f8").tobytes() for v in column_of(batch, "v").to_pylist()]
            for width in {len(v) for v in vs}:
                at = [i for i, v in enumerate(vs) if len(v) == width]
                mine = [vs[i] for i in at]
                sig = signatures(_unit(mine), bits, tables, seed)
                yield batch_of(schema, [[reps[i] for i in at], [ns[i] for i in at], [width // 8] * len(at), mine, list(sig)])

    signed = staged(classes.select("rep", "n", "v").mapInArrow(sign, "rep long, n long, width int, v binary, sigs array<long>"), "signs")
    keys = signed.select("rep", "width", F.posexplode("sigs").alias("t", "sig"))
    size = keys.groupBy("t", "width", "sig").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    # a bucket's blocks; block b meets itself and every later block
    blocks = F.ceil(F.col("m") / block).cast("int")
    member = keys.join(size, ["t", "width", "sig"]).withColumn("blocks", blocks)
    member = member.withColumn("b", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("b", o).alias("b1"), F.greatest("b", o).alias("b2")))
    dealt = member.select("rep", "t", "width", "sig", "b", F.explode(meets).alias("m")).select("rep", "t", "width", "sig", "b", "m.b1", "m.b2")
    full = dealt.join(signed.select("rep", "n", "v", "sigs"), "rep")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(list(batches))
        if not group.num_rows:
            return
        table, b1, b2 = (group.column(c)[0].as_py() for c in ("t", "b1", "b2"))
        b = group.column("b").to_numpy()
        sides = {}
        for k in {b1, b2}:
            mine = group.filter(pa.array(b == k))
            if mine.num_rows:
                order = np.argsort(mine.column("rep").to_numpy())
                sides[k] = {
                    "rep": mine.column("rep").to_numpy()[order], "n": mine.column("n").to_numpy()[order],
                    "unit": _unit(mine.column("v").to_pylist())[order],
                    "sig": np.array(mine.column("sigs").to_pylist())[order],
                }
        if b1 not in sides or b2 not in sides:
            return
        for rep, hang, links in _compare(sides[b1], sides[b2] if b2 != b1 else None, table, threshold, 2048):
            if len(rep):
                yield batch_of(_LINKS, [rep, hang, links])

    found = full.groupBy("t", "width", "sig", "b1", "b2").applyInArrow(meet, "rep long, other long, links long")
    found = staged(found, "vector-links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(found, "rep", "other")
    out = classes.select("key", "rep", "n").join(links, "rep", "left").join(roots, F.col("rep") == F.col("node"), "left")
    out = out.select("key", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    done = keyed.select("vec_id", "key").join(out, "key", "left")
    return done.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
