"""Helpers that several operators of this package share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MIX = np.uint64(0x9E3779B97F4A7C15)
_WHITE = b" \t\n\x0b\x0c\r"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; one of our own only in local mode."""
    sc = spark.sparkContext
    named = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="cuespan-stage-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends here, and a lost
    executor costs no more than the tasks that read its part."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def own_name(what: str) -> str:
    """A column name that no table has."""
    return f"__{what}_{uuid.uuid4().hex}"


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts go to Python in batches of at most ``rows`` rows for the rest of the session: with Spark's 10,000, long
    texts fill an executor's memory outside the heap. A smaller setting of the user stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > rows:
        spark.conf.set(name, rows)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def doc_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``: the folds of the labelled tables. A null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


class WordHashes(dict):
    """Word bytes to a 64-bit hash, remembered; forgets everything beyond ``limit`` words."""

    def __init__(self, limit: int = 400_000) -> None:
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_remembered: dict[object, object] = {}


def remembered(key: object, make):  # noqa: ANN001, ANN201
    """A table that a worker process keeps from task to task. Only the last one asked for is kept: operators
    that follow one another in a worker don't add up their memory."""
    if key not in _remembered:
        _remembered.clear()
        _remembered[key] = make()
    return _remembered[key]


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty. ``bytes.split()`` then cuts at the six ASCII blanks only."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def scatter(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finaliser of splitmix64)."""
    h = h + _MIX
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def rolling(h: np.ndarray, width: int) -> np.ndarray:
    """One 64-bit hash for each run of ``width`` words; empty if there are fewer."""
    n = len(h) - width + 1
    if n <= 0:
        return h[:0]
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for j in range(width):
            out = scatter(out ^ h[j : j + n])
    return out


def shingles(h: np.ndarray, width: int = 5) -> np.ndarray:
    """Distinct shingle hashes, sorted; the whole sequence is one shingle if it is shorter than ``width``."""
    if not len(h):
        return h
    return np.unique(rolling(h, min(width, len(h))))


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def batch_of(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def one_thread() -> None:
    """Libraries in a task keep to the task's core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]):  # noqa: ANN201
    """Tables of whole groups with the rows' group starts, from batches in which the rows of a group
    follow one another. Only the group at the end of a batch waits for the next one."""
    kept: list[pa.RecordBatch] = []

    def starts(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for k in keys:
            v = table.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(batch)
        table = pa.Table.from_batches(kept)
        at = starts(table)
        if len(at) > 1:
            yield table.slice(0, at[-1]).combine_chunks(), at
            kept = table.slice(at[-1]).to_batches()
    if kept:
        table = pa.Table.from_batches(kept).combine_chunks()
        at = starts(table)
        yield table, np.append(at, table.num_rows)
