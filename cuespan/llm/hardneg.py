"""Hard negatives: candidates in Hilbert order in Parquet blocks with zone maps; bounds choose what is read."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batch_of, column_of, partitions, staged
from .neardup import finite

#: Rows of a block; anchors of a tile (a task holds one tile and one block at a time) and of one matrix product.
BLOCK, TILE, CHUNK = 1024, 65_536, 512
#: Scores must stay below this size, so that the windows' products fit a long.
MOST = 1 << 55

_ROWS = "width int, h binary, vid long, label long, anchor boolean, q binary"
_BLOCKS = "key long, width int, n int, ids binary, labels binary, q binary, low binary, high binary, label_low long, label_high long"
_ANCHORS = "tile int, key long, width int, vid long, label long, q binary"


@contextmanager
def batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """While open, rows go to Python at most ``rows`` at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, was)


# --- order --------------------------------------------------------------------------------------------


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of each row of ``cells`` (``bits`` bits a dimension), as big-endian bytes.

    Skilling's transform, all rows at once: undo the excess work from the top bit down, then Gray-encode.
    """
    x = cells.astype(np.int64).T.copy()
    if not len(x):
        return np.zeros((len(cells), 0), np.uint8)
    for b in range(bits - 1, 0, -1):
        top, below = 1 << b, (1 << b) - 1
        for i in range(len(x)):
            on = (x[i] & top) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & below)
            x[0] ^= np.where(on, below, swap)
            x[i] ^= swap
    x = np.bitwise_xor.accumulate(x, axis=0)
    flip = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] & (1 << b), (1 << b) - 1, 0)
    x ^= flip
    planes = [(x >> b) & 1 for b in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes).T.astype(np.uint8), axis=1)


def curve(q: np.ndarray) -> np.ndarray:
    """Hilbert positions of directions: four cells a dimension, cut at 0 and at two thirds of the usual size."""
    v = q.astype(float)
    size = np.sqrt((v * v).sum(1, keepdims=True))
    z = v / np.where(size > 0, size, 1) * np.sqrt(v.shape[1])
    return hilbert((z >= -0.67).astype(int) + (z >= 0) + (z >= 0.67), 2)


def packed(q: np.ndarray) -> bytes:
    for kind in ("<i2", "<i4", "<i8"):
        if not q.size or np.abs(q).max() < 1 << (8 * int(kind[2]) - 1):
            return q.astype(kind).tobytes()
    raise AssertionError


def unpacked(blob: bytes, n: int, width: int) -> np.ndarray:
    return np.frombuffer(blob, f"<i{len(blob) // (n * width)}" if n * width else "<i8").reshape(n, width).astype(np.int64)


# --- tables -------------------------------------------------------------------------------------------


def _quantised(rows: DataFrame, scale: float) -> DataFrame:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("width", pa.int32()), ("h", pa.binary()), ("vid", pa.int64()), ("label", pa.int64()), ("anchor", pa.bool_()), ("q", pa.binary())])
        for batch in parts:
            v = column_of(batch, "v")
            sizes = v.value_lengths().to_numpy()
            for width in np.unique(sizes):
                at = pa.array(np.flatnonzero(sizes == width))
                x = np.floor(scale * v.take(at).flatten().to_numpy().reshape(len(at), width))
                if width and np.abs(x).max() >= np.sqrt(MOST / width):
                    raise ValueError("components so large that scores don't fit a long")
                q = x.astype(np.int64)
                own = [column_of(batch, c).take(at) for c in ("vid", "label", "anchor")]
                yield batch_of(schema, [np.full(len(at), width, np.int32), [h.tobytes() for h in curve(q)], *own, [packed(r) for r in q]])

    return staged(rows.mapInArrow(run, _ROWS), "quantised")


def _dealt(rows: DataFrame, parts: int) -> DataFrame:
    """Rows by length, label and place on the curve. The id is part of the order, so equal vectors spread over parts."""
    order = ["width", "label", "h", "vid"]
    return rows.repartitionByRange(parts, *order).sortWithinPartitions(*order, "q")


def _once(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, bytes]]:
    """Rows (width, id, label, vector) without those that equal the row before."""
    last = None
    for batch in parts:
        for row in zip(*(column_of(batch, c).to_pylist() for c in ("width", "vid", "label", "q")), strict=True):
            if row != last:
                yield row
            last = row


def _blocks(rows: DataFrame, most: int) -> DataFrame:
    """One row for each block: ids, labels and vectors of up to BLOCK candidates, and its zone map.

    Of the block's rows with one vector and label, which score alike everywhere, only the ``most`` least ids
    can be among the first ``most`` of anything; the others can't change a result and are left out.
    """
    from pyspark import TaskContext

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.int64()), ("width", pa.int32()), ("n", pa.int32()), *[(c, pa.binary()) for c in ("ids", "labels", "q", "low", "high")], ("label_low", pa.int64()), ("label_high", pa.int64())])
        key, held = TaskContext.get().partitionId() << 32, []

        def close() -> pa.RecordBatch:
            seen: dict[tuple, int] = {}
            kept = []
            for _, vid, label, q in held:  # ids rise among rows with one vector and label
                seen[label, q] = seen.get((label, q), 0) + 1
                if seen[label, q] <= most:
                    kept.append((vid, label, q))
            width, n = held[0][0], len(kept)
            ids, labels = (np.array([r[k] for r in kept], "<i8") for k in (0, 1))
            q = np.concatenate([unpacked(r[2], 1, width) for r in kept])
            low, high = q.min(0).astype("<i8"), q.max(0).astype("<i8")
            return batch_of(schema, [[x] for x in (key, width, n, ids.tobytes(), labels.tobytes(), packed(q), low.tobytes(), high.tobytes(), int(labels.min()), int(labels.max()))])

        for row in _once(parts):
            if held and (len(held) == BLOCK or row[0] != held[0][0]):
                yield close()
                key, held = key + 1, []
            held.append(row)
        if held:
            yield close()

    return staged(_dealt(rows, partitions(rows.sparkSession)).mapInArrow(run, _BLOCKS), "blocks")


def _anchors(rows: DataFrame) -> tuple[DataFrame, int]:
    """Anchors in tiles of about TILE that follow the curve, and the number of tiles."""
    from pyspark import TaskContext

    own = rows.where("anchor")
    tiles = max(1, -(-own.count() // TILE))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("tile", pa.int32()), ("key", pa.int64()), ("width", pa.int32()), ("vid", pa.int64()), ("label", pa.int64()), ("q", pa.binary())])
        tile, at, held = TaskContext.get().partitionId(), 0, []
        for row in _once(parts):
            held.append(row)
            if len(held) == 4096:
                yield batch_of(schema, [[tile] * len(held), range(at, at + len(held)), *zip(*[(w, v, lab, q) for w, v, lab, q in held], strict=True)])
                at, held = at + len(held), []
        if held:
            yield batch_of(schema, [[tile] * len(held), range(at, at + len(held)), *zip(*held, strict=True)])

    return staged(_dealt(own, tiles).mapInArrow(run, _ANCHORS), "anchors"), tiles


# --- meeting ------------------------------------------------------------------------------------------


class Best:
    """The first ``k`` of each slot by score descending, id ascending. New ones wait until a fair number has come."""

    def __init__(self, slots: int, k: int) -> None:
        self.slots, self.k = slots, k
        self.least = np.full(slots, -MOST, np.int64)  # a slot's k-th score so far
        self.slot, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size, self.full = 0, False

    def offer(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if len(slot):
            self.waiting.append((slot, score, ids))
            self.size += len(slot)
            if self.size > 50_000 or not self.full:
                self.settle()

    def settle(self) -> None:
        slot, score, ids = (np.concatenate(x) for x in zip((self.slot, self.score, self.id), *self.waiting, strict=True))
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        first = np.flatnonzero(np.diff(slot, prepend=-1))
        place = np.arange(len(slot)) - np.repeat(first, np.diff(np.append(first, len(slot))))
        keep = place < self.k
        self.slot, self.score, self.id, place = slot[keep], score[keep], ids[keep], place[keep]
        last = place == self.k - 1
        self.least[self.slot[last]] = self.score[last]
        self.full = bool(last.sum() == self.slots)
        self.waiting, self.size = [], 0


class Chunk:
    """Up to CHUNK anchors of one length, their windows of scores (several each, on demand) and what they found."""

    def __init__(self, rows: list[dict], k: int) -> None:
        self.key, self.vid, self.label = (np.array([r[c] for r in rows], np.int64) for c in ("key", "vid", "label"))
        self.q = np.concatenate([unpacked(r["q"], 1, r["width"]) for r in rows])
        self.most = int(np.abs(self.q).max()) if self.q.size else 0
        self.plus, self.minus = np.maximum(self.q, 0).astype(float), np.minimum(self.q, 0).astype(float)
        self.same = rows[0]["window_low"] is None
        if self.same:
            self.low, self.high = np.full((len(rows), 1), -MOST), np.full((len(rows), 1), MOST)
        else:
            # an anchor with fewer windows gets empty ones
            most = max(len(r["window_low"]) for r in rows)
            self.low = np.array([r["window_low"] + [1] * (most - len(r["window_low"])) for r in rows], np.int64).reshape(len(rows), most)
            self.high = np.array([r["window_high"] + [0] * (most - len(r["window_high"])) for r in rows], np.int64).reshape(len(rows), most)
        self.windows = self.low.shape[1]
        self.open = (self.low <= self.high).any(1) if self.windows else np.zeros(len(rows), bool)
        self.best = Best(self.low.size, k)

    def wanted(self) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest score that an anchor still looks for."""
        least = np.maximum(self.low, self.best.least.reshape(self.low.shape))
        shut = self.low > self.high
        return np.where(shut, MOST, least).min(1, initial=MOST), np.where(shut, -MOST, self.high).max(1, initial=-MOST)

    def must_read(self, low: np.ndarray, high: np.ndarray, label_low: np.ndarray, label_high: np.ndarray) -> np.ndarray:
        """anchors x blocks: which blocks may hold a row that the anchor looks for. Interval arithmetic over a
        block's least and largest component in each dimension bounds every score in it from both sides."""
        label = self.label[:, None]
        if self.same:
            may = (label >= label_low) & (label <= label_high)
        else:
            may = ~((label == label_low) & (label == label_high))
        may &= self.open[:, None]
        size = max(int(np.abs(low).max(initial=0)), int(np.abs(high).max(initial=0)))
        if self.q.shape[1] * self.most * size < 1 << 52:  # beyond that the bounds aren't exact: read
            least, largest = self.wanted()
            top = self.plus @ high.T + self.minus @ low.T
            bottom = self.plus @ low.T + self.minus @ high.T
            may &= (top >= least[:, None]) & (bottom <= largest[:, None])
        return may

    def meet(self, block: dict, may: np.ndarray) -> None:
        q = block["q"]
        bound = q.shape[1] * self.most * int(np.abs(q).max(initial=0))
        kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64  # exact in each
        at = np.flatnonzero(may)
        s = self.q[at].astype(kind) @ q.T.astype(kind)
        least, largest = (x[at][:, None] for x in self.wanted())
        i, j = np.nonzero((s >= least) & (s <= largest))
        score, i = s[i, j].astype(np.int64), at[i]
        fits = (self.label[i] == block["labels"][j]) == self.same
        fits &= self.vid[i] != block["ids"][j]
        i, j, score = i[fits], j[fits], score[fits]
        for w in range(self.windows):
            slot = i * self.windows + w
            ok = (score >= self.low[i, w]) & (score <= self.high[i, w]) & (score >= self.best.least[slot])
            self.best.offer(slot[ok], score[ok], block["ids"][j[ok]])

    def found(self) -> tuple[np.ndarray, ...]:
        """anchor key, window, score, id."""
        self.best.settle()
        n = max(1, self.windows)
        return self.key[self.best.slot // n], self.best.slot % n, self.best.score, self.best.id


def _meet(anchors: DataFrame, rights: DataFrame, run: Callable, out: str, name: str) -> DataFrame:
    """Every anchor of a tile meets every row of ``rights`` that is meant for the tile (``tile``, ``slot``). Anchors
    go to each slot, rows of ``rights`` to one; in a task a tile's anchors come first and the rest streams by."""
    spark = anchors.sparkSession
    slots = partitions(spark)
    own = anchors.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))).withColumn("kind", F.lit(0))
    both = own.unionByName(rights.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    both = both.repartitionById(slots, F.pmod(F.col("tile") + F.col("slot"), F.lit(slots)).cast("int"))
    with batches(spark, 64):
        return staged(both.sortWithinPartitions("tile", "slot", "kind", "key").mapInArrow(run, out), name)


def _groups(parts: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[int, list[Chunk], dict]]:
    """(tile, its chunks, one row of the other side) for each such row; chunks are built once a group."""
    now, mine, chunks = None, [], None
    for batch in parts:
        for row in batch.to_pylist():
            if (row["tile"], row["slot"]) != now:
                now, mine, chunks = (row["tile"], row["slot"]), [], None
            if not row["kind"]:
                mine.append(row)
                continue
            if chunks is None:
                chunks = []
                for width in sorted({r["width"] for r in mine}):
                    same = [r for r in mine if r["width"] == width]
                    chunks += [(width, Chunk(same[lo : lo + CHUNK], k)) for lo in range(0, len(same), CHUNK)]
                mine = []
            yield row["tile"], [c for w, c in chunks if w == row["width"]], row


def _unpack(row: dict) -> dict:
    ids, labels = (np.frombuffer(row[c], "<i8") for c in ("ids", "labels"))
    return {"ids": ids, "labels": labels, "q": unpacked(row["q"], row["n"], row["width"])}


def _zone(row: dict) -> tuple[np.ndarray, ...]:
    low, high = (np.frombuffer(row[c], "<i8")[None].astype(float) for c in ("low", "high"))
    return low, high, np.array([row["label_low"]]), np.array([row["label_high"]])


def _choose(anchors: DataFrame, tiles: int, zones: DataFrame) -> DataFrame:
    """(tile, key of a block) where the zone map leaves the block to one of the tile's anchors at least."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("tile", pa.int32()), ("key", pa.int64())])
        for tile, chunks, row in _groups(parts, 1):
            if any(c.must_read(*_zone(row)).any() for c in chunks):
                yield batch_of(schema, [[tile], [row["key"]]])

    rights = zones.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    return _meet(anchors, rights, run, "tile int, key long", "chosen")


def _search(anchors: DataFrame, tiles: int, blocks: DataFrame, k: int, name: str) -> DataFrame:
    """``tile``, ``key``, ``window``, ``score``, ``id``: the first ``k`` of each anchor's windows in each slot."""
    zones = blocks.select("key", "width", "low", "high", "label_low", "label_high", "slot")
    needed = blocks.join(_choose(anchors, tiles, zones), "key")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("tile", pa.int32()), ("key", pa.int64()), ("window", pa.int32()), ("score", pa.int64()), ("id", pa.int64())])
        last: dict[int, tuple[int, Chunk]] = {}

        def done() -> Iterator[pa.RecordBatch]:
            for tile, c in last.values():
                key, window, score, ids = c.found()
                yield batch_of(schema, [np.full(len(key), tile, np.int32), key, window.astype(np.int32), score, ids])
            last.clear()

        group = None
        for tile, chunks, row in _groups(parts, k):
            if (tile, row["slot"]) != group:
                yield from done()
                group = (tile, row["slot"])
            block, zone = _unpack(row), _zone(row)
            for c in chunks:
                last[id(c)] = (tile, c)
                may = c.must_read(*zone)[:, 0]
                if may.any():
                    c.meet(block, may)
        yield from done()

    return _meet(anchors, needed, run, "tile int, key long, window int, score long, id long", name)


def hard_negatives(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, scale: float = 256.0, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    A component x counts as floor(scale * x), a score is the inner product of such numbers. Rows come by score
    descending, then id. An anchor (``anchor`` holds) has its first ``positives`` rows of its own label; for each,
    the first ``negatives`` rows of other labels whose score lies between ``least`` and ``most`` hundredths of the positive's.

    Candidates lie in Parquet blocks in the order of label and Hilbert curve. A block's zone map bounds each anchor's scores in it;
    a block goes to the tiles of anchors that may find something there, and inside a task the bound is asked again with what
    the anchor has found so far. Every result is exact.

    Rows with a null id, label or vector, or a null or non-finite component take no part; rows that agree in id, label
    and quantised vector count once. A row of the anchor's own id is never its positive or negative. Vectors meet
    vectors of their length only. Fewer positives or negatives than asked for give fewer rows, a positive with a negative score none, an empty table none.
    Components so large that a score could pass 2**55 raise an error. Extra columns aren't read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vid"), F.col(label_col).cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(finite("v") & F.col("vid").isNotNull() & F.col("label").isNotNull())
    with batches(spark, 4096):
        quantised = _quantised(rows, scale)
        blocks = _blocks(quantised, max(positives + 1, negatives))
        anchors, tiles = _anchors(quantised)
    # neighbours on the curve go to different slots
    slots = partitions(spark)
    blocks = blocks.withColumn("slot", F.pmod(F.shiftright("key", 32) + F.col("key"), F.lit(slots)).cast("int"))
    nothing = F.lit(None).cast("array<long>")
    first = lambda rows, n, *by: rows.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id"))).where(F.col("r") <= n)

    found = _search(anchors.withColumns({"window_low": nothing, "window_high": nothing}), tiles, blocks, positives, "positives")
    pos = staged(first(found, positives, "tile", "key").select("tile", "key", (F.col("r") - 1).alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "first-positives")
    # integer ends of each window; a negative score leaves none
    low = F.when(F.col("positive_score") < 0, 1).otherwise(F.expr(f"({least} * positive_score + 99) div 100"))
    high = F.when(F.col("positive_score") < 0, 0).otherwise(F.expr(f"({most} * positive_score) div 100"))
    ends = pos.groupBy("tile", "key").agg(F.sort_array(F.collect_list(F.struct("window", low.alias("low"), high.alias("high")))).alias("w"))
    ends = ends.select("tile", "key", F.col("w.low").cast("array<long>").alias("window_low"), F.col("w.high").cast("array<long>").alias("window_high"))
    # written out: both the choice of blocks and the search read them
    windows = staged(anchors.join(ends, ["tile", "key"]), "windows")

    found = _search(windows, tiles, blocks, negatives, "negatives")
    neg = first(found, negatives, "tile", "key", "window").select("tile", "key", "window", F.col("r").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = windows.select("tile", "key", F.col("vid").alias("anchor_id"))
    return neg.join(pos, ["tile", "key", "window"]).join(named, ["tile", "key"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
