"""Jaccard join on word shingles: count-vector R-trees over cells of a shingle signature, exact checks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, batch_of, column_of, own_name, partitions, remembered, runs, scatter, shingles, small_batches, staged, texts_of
from .components import components

#: Signature: a pair at the threshold of 0.75 agrees in none of BANDS rows of ROWS minima with probability
#: (1 - 0.75**3)**32 = 2.4e-8; pairs above it far more rarely.
BANDS, ROWS = 32, 3

_SIGNED = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n", pa.int64()), ("cls", pa.int64()), ("keys", pa.list_(pa.int64())), ("point", pa.binary())])
_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


# --- points -------------------------------------------------------------------------------------------


def point(sets: np.ndarray) -> np.ndarray:
    """Counts of the shingles by hash group. Groups are a power of two, at least half as many as shingles,
    and doubled until no count passes 15, so that a count takes four bits."""
    groups = max(8, 1 << max(0, (len(sets) - 1).bit_length() - 1))
    while True:
        counts = np.bincount((sets >> np.uint64(64 - groups.bit_length() + 1)).astype(np.int64), minlength=groups)
        if counts.max() <= 15:
            return counts.astype(np.uint8)
        groups *= 2


def packed(counts: np.ndarray) -> bytes:
    return (counts[::2] | (counts[1::2] << 4)).tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    b = np.frombuffer(blob, np.uint8)
    return np.stack([b & 15, b >> 4], 1).ravel()


def folded(counts: np.ndarray, groups: int) -> np.ndarray:
    """The same point with fewer groups: neighbouring groups add up."""
    return counts.reshape(groups, -1).sum(1, dtype=np.uint16)


class CountTree:
    """R-tree over count vectors. A node keeps the largest count of each group among its points and the range
    of their set sizes; the summed minima of these with a query's counts bound every overlap below it."""

    FAN = 16

    def __init__(self, points: np.ndarray, sizes: np.ndarray) -> None:
        # bulk load: points of like size, then of like leading groups, stand together
        lead = points[:, : min(4, points.shape[1])]
        self.order = np.lexsort((*lead.T, sizes)) if len(sizes) > self.FAN else np.arange(len(sizes))
        top, low, high = points[self.order], sizes[self.order], sizes[self.order]
        self.levels = [(top, low, high)]
        while len(low) > self.FAN:
            cut = np.arange(0, len(low), self.FAN)
            top, low, high = np.maximum.reduceat(top, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)
            self.levels.append((top, low, high))

    def search(self, query: np.ndarray, size: int, num: int, den: int) -> np.ndarray:
        """Points whose Jaccard with the query may reach num/den, by the bound."""
        at = np.arange(len(self.levels[-1][1]))
        for k in range(len(self.levels) - 1, -1, -1):
            top, low, high = self.levels[k]
            at = at[(den * high[at] >= num * size) & (num * low[at] <= den * size)]
            bound = np.minimum(top[at], query).sum(1, dtype=np.int64)
            # overlap / (size + n - overlap) >= num / den, for the smallest n below the node
            at = at[(den + num) * bound >= num * (size + low[at])]
            if k:
                at = (at[:, None] * self.FAN + np.arange(self.FAN)).ravel()
                at = at[at < len(self.levels[k - 1][1])]
        return self.order[at]


def survivors(points: list[np.ndarray], sizes: np.ndarray, num: int, den: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each point, the points behind it in the list of trees that the bound leaves, without itself.

    Points of more groups are folded to the query's number; a pair is found from the end with fewer
    groups, or from both if they have as many.
    """
    groups = np.array([len(p) for p in points])
    for g in np.unique(groups):
        at = np.flatnonzero(groups >= g)
        own = np.flatnonzero(groups == g)
        lo, hi = sizes[own].min(), sizes[own].max()
        at = at[(den * sizes[at] >= num * lo) & (num * sizes[at] <= den * hi)]
        if len(at) < 2:
            continue
        flat = np.stack([folded(points[i], g) for i in at])
        tree = CountTree(flat, sizes[at])
        where = {int(i): k for k, i in enumerate(at)}
        for i in own:
            found = at[tree.search(flat[where[int(i)]], int(sizes[i]), num, den)]
            found = found[found != i]
            if len(found):
                yield int(i), found


class Sets:
    """Disjoint sets with path halving."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


# --- stages -------------------------------------------------------------------------------------------


def _signed(docs: DataFrame, id_col: str, text_col: str, width: int, seed: int) -> DataFrame:
    small_batches(docs.sparkSession)
    rng = np.random.default_rng(seed)
    turns = rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
    factors = rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def keys_of(sets: list[np.ndarray]) -> np.ndarray:
        flat, starts = np.concatenate(sets), np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
        out = np.empty((len(sets), BANDS), np.uint64)
        for band in range(BANDS):
            key = np.full(len(sets), band, np.uint64)
            for r in range(band * ROWS, band * ROWS + ROWS):
                key = scatter(key ^ np.minimum.reduceat((flat ^ turns[r]) * factors[r], starts))
            out[:, band] = key
        return out.view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = remembered("word hashes", WordHashes)
        for batch in batches:
            ids, rows = column_of(batch, "doc_id"), column_of(batch, "row")
            texts = texts_of(column_of(batch, "text"))
            for lo in range(0, len(texts), 256):
                sets = [shingles(hashes.array(t.lower().split()), width) for t in texts[lo : lo + 256]]
                full = [k for k, s in enumerate(sets) if len(s)]
                keys: list = [[] for _ in sets]
                if full:
                    for k, v in zip(full, keys_of([sets[k] for k in full]), strict=True):
                        keys[k] = v
                cls = [xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) for s in sets]
                yield batch_of(_SIGNED, [ids.slice(lo, 256), rows.slice(lo, 256), [len(s) for s in sets], cls, keys, [packed(point(s)) if len(s) else b"" for s in sets]])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, row long, n long, cls long, keys array<long>, point binary")


def _cells(classes: DataFrame) -> DataFrame:
    """``key``, ``cls`` of every cell of two or more classes; of cells with the same members one is kept."""
    pairs = classes.select("cls", F.explode("keys").alias("key"))
    sums = pairs.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.sum(F.xxhash64("cls").bitwiseAND((1 << 40) - 1)).alias("s"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("x"))
    one = sums.where("m > 1").groupBy("m", "s", "x").agg(F.min("key").alias("key"))
    return pairs.join(one.select("key", "m"), "key")


def _blocks(rows: DataFrame, keys: list[str], size: str, by: str, block: int) -> DataFrame:
    """Rows of groups over ``block`` are cut into blocks by hash; every pair of blocks is a group of its own."""
    n = F.ceil(F.col(size) / block).cast("int")
    cut = rows.withColumn("blk", F.pmod(F.xxhash64(by), n).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), n - 1), lambda o: F.struct(F.least("blk", o).alias("b1"), F.greatest("blk", o).alias("b2")))
    return cut.withColumn("meet", F.explode(meets)).withColumns({"b1": F.col("meet.b1"), "b2": F.col("meet.b2")}).drop("meet")


def _search_cells(cells: DataFrame, classes: DataFrame, num: int, den: int, block: int) -> DataFrame:
    """Pairs that hold together what the bound leaves in each cell: fewer than the cell has classes."""
    dealt = _blocks(cells, ["key"], "m", "cls", block).join(classes.select("cls", "n", "point"), "cls")
    keys = ["key", "b1", "b2"]
    dealt = dealt.select(*keys, "cls", "n", "point").repartition(partitions(cells.sparkSession), *keys).sortWithinPartitions(*keys, "cls")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in runs(batches, keys):
            cls, sizes = table.column("cls").to_numpy(), table.column("n").to_numpy()
            blobs = table.column("point").to_pylist()
            a: list[int] = []
            b: list[int] = []
            for lo, hi in zip(starts[:-1], starts[1:], strict=True):
                joined = Sets(hi - lo)
                for i, found in survivors([unpacked(x) for x in blobs[lo:hi]], sizes[lo:hi], num, den):
                    for j in found:
                        if joined.join(i, int(j)):
                            a.append(cls[lo + i])
                            b.append(cls[lo + j])
            if a:
                yield batch_of(_EDGES, [np.array(a), np.array(b)])

    return dealt.mapInArrow(run, "a long, b long")


def _linked(texts: list[bytes], cls: np.ndarray, labels: np.ndarray | None, hashes: WordHashes, width: int, num: int, den: int) -> list[tuple[int, int]]:
    """Verified links that connect what is connected among these documents (and their labels, if given)."""
    sets = [shingles(hashes.array(t.lower().split()), width) for t in texts]
    sizes = np.array([len(s) for s in sets])
    joined = Sets(len(sets))
    if labels is not None:
        first: dict[int, int] = {}
        for i, x in enumerate(labels):
            joined.join(first.setdefault(int(x), i), i)
    out = []
    for i, found in survivors([point(s) for s in sets], sizes, num, den):
        for j in map(int, found):
            if joined.find(i) != joined.find(j):
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if den * both >= num * (sizes[i] + sizes[j] - both):
                    joined.join(i, j)
                    out.append((int(cls[i]), int(cls[j])))
    return out


def _verify(rows: DataFrame, keys: list[str], width: int, num: int, den: int) -> DataFrame:
    """Links inside every group of ``keys``; rows have ``cls``, ``label`` and ``text``."""
    dealt = rows.select(*keys, "cls", "label", "text").repartition(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys, "cls")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = remembered("word hashes", WordHashes)
        for table, starts in runs(batches, keys):
            cls, labels = table.column("cls").to_numpy(), table.column("label").to_numpy()
            texts = table.column("text")
            out: list[tuple[int, int]] = []
            for lo, hi in zip(starts[:-1], starts[1:], strict=True):
                if hi - lo > 1:
                    mine = texts_of(texts.slice(lo, hi - lo).combine_chunks())
                    out += _linked(mine, cls[lo:hi], labels[lo:hi], hashes, width, num, den)
            if out:
                yield batch_of(_EDGES, zip(*out, strict=True))

    return dealt.mapInArrow(run, "a long, b long")


def shingle_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 75, den: int = 100, block: int = 512, hubs: int = 8, seed: int = 5) -> DataFrame:
    """``row`` (scan position), ``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` for every row.

    Links are Jaccard of num/den or more. One row of each component is kept: the first with the least id.

    1. Equal shingle sets are one class. Each class has a signature of BANDS keys and a point: its
       shingles counted by hash group.
    2. Classes that share a key form a cell; cells with the same members are searched once. A cell's
       points are put in an R-tree; what its bound of summed minima leaves holds classes together as candidates.
    3. Components of candidates bring each text once to one group, where trees find the pairs and the
       exact sets decide. Pairs that are already connected are skipped, so a group of near copies costs a few
       checks a member. Groups of over ``block`` classes are cut into blocks; ``hubs`` members are in all.
    4. In a cut group, what isn't in the largest connected part meets every block once more.
       A link outside of these would join two members of that part, so none is missed.

    ASCII letters count as lower case, words end at ASCII blanks; fewer than ``width`` words are one shingle. Null or
    empty texts have none and link with nothing. Null ids link with nothing and keep a null
    component. A repeated id is a row of its own. An empty table gives no row. ``docs`` should be a
    table in storage: texts are fetched by scan position.
    """
    signed = staged(_signed(docs, id_col, text_col, width, seed), "shingle-signatures")
    usable = signed.where("n > 0 and doc_id is not null")
    best = usable.groupBy("cls").agg(F.min(F.struct("doc_id", "row")).alias("b")).select("cls", F.col("b.doc_id").alias("rep"), F.col("b.row").alias("row"))
    classes = staged(best.join(usable.select("row", "n", "keys", "point"), "row"), "shingle-classes")
    cells = staged(_cells(classes), "shingle-cells")
    edges = staged(_search_cells(cells, classes, num, den, block), "candidate-links")
    cand = components(edges, "a", "b").select(F.col("node").alias("cls"), F.col("root").alias("cand"))
    size = cand.groupBy("cand").agg(F.count(F.lit(1)).alias("m"))
    who = staged(cand.join(size, "cand").join(classes.select("cls", "row"), "cls").withColumn("blk", F.pmod(F.xxhash64("cls"), F.ceil(F.col("m") / block)).cast("int")), "candidates")
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").alias("text"))
    # one plan at every size: the candidates grow with the corpus, so they are never broadcast
    full = staged(who.hint("merge").join(texts, "row").select("cand", "m", "blk", "cls", "text"), "candidate-texts")
    first = full.where(F.col("m") > block).groupBy("cand", "blk").agg(F.min(F.struct(F.xxhash64("cls").alias("h"), "cls", "m")).alias("top"))
    chosen = first.where(F.col("blk") < hubs).select("cand", F.col("blk").alias("home"), F.col("top.cls").alias("cls"), F.ceil(F.col("top.m") / block).cast("int").alias("n"))
    spread = chosen.join(full.select("cls", "text"), "cls").withColumn("blk", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).where("blk <> home")
    within = full.select("cand", "blk", "cls", "text").union(spread.select("cand", "blk", "cls", "text"))
    links = staged(_verify(within.withColumn("label", F.col("cls")), ["cand", "blk"], width, num, den), "links")
    large = full.where(F.col("m") > block)
    if not large.isEmpty():
        parts = components(links, "a", "b").select(F.col("node").alias("cls"), F.col("root").alias("label"))
        named = staged(large.join(parts, "cls", "left").withColumn("label", F.coalesce("label", "cls")), "labelled-texts")
        counts = named.groupBy("cand", "label").agg(F.count(F.lit(1)).alias("k"))
        main = counts.groupBy("cand").agg(F.max(F.struct("k", "label")).alias("main")).select("cand", F.col("main.label").alias("main"))
        rest = named.join(main, "cand").where("label <> main").withColumn("n", F.ceil(F.col("m") / block).cast("int"))
        every = rest.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).where("to <> blk")
        # a group of the second pass: a block, and at most as many of the rest as a block holds
        slices = rest.groupBy("cand").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("slices"))
        moved = every.join(slices, "cand").withColumn("slice", F.pmod(F.xxhash64("cls", F.lit(3)), F.col("slices")).cast("int")).select("cand", F.col("to").alias("blk"), "slice", "cls", "label", "text")
        stay = named.join(slices, "cand").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).select("cand", "blk", "slice", "cls", "label", "text")
        more = staged(_verify(moved.union(stay), ["cand", "blk", "slice"], width, num, den), "more-links")
        links = links.union(more)
    roots = components(links, "a", "b").select(F.col("node").alias("cls"), "root")
    named = classes.select("cls", "rep", "row").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    # written out: the join's sides are then plain shuffles, and Spark splits a large component's rows
    least = staged(named.groupBy("root").agg(F.min(F.struct("rep", "row")).alias("least")), "least-members")
    named = named.join(least, "root").select("cls", F.col("least.rep").alias("component_id"), F.col("least.row").alias("first"))
    linkable = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    out = signed.select("row", "doc_id", F.col("n").alias("n_shingles"), F.when(linkable, F.col("cls")).alias("cls"))
    kept = F.coalesce(F.col("row") == F.col("first"), F.lit(True))
    return out.join(named, "cls", "left").select("row", "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), kept.alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component of near duplicates; rows that link with nothing all stay."""
    row = own_name("row")
    rest = shingle_groups(docs).where("kept").select(F.col("row").alias(row)).hint("merge")
    return docs.withColumn(row, F.monotonically_increasing_id()).join(rest, row, "left_semi").select(*docs.columns)
