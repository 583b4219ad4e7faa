"""Average-linkage clusters of vectors, by rounds of safe merges.

With unit vectors the average distance between two clusters is one minus the product of their mean vectors, so a cluster is its
mean and its size. Average linkage is reducible: a merged cluster is no nearer to a third than the nearer of its two parts was.
So two clusters that are each other's nearest can be merged at any time, and a cluster's nearest neighbour, once
known, stays right until that neighbour is merged.

Vectors of a group lie in blocks of like directions. A block is summed up by a centre and a radius, which bound the distance of
any cluster to all in it. In each round a task

1. merges in its block all that are mutually nearest, as long as the bounds of the other blocks prove it,
2. says which other blocks the rest has to ask; only those are compared, and
3. mutually nearest clusters of different blocks are merged.

Known neighbours are carried from round to round; only merged clusters and those that lost their neighbour look again. A group
that fits one block has no other blocks and is done in the first round.

Blocks are as large as a task can hold: each block more is asked once more by every cluster, and merges between blocks cost
rounds. In a block a cluster that looks around keeps its nearest few, and how near any other can be. The same reducibility holds
for that horizon, so a cluster that lost its neighbour takes the next of its few, and looks at the whole block again only when
these lie behind its horizon. Single precision tells which pairs can be near enough; these alone are computed in double precision.

Equal vectors are merged before the first round: at a distance of 0 they come first anyway, but as each other's nearest only in
pairs, so that a round would merge one of many.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuespan.session import cut_lineage, stored

CLUSTER, MOVED, CENTRE, COUNT, LOOKED = 0, 1, 2, 3, 4
#: Bounds and distances are compared with this much room for rounding.
_ROOM = 1e-9
_BITS = 16
#: Clusters of a block; a task holds them, their nearest few, and products of so many rows and columns.
BLOCK, _KEPT, _ROWS, _COLUMNS = 1 << 17, 16, 512, 2048
#: Clusters that go past the ones of a block in one task.
_ASKED = 1 << 14
#: Numbers of the vectors that are gathered pair by pair at a time.
_CELLS = 1 << 22
_STATE = "grp {g}, blk long, cid long, size long, other long, dist double, settled boolean, mean array<double>, asks array<long>"


def _fields(grp: pa.DataType) -> list:
    return [("grp", grp), ("blk", pa.int64()), ("cid", pa.int64()), ("size", pa.int64()), ("other", pa.int64()), ("dist", pa.float64()), ("settled", pa.bool_()), ("mean", pa.list_(pa.float64())), ("asks", pa.list_(pa.int64()))]


def _array(values, kind: pa.DataType, n: int) -> pa.Array:  # noqa: ANN001
    if values is None:
        return pa.nulls(n, kind)
    return values if isinstance(values, pa.Array) else pa.array(values, kind)


def _rows(schema: pa.Schema, n: int, **columns) -> pa.RecordBatch:  # noqa: ANN003
    return pa.RecordBatch.from_arrays([_array(columns.get(f.name), f.type, n) for f in schema], schema=schema)


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    whole = column.combine_chunks()
    return whole.flatten().to_numpy().reshape(len(whole), -1)


def _lists(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1]), pa.int32()), pa.array(m.ravel()))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.round(1.0 - a @ b.T, 12)


def _pair_distances(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distances of the pairs of rows ``x[i]``, ``y[j]``."""
    out, step = np.empty(len(i)), max(1, _CELLS // max(1, x.shape[1]))
    for lo in range(0, len(i), step):
        out[lo : lo + step] = np.einsum("nd,nd->n", x[i[lo : lo + step]], y[j[lo : lo + step]])
    return np.round(1.0 - out, 12)


def nearest(x: np.ndarray, own: np.ndarray, y: np.ndarray, y32: np.ndarray, alive: np.ndarray, threshold: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of the ``k`` nearest rows of ``y`` below ``threshold``, for each row of ``x``; -1 and inf where there are fewer.

    The smaller place wins a tie. Rows that are not ``alive`` don't count, nor row ``own`` of ``y``.
    """
    n, width = x.shape
    places, dist = np.full((n, k), -1), np.full((n, k), np.inf)
    # more than single precision can be wrong by, in vectors no longer than 1
    slack = (width + 16) * 2.0**-22
    room = np.empty(min(n, _ROWS) * min(len(y), _COLUMNS), np.float32)
    for top in range(0, n, _ROWS):
        a = x[top : top + _ROWS]
        a32, mine, m = a.astype(np.float32), own[top : top + _ROWS], len(a)
        bar = np.full(m, threshold)  # only what is nearer than this is taken
        kept, waiting = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), []
        for lo in range(0, len(y), _COLUMNS):
            part = y32[lo : lo + _COLUMNS]
            w = len(part)
            at = np.flatnonzero(np.matmul(a32, part.T, out=room[: m * w].reshape(m, w)) > (1.0 - slack - bar).astype(np.float32)[:, None])
            if not len(at):
                continue
            if 32 * len(at) > m * w:
                # too many are alike for single precision
                whole = distances(a, y[lo : lo + w])
                whole[:, ~alive[lo : lo + w]] = np.inf
                at = np.flatnonzero(whole < bar[:, None])
                if len(at) > 4 * k * m and w > k + 1:
                    at = at[whole.ravel()[at] <= np.partition(whole, k, axis=1)[at // w, k]]  # one more, as oneself may be among them
                r, c = np.divmod(at, w)
                d = whole.ravel()[at]
            else:
                r, c = np.divmod(at, w)
                d = _pair_distances(a, r, y[lo : lo + w], c)
            c += lo
            ok = (d < bar[r]) & (c != mine[r]) & alive[c]
            waiting.append((r[ok], c[ok], d[ok]))
            if sum(len(v[0]) for v in waiting) > 2 * k * m:
                kept, waiting = _first(kept, waiting, k), []
                r, _, d = kept
                full = np.flatnonzero(np.bincount(r, minlength=m) == k)
                bar[full] = d[np.searchsorted(r, full, "right") - 1]
        r, c, d = _first(kept, waiting, k)
        nth = np.arange(len(r)) - np.searchsorted(r, r)
        places[top + r, nth], dist[top + r, nth] = c, d
    return places, dist


def _first(kept: tuple, waiting: list, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first ``k`` pairs of each row by distance, then place."""
    r, c, d = (np.concatenate(v) for v in zip(kept, *waiting, strict=True))
    order = np.lexsort((c, d, r))
    r, c, d = r[order], c[order], d[order]
    few = np.arange(len(r)) - np.searchsorted(r, r) < k
    return r[few], c[few], d[few]


class Block:
    """Clusters of one block, by id. ``near``: place of the nearest one here; ``exact``: no other block holds a nearer one.

    ``few``: places of the nearest clusters here, as they were when the cluster last looked. All others here come after ``edge`` and ``edge_at``,
    a distance and a place; an edge at the threshold is that of a list in which none is missing.
    """

    def __init__(self, table: pa.Table, centres: np.ndarray, radii: np.ndarray, threshold: float, looked: pa.Table | None = None) -> None:
        order = np.argsort(table.column("cid").to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        self.ids, self.sizes = table.column("cid").to_numpy().copy(), table.column("size").to_numpy().astype(float)
        self.means = _vectors(table.column("mean")).copy()
        self.exact = table.column("settled").to_numpy().astype(bool)
        self.other = table.column("other").fill_null(-1).to_numpy().copy()
        self.known = self.exact & table.column("other").is_valid().to_numpy()
        self.dist = table.column("dist").fill_null(np.inf).to_numpy().copy()
        at = np.minimum(np.searchsorted(self.ids, self.other), len(self.ids) - 1)
        self.near = np.where(self.known & (self.ids[at] == self.other), at, -1)
        n = len(self.ids)
        self.alive = np.ones(n, bool)
        self.to = np.arange(n)
        self.few = np.full((n, _KEPT), -1, np.int32)
        # a neighbour that is known from an earlier round comes without a list
        self.edge, self.edge_at = np.full(n, -np.inf), np.full(n, -1)
        self.centres, self.radii, self.threshold = centres, radii, threshold
        self.pairs = 0
        self.shown = np.arange(n)
        self.seen, self.seen32 = self.means, self.means.astype(np.float32)
        open_ = ~self.exact
        if looked is not None and looked.num_rows:
            at, few = np.searchsorted(self.ids, looked.column("cid").to_numpy()), looked.column("asks").combine_chunks()
            ends = few.value_lengths().to_numpy()
            self.few[at.repeat(ends), np.arange(ends.sum()) - (ends.cumsum() - ends).repeat(ends)] = np.searchsorted(self.ids, few.flatten().to_numpy())
            self.edge[at], self.edge_at[at] = looked.column("dist").to_numpy(), self.few[at, -1]
            self.pairs += n * len(at)
            open_[at] = False
            self.recall(at, self.few[at])
        self.look(np.flatnonzero(open_))

    def bounds(self, at: np.ndarray) -> np.ndarray:
        """Least distance that a cluster can have to any one of each other block."""
        x = self.means[at]
        return 1.0 - (x @ self.centres.T + np.sqrt((x * x).sum(1))[:, None] * self.radii)

    def show(self, at: np.ndarray) -> None:
        """Takes the clusters ``at`` over into what looks go through."""
        k = np.searchsorted(self.shown, at)
        self.seen[k] = self.means[at]
        self.seen32[k] = self.seen[k]

    def settle(self, at: np.ndarray, dist: np.ndarray, places: np.ndarray) -> None:
        """Notes the nearest few of the clusters ``at``, nearest first, which are right up to their edge."""
        self.few[at] = places
        self.near[at], self.dist[at] = places[:, 0], dist[:, 0]
        for lo in range(0, len(at), 1024):
            mine = at[lo : lo + 1024]
            least = self.bounds(mine).min(1, initial=np.inf)
            self.exact[mine] = (self.dist[mine] + _ROOM < least) | (least - _ROOM >= self.threshold)

    def look(self, at: np.ndarray) -> None:
        """Nearest here of the clusters ``at``; the smaller id on a tie."""
        if not len(at):
            return
        alive = int(self.alive.sum())
        if alive < 0.9 * len(self.shown):
            self.shown = np.flatnonzero(self.alive)
            self.seen = self.means[self.shown]
            self.seen32 = self.seen.astype(np.float32)
        self.pairs += len(at) * alive
        k = self.few.shape[1]
        places, dist = nearest(self.means[at], np.searchsorted(self.shown, at), self.seen, self.seen32, self.alive[self.shown], self.threshold, k)
        places = np.where(places >= 0, self.shown[places], -1)
        full = places[:, -1] >= 0
        self.edge[at] = np.where(full, dist[:, -1], self.threshold)
        self.edge_at[at] = np.where(full, places[:, -1], -1)
        self.settle(at, dist, places)

    def recall(self, at: np.ndarray, places: np.ndarray) -> None:
        """Nearest here of the clusters ``at`` out of ``places``, as they are now; those that have none before their edge look anew."""
        k, width, again = self.few.shape[1], self.means.shape[1], []
        step = max(1, _CELLS // max(1, places.shape[1] * width))
        for lo in range(0, len(at), step):
            mine, c = at[lo : lo + step], places[lo : lo + step]
            c = np.sort(np.where(c >= 0, self.to[c], -1), axis=1)
            ok = (c >= 0) & (c != mine[:, None])
            ok[:, 1:] &= c[:, 1:] != c[:, :-1]
            i, _ = np.nonzero(ok)
            d = np.full(c.shape, np.inf)
            d[ok] = _pair_distances(self.means, mine[i], self.means, c[ok])
            self.pairs += len(i)
            edge, edge_at = self.edge[mine][:, None], self.edge_at[mine][:, None]
            d[(d >= self.threshold) | (d > edge) | ((d == edge) & (c > edge_at))] = np.inf
            order = np.argsort(d, axis=1, kind="stable")[:, : k + 1]
            d, c = np.take_along_axis(d, order, 1), np.take_along_axis(c, order, 1)
            c[np.isinf(d)] = -1
            if c.shape[1] > k:
                over = c[:, k] >= 0
                self.edge[mine[over]], self.edge_at[mine[over]] = d[over, k - 1], c[over, k - 1]
            sure = (c[:, 0] >= 0) | (edge[:, 0] >= self.threshold)
            again.append(mine[~sure])
            self.settle(mine[sure], d[sure, :k], c[sure, :k])
        if again:
            self.look(np.concatenate(again))

    def merge(self) -> None:
        """Merge what is mutually nearest for certain, until nothing is."""
        while True:
            i = np.flatnonzero(self.alive & self.exact & (self.near >= 0) & (self.dist < self.threshold))
            j = self.near[i]
            two = self.exact[j] & self.alive[j] & (self.near[j] == i) & (i < j)
            i, j = i[two], j[two]
            if not len(i):
                return
            a, b = self.sizes[i], self.sizes[j]
            self.means[i] = (self.means[i] * a[:, None] + self.means[j] * b[:, None]) / (a + b)[:, None]
            self.sizes[i] += self.sizes[j]
            self.alive[j] = False
            self.to[j] = i
            # who is in neither list is at least as far as the two edges on average
            whole = (self.edge[i] >= self.threshold) & (self.edge[j] >= self.threshold)
            self.edge[i] = np.where(whole, self.threshold, (self.edge[i] * a + self.edge[j] * b) / (a + b) - _ROOM)
            self.edge_at[i] = -1
            lost = np.zeros(len(self.ids), bool)
            lost[i] = lost[j] = True
            # those whose neighbour is merged look again, with the merged ones
            again = np.flatnonzero(self.alive & ~lost & (self.near >= 0) & lost[self.near])
            self.near[i] = self.near[again] = -1
            self.roots()
            self.show(np.concatenate([i, j]))
            self.recall(i, np.concatenate([self.few[i], self.few[j]], axis=1))
            self.recall(again, self.few[again])

    def roots(self) -> np.ndarray:
        while (self.to != (up := self.to[self.to])).any():
            self.to = up
        return self.to


def _block_step(threshold: float, grp: pa.DataType):  # noqa: ANN202
    schema = pa.schema([("kind", pa.int32()), *_fields(grp)])

    def run(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        own, foreign, looked = (table.filter(pa.array(kind == k)) for k in (CLUSTER, CENTRE, LOOKED))
        if not own.num_rows:
            return schema.empty_table()
        g, blk = own.column("grp")[0].as_py(), own.column("blk")[0].as_py()
        width = len(own.column("mean")[0])
        centres = _vectors(foreign.column("mean")) if foreign.num_rows else np.zeros((0, width))
        b = Block(own, centres, foreign.column("dist").to_numpy() if foreign.num_rows else np.zeros(0), threshold, looked)
        b.merge()
        roots = b.roots()
        at = np.flatnonzero(b.alive)
        near = b.near[at]
        # a neighbour in another block, known from an earlier round, is kept
        other = np.where(near >= 0, b.ids[near], b.other[at])
        some = (near >= 0) | (b.known[at] & b.exact[at])
        fit = some & (b.dist[at] < threshold)
        # what is not certain asks the blocks that may hold something nearer
        asks, ends, blocks = [], np.zeros(len(at), np.int64), foreign.column("blk2").to_numpy() if foreign.num_rows else np.zeros(0, np.int64)
        open_ = np.flatnonzero(~b.exact[at])
        for lo in range(0, len(open_), 1024):
            mine = open_[lo : lo + 1024]
            bar = np.minimum(b.dist[at[mine]], threshold)
            i, k = np.nonzero(b.bounds(at[mine]) - _ROOM <= bar[:, None])
            ends[mine] = np.bincount(i, minlength=len(mine))
            asks.append(blocks[k])
        asks = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends.cumsum()]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *asks])))
        out = [_rows(schema, len(at), kind=np.full(len(at), CLUSTER), grp=[g] * len(at), blk=np.full(len(at), blk), cid=b.ids[at], size=b.sizes[at].astype(np.int64),
                     other=pa.array(other, mask=~fit), dist=pa.array(b.dist[at], mask=~fit), settled=b.exact[at], mean=_lists(b.means[at]), asks=asks)]
        n = len(b.ids)
        out.append(_rows(schema, n, kind=np.full(n, MOVED), grp=[g] * n, blk=np.full(n, blk), cid=b.ids, other=b.ids[roots]))
        out.append(_rows(schema, 1, kind=[COUNT], grp=[g], size=[b.pairs]))
        return pa.Table.from_batches(out)

    return run


def _summaries(state: DataFrame, g: str) -> DataFrame:
    """Centre and radius of every block."""

    def run(table: pa.Table) -> pa.Table:
        m = _vectors(table.column("mean"))
        c = m.mean(0)
        r = float(np.sqrt(((m - c) ** 2).sum(1)).max())
        return pa.table({"grp": table.column("grp").slice(0, 1), "blk": table.column("blk").slice(0, 1), "mean": [c], "dist": [r]})

    return state.groupBy("grp", "blk").applyInArrow(run, f"grp {g}, blk long, mean array<double>, dist double")


def _ask(state: DataFrame, asks: DataFrame, threshold: float, grp: pa.DataType, g: str, k: int = 1) -> DataFrame:
    """The nearest within each block that was asked, if below the threshold: ``cid``, ``other``, ``dist``; with more than one, a row for all that
    asked, with them as ``asks`` and the distance up to which none is missing as ``dist``.

    A block's clusters come first, those that ask stream past them. A block that many ask is held by several tasks. ``pairs``, in rows without
    ``cid``, counts distances."""
    slices = asks.groupBy("grp", "blk").agg(F.ceil(F.count(F.lit(1)) / _ASKED).alias("slices"))
    held = state.select("grp", "blk", "cid", "mean").join(slices, ["grp", "blk"]).withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
    sent = asks.join(slices, ["grp", "blk"]).withColumn("slice", F.pmod(F.xxhash64("cid"), F.col("slices")))
    names = ["grp", "blk", "slice", "kind", "cid", "mean"]
    both = held.withColumn("kind", F.lit(0)).select(*names).unionByName(sent.withColumn("kind", F.lit(1)).select(*names))
    both = both.repartition(4 * both.sparkSession.sparkContext.defaultParallelism, "grp", "blk", "slice").sortWithinPartitions(*names[:5])
    schema = pa.schema([("grp", grp), ("blk", pa.int64()), ("cid", pa.int64()), ("other", pa.int64()), ("dist", pa.float64()), ("asks", pa.list_(pa.int64())), ("pairs", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, means, single = None, [], [], None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            new = np.zeros(table.num_rows, bool)
            for name in names[:4]:
                column = table.column(name).combine_chunks()
                new[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
            for lo, hi in zip(starts := [0, *np.flatnonzero(new)], [*starts[1:], table.num_rows], strict=True):
                part = table.slice(lo, hi - lo)
                gr, *key, kind = (part.column(name)[0].as_py() for name in names[:4])
                if (gr, *key) != now:
                    now, ids, means, single = (gr, *key), [], [], None
                cid, m = part.column("cid").to_numpy(), _vectors(part.column("mean"))
                if not kind:
                    ids.append(cid)
                    means.append(m)
                    continue
                if not len(ids):
                    continue
                if single is None:
                    ids, means = np.concatenate(ids), np.concatenate(means)
                    single = means.astype(np.float32)
                own = np.minimum(np.searchsorted(ids, cid), len(ids) - 1)
                places, dist = nearest(m, np.where(ids[own] == cid, own, -1), means, single, np.ones(len(ids), bool), threshold, k)
                n = len(cid)
                if k == 1:
                    at = np.flatnonzero(places[:, 0] >= 0)
                    yield _rows(schema, len(at), grp=[gr] * len(at), blk=np.full(len(at), key[0]), cid=cid[at], other=ids[places[at, 0]], dist=dist[at, 0])
                else:
                    there = places >= 0
                    few = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], there.sum(1).cumsum()]), pa.int32()), pa.array(ids[places[there]]))
                    yield _rows(schema, n, grp=[gr] * n, blk=np.full(n, key[0]), cid=cid, dist=np.where(there[:, -1], dist[:, -1], threshold), asks=few)
                yield _rows(schema, 1, grp=[gr], pairs=[n * len(ids)])

    return both.mapInArrow(run, f"grp {g}, blk long, cid long, other long, dist double, asks array<long>, pairs long")


def _dealt(unit: DataFrame, block: int) -> DataFrame:
    """Rows with the block that they lie in: cells of like signs against fixed planes, split where they hold over ``block``."""

    @F.arrow_udf("long")
    def code(mean: pa.Array) -> pa.Array:
        m = mean.flatten().to_numpy().reshape(len(mean), -1)
        planes = np.random.default_rng(7).normal(size=(m.shape[1], _BITS)) if len(m) else np.zeros((0, _BITS))
        return pa.array((m @ planes > 0) @ (1 << np.arange(_BITS)), pa.int64())

    size = unit.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    bits = F.least(F.lit(_BITS), F.ceil(F.log2(F.greatest(F.col("n") / block, F.lit(1.0))) * 1.5)).cast("int")
    rows = unit.withColumn("code", code("mean")).join(size, "grp")
    rows = rows.withColumn("cell", F.col("code") % F.pow(F.lit(2), bits).cast("long"))
    parts = rows.groupBy("grp", "cell").agg(F.ceil(F.count(F.lit(1)) / block).alias("parts"))
    rows = rows.join(parts, ["grp", "cell"])
    blk = F.col("cell") * F.lit(1 << 40) + F.pmod(F.xxhash64("cid"), F.col("parts"))
    return rows.withColumn("blk", blk.cast("long")).withColumn("many", F.col("n") > block)


def clusters(vectors: DataFrame, threshold: float = 0.65, block: int = BLOCK, pairs: list[int] | None = None) -> DataFrame:
    """(grp, id, cluster): average-linkage clusters of (grp, id, vec) below a cosine distance; the least id names a cluster.

    Ids are unique in a group. Null vectors, and those without a direction (zero, or a null or non-finite component), are clusters of
    their own. Equal distances go to the smaller id. ``pairs``, if given, receives the number of distances computed in each round.
    """
    g = vectors.schema["grp"].dataType.simpleString()
    grp = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}[g]
    vec = F.transform("vec", lambda x: x.cast("double"))
    # the norm is taken once for all components: as a column, it would be taken anew for each of them
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    unit = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x, lambda a: F.transform("v", lambda x: x / F.sqrt(a)))
    rows = vectors.select("grp", F.col("id").cast("long").alias("cid"), vec.alias("v"))
    good = F.coalesce((square > 0) & (square < float("inf")), F.lit(False))
    lone = rows.where(~good).select("grp", F.col("cid").alias("id"), F.col("cid").alias("cluster"))
    unit = rows.where(good).select("grp", "cid", unit.alias("mean"))
    same = None
    if threshold > 0:
        unit = cut_lineage(unit.withColumn("hash", F.xxhash64("mean")))
        one = cut_lineage(unit.groupBy("grp", "hash", "mean").agg(F.min("cid").alias("first"), F.count(F.lit(1)).alias("size")))
        # the few that others equal are met by hash, not by sorting vectors
        met = one.where("size > 1").select("grp", "hash", F.col("mean").alias("equal"), "first")
        met = unit.join(met, ["grp", "hash"]).where(~(F.col("mean") < F.col("equal")) & ~(F.col("mean") > F.col("equal")))
        alone = one.where("size = 1 and grp is not null").select("grp", F.col("first").alias("id"), F.col("first").alias("cluster"))
        same = alone.unionByName(met.select("grp", F.col("cid").alias("id"), F.col("first").alias("cluster")))
        unit = one.select("grp", F.col("first").alias("cid"), "size", "mean")
    else:
        unit = unit.withColumn("size", F.lit(1).cast("long"))
    start = _dealt(unit, block).select(
        "grp", "blk", "cid", "size", F.lit(None).cast("long").alias("other"), F.lit(None).cast("double").alias("dist"),
        F.lit(False).alias("settled"), "mean", "many")
    state = stored(start)
    spread, crowded = _spread(state)
    schema = "kind int, " + _STATE.format(g=g)
    names = ["grp", "blk", "cid", "size", "other", "dist", "settled", "mean"]
    member = None
    while True:
        many = state.where("many")
        centres = _summaries(many, g)
        # every block of a group of several hears of the others' centres
        blocks = centres.select("grp", F.col("blk").alias("blk2"), "mean", "dist").join(many.select("grp", "blk").distinct(), "grp").where("blk <> blk2")
        fed = state.select(*names, F.lit(CLUSTER).alias("kind"), F.lit(None).cast("long").alias("blk2")).unionByName(blocks.withColumn("kind", F.lit(CENTRE)), allowMissingColumns=True)
        if crowded:
            # the first look goes through all pairs of a block: several tasks do it for one
            open_ = state.where("not settled")
            crowd = open_.groupBy("grp", "blk").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > _ASKED).select("grp", "blk")
            looked = _ask(state, open_.select("grp", "blk", "cid", "mean").join(crowd, ["grp", "blk"]), threshold, grp, g, _KEPT)
            fed = fed.unionByName(looked.where("cid is not null").select("grp", "blk", "cid", "dist", "asks", F.lit(LOOKED).alias("kind")), allowMissingColumns=True)
        out = cut_lineage((fed.repartition(spread, "grp", "blk") if spread else fed).groupBy("grp", "blk").applyInArrow(_block_step(threshold, grp), schema))
        moved = out.where(F.col("kind") == MOVED).select("grp", "blk", "cid", F.col("other").alias("to"))
        if member is None:
            member = moved.select("grp", F.col("cid").alias("id"), F.col("to").alias("cluster")) if same is None else _renamed(same, moved)
        else:
            member = _renamed(member, moved)
        now = out.where(F.col("kind") == CLUSTER).select(*names, "asks")
        if pairs is not None:
            pairs.append(out.where(F.col("kind") == COUNT).agg(F.sum("size")).first()[0] or 0)
        if now.where(F.col("other").isNotNull() | (F.size("asks") > 0)).isEmpty():
            return member.unionByName(lone)
        asks = now.where(F.size("asks") > 0).select("grp", F.explode("asks").alias("blk"), "cid", "mean")
        now = now.drop("asks")
        # a neighbour that another block merged in this round is no longer known
        merged = moved.where("cid <> to")
        touched = merged.select("grp", F.col("blk").alias("home"), F.col("cid").alias("other")).union(merged.select("grp", "blk", "to")).distinct()
        stale = cut_lineage(now.join(touched, ["grp", "other"]).where("blk <> home").select("grp", "cid", F.lit(True).alias("stale")))
        found = _ask(now, asks, threshold, grp, g)
        if pairs is not None:
            found = cut_lineage(found)
            pairs[-1] += found.agg(F.sum("pairs")).first()[0] or 0
        # the nearest of all: here, or in a block that was asked
        near = now.where("other is not null").join(stale, ["grp", "cid"], "left_anti").select("grp", "cid", "other", "dist")
        near = near.unionByName(found.where(F.col("dist") < threshold).select("grp", "cid", "other", "dist"))
        near = cut_lineage(near.groupBy("grp", "cid").agg(F.min(F.struct("dist", "other")).alias("m")).select("grp", "cid", "m.other", "m.dist"))
        back = near.select("grp", F.col("cid").alias("other"), F.col("other").alias("cid"))
        mutual = near.join(back, ["grp", "cid", "other"], "left_semi").where(F.col("cid") < F.col("other"))
        mutual = cut_lineage(mutual.select("grp", F.col("cid").alias("kept"), F.col("other").alias("gone")))
        if mutual.isEmpty() and stale.isEmpty():
            return member.unionByName(lone)
        state = _merged(now, near, mutual, stale)
        member = stored(_renamed(member, mutual.select("grp", F.col("gone").alias("cid"), F.col("kept").alias("to"))))


def _spread(state: DataFrame) -> tuple[int, bool]:
    """Tasks that the blocks are dealt to, and whether large blocks are fewer than there are cores. 0 leaves it to Spark, which goes by bytes; large
    blocks cost more than these tell."""
    blocks = state.groupBy("grp", "blk").agg(F.count(F.lit(1)).alias("n"))
    many, rows, most = blocks.agg(F.count(F.lit(1)), F.sum("n"), F.max("n")).first()
    return min(4 * many, (rows or 0) // 2048), (most or 0) > _ASKED and many < state.sparkSession.sparkContext.defaultParallelism


def _renamed(member: DataFrame, moved: DataFrame) -> DataFrame:
    to = moved.select("grp", F.col("cid").alias("cluster"), "to")
    return member.join(to, ["grp", "cluster"], "left").select("grp", "id", F.coalesce("to", "cluster").alias("cluster"))


def _merged(now: DataFrame, near: DataFrame, mutual: DataFrame, stale: DataFrame) -> DataFrame:
    """State after the merges of ``mutual``. Groups in which nothing happens any more are finished and leave it."""
    grps = mutual.select("grp").union(stale.select("grp")).distinct()
    rows = now.join(grps, "grp", "left_semi").drop("other", "dist", "settled").join(near, ["grp", "cid"], "left")
    ends = mutual.select("grp", F.col("kept").alias("cid"), F.col("kept").alias("to")).unionByName(mutual.select("grp", F.col("gone").alias("cid"), F.col("kept").alias("to")))
    ends = cut_lineage(ends)
    lost = ends.select("grp", F.col("cid").alias("other"), F.lit(True).alias("lost"))
    rows = rows.join(ends, ["grp", "cid"], "left").join(lost, ["grp", "other"], "left").join(stale, ["grp", "cid"], "left")
    home = F.coalesce("to", "cid")
    one = F.struct(F.when(F.col("cid") == home, 0).otherwise(1).alias("second"), "blk", "size", "mean")
    keep = F.col("to").isNull() & F.col("lost").isNull() & F.col("stale").isNull()
    met = rows.groupBy("grp", home.alias("cid")).agg(
        F.array_sort(F.collect_list(one)).alias("m"), F.sum("size").alias("all"), F.max(F.when(keep, F.struct("other", "dist"))).alias("nn"), F.bool_and(keep).alias("settled"))
    x, y = F.get("m", F.lit(0)), F.get("m", F.lit(1))
    # pairs are disjoint: at most two rows meet under one id
    mean = F.when(F.size("m") == 1, x["mean"]).otherwise(F.zip_with(x["mean"], y["mean"], lambda u, v: (u * x["size"] + v * y["size"]) / F.col("all")))
    return stored(met.select("grp", x["blk"].alias("blk"), "cid", F.col("all").alias("size"), "nn.other", "nn.dist", "settled", mean.alias("mean"), F.lit(True).alias("many")))
