"""Hierarchical Pitman-Yor language model: seating by Gibbs sweeps over context buckets, averaged predictions.

Restaurants: one for every two words that stand before a word, one for every word before, which is the parent of those,
and one without context, their common parent, above a uniform base over the known words and one unknown. Words are told
apart by 64 bits of hash.

A bucket has the restaurants of some words before with all that they are the parent of, so their seating needs nothing else
but the tables of the common parent. These lie by word, and after each sweep a bucket asks the words that it holds for theirs.
A frequent word before would fill its bucket: the restaurants with two words below it are dealt over all buckets by the second
word, and its own is kept by word beside the common parent. Which words are frequent is guessed from a part of the texts;
that only moves work, every token is counted and scored in its context.

Tokens take far more room on disk than what is kept of them. So buckets are filled in passes over the texts, each for its share of the
buckets, and swept and scored in rounds, each for every ``rounds``-th bucket. What is shuffled goes once its table is written.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, column_of, partitions, scatter, shared_folder, small_batches, staged, texts_of

#: Words that one numbering can hold; a context is the number of the word before and that of the one before it.
BASE = 1 << 28
CONTEXTS = BASE * BASE
END = np.uint64(0xFFFFFFFFFFFFFFE0)  # id of the end, and of no word before

#: Tokens and documents that a task gathers before it sends them to the buckets, and bytes of text that it cuts at a time.
TOKENS, DOCS, BYTES = 2_000_000, 8192, 2_000_000

_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\n\x0b\x0c\r")] = True


class WordIds(dict):
    """Word bytes to their number from 1 on, in the order met; ``ids``: 64 bits of hash by number, the end's at 0."""

    def __init__(self) -> None:
        super().__init__()
        self.ids = np.full(1024, END, np.uint64)

    def __missing__(self, word: bytes) -> int:
        out = self[word] = len(self) + 1
        if out == len(self.ids):
            self.ids = np.concatenate([self.ids, np.full(out, END, np.uint64)])
        self.ids[out] = xxhash.xxh3_64_intdigest(word)
        return out


def tokens(text: bytes, known: WordIds) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a text's words and its end, and the context of each: numbers of the word before and the one before that."""
    words = text.lower().split()
    before = np.zeros(len(words) + 2, np.int64)
    before[2:] = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    return known.ids[np.append(before[2:], 0)], before[1:] * BASE + before[:-1]


def buckets_of(ids: np.ndarray, n: int) -> np.ndarray:
    return (scatter(ids) % np.uint64(n)).astype(np.int32)


def word_buckets_of(ids: np.ndarray, n: int) -> np.ndarray:
    return buckets_of(ids ^ np.uint64(0x5851F42D4C957F2D), n)


def pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *[len(a) for a in arrays]], "<i8").tobytes()
    kinds = b"".join(a.dtype.str.encode().ljust(4) for a in arrays)
    # byte by byte of all numbers: the higher bytes are much alike
    return zstandard.compress(head + kinds + b"".join(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in map(np.ascontiguousarray, arrays)), 3)


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(blob)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    sizes = np.frombuffer(raw, "<i8", n, 8)
    at, out = 8 + 12 * n, []
    for k, size in enumerate(sizes):
        kind = np.dtype(raw[8 + 8 * n + 4 * k : 12 + 8 * n + 4 * k].strip().decode())
        planes = np.frombuffer(raw, np.uint8, int(size) * kind.itemsize, at).reshape(kind.itemsize, -1)
        at += planes.nbytes
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(-1))
    return out


# --- the model ----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Prior:
    """Discounts and strengths of the three levels, from no context to two words."""

    discount: tuple[float, float, float] = (0.8, 0.8, 0.8)
    strength: tuple[float, float, float] = (1.0, 5.0, 5.0)
    burn_in: int = 1
    samples: int = 2
    seed: int = 3


@dataclass
class Totals:
    """Customers and tables after each sweep, summed over all words: of the frequent words' restaurants and, last, of the
    one without context."""

    words: int
    tokens: int
    sweeps: list[np.ndarray] = field(default_factory=list)

    @staticmethod
    def split(flat: np.ndarray) -> list[np.ndarray]:
        return np.split(flat, 2)


def seat(customers: np.ndarray, new: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish after its customers sat down anew: the first opens a table, each later one does with
    a chance of ``new`` against the customers at its tables less their discount. From the 33rd on they
    come in blocks of a sixteenth of those seated."""
    out = (customers > 0).astype(np.int64)
    several = np.flatnonzero(customers > 1)
    order = several[np.argsort(-customers[several], kind="stable")]
    left, a, tables = customers[order], new[order], out[order]
    i = 1
    while True:
        active = int(np.searchsorted(-left, -i, "left"))
        if not active:
            break
        step = 1 if i < 32 else i // 16
        chance = a[:active] / (a[:active] + i - discount * tables[:active])
        tables[:active] += rng.binomial(np.minimum(step, left[:active] - i), np.clip(chance, 0, 1))
        i += step
    out[order] = tables
    return out


def root_chance(customers: np.ndarray, tables: np.ndarray, words: int, flat: list[np.ndarray], prior: Prior) -> np.ndarray:
    """Predictive probability without context of words with these customers and tables there."""
    d, s = prior.discount[0], prior.strength[0]
    return (customers - d * tables + (s + d * flat[1][-1]) / (words + 1)) / (s + flat[0][-1])


def root_tables(customers: np.ndarray, words: int, flat: list[np.ndarray], prior: Prior, rng: np.random.Generator) -> np.ndarray:
    d, s = prior.discount[0], prior.strength[0]
    return seat(customers, np.full(len(customers), (s + d * flat[1][-1]) / (words + 1)), d, rng)


class Bucket:
    """Seating of the contexts of one bucket. Entries are sorted by word and context, so each parent's are together; those
    that are only asked for have no customers. ``shared``: ids of the frequent words, sorted; their restaurants and the
    one without context hear their customers and tables from outside."""

    def __init__(self, number: int, ids: np.ndarray, index: np.ndarray, context: np.ndarray, count: np.ndarray, shared: np.ndarray | None = None) -> None:
        self.number, self.ids, self.index, self.c2 = number, ids, index, count
        coded = pa.array(context).dictionary_encode()  # in the order met
        self.pairs, self.at2 = coded.dictionary.to_numpy(), coded.indices.to_numpy()
        new = np.diff(index * BASE + context // BASE, prepend=-1) != 0
        self.start1, self.of1 = np.flatnonzero(new), np.cumsum(new) - 1
        self.index1 = index[self.start1]
        self.firsts, self.at1 = np.unique((context // BASE)[self.start1], return_inverse=True)
        self.asked = self.index1[np.diff(self.index1, prepend=-1) != 0]
        self.count = np.bincount(index, count, len(ids)).astype(np.int64)
        self.shared = np.zeros(0, np.uint64) if shared is None else shared
        #: place of each word before among the frequent ones, or -1, and level-1 entries of those
        self.place = np.full(len(self.firsts), -1)
        if len(self.shared):
            known = ids[self.firsts]
            at = np.minimum(np.searchsorted(self.shared, known), len(self.shared) - 1)
            self.place = np.where(self.shared[at] == known, at, -1)
        self.out1 = np.flatnonzero(self.place[self.at1] >= 0)
        self.in1 = self.place[self.at1] < 0
        self.t2 = (count > 0).astype(np.int64)
        self.sum_up()
        self.t1 = (self.c1 > 0).astype(np.int64)
        self.sum_up()
        self.t0, self.heard0 = (self.c0 > 0).astype(np.int64), self.c0

    def sum_up(self) -> None:
        self.c1 = np.add.reduceat(self.t2, self.start1) if len(self.t2) else self.t2
        if hasattr(self, "t1"):
            self.c0 = np.bincount(self.index1[self.in1], self.t1[self.in1], len(self.ids)).astype(np.int64)

    def totals(self) -> np.ndarray:
        """Of the restaurant without context, where all contexts of the words are here."""
        return np.array([self.c0.sum(), self.t0.sum()], float)

    def parents(self, flat: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Customers and tables of the restaurants of one word before."""
        c, t = (np.bincount(self.at1, x, len(self.firsts)) for x in (self.c1, self.t1))
        out = self.place >= 0
        c[out], t[out] = flat[0][self.place[out]], flat[1][self.place[out]]
        return c, t

    def p1(self, p0: np.ndarray, flat: list[np.ndarray], prior: Prior) -> np.ndarray:
        d, s = prior.discount[1], prior.strength[1]
        c, t = self.parents(flat)
        return (self.c1 - d * self.t1 + (s + d * t[self.at1]) * p0[self.index1]) / (s + c[self.at1])

    def p2(self, words: int, flat: list[np.ndarray], prior: Prior) -> np.ndarray:
        """Predictive probability of every entry."""
        d, s = prior.discount[2], prior.strength[2]
        p1 = self.p1(root_chance(self.c0, self.t0, words, flat, prior), flat, prior)
        c, t = (np.bincount(self.at2, x, len(self.pairs))[self.at2] for x in (self.c2, self.t2))
        return (self.c2 - d * self.t2 + (s + d * t) * p1[self.of1]) / (s + c)

    def reseat(self, number: int, words: int, flat: list[np.ndarray], prior: Prior) -> np.random.Generator:
        """All customers of each dish leave and sit down again, restaurants with two words first, then those with one."""
        rng = np.random.default_rng([prior.seed, self.number, number])
        p0 = root_chance(self.c0, self.t0, words, flat, prior)
        p1 = self.p1(p0, flat, prior)
        d, s = prior.discount, prior.strength
        t = self.parents(flat)[1]
        self.t2 = seat(self.c2, (s[2] + d[2] * np.bincount(self.at2, self.t2, len(self.pairs))[self.at2]) * p1[self.of1], d[2], rng)
        self.c1 = np.add.reduceat(self.t2, self.start1) if len(self.t2) else self.t2
        mine = self.in1
        self.t1[mine] = seat(self.c1[mine], (s[1] + d[1] * t[self.at1[mine]]) * p0[self.index1[mine]], d[1], rng)
        self.sum_up()
        return rng

    def sweep(self, number: int, words: int, flat: list[np.ndarray], prior: Prior) -> None:
        """A whole sweep, where all contexts of the words are here."""
        rng = self.reseat(number, words, flat, prior)
        self.t0 = root_tables(self.c0, words, flat, prior, rng)

    def predict(self, flat: list[np.ndarray], words: int, prior: Prior, ids: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Predictive probability of words in contexts, unknown words and unseen pairs included."""
        d, s = prior.discount, prior.strength

        def found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            if not len(keys):
                return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
            order = np.argsort(keys, kind="stable")
            at = order[np.minimum(np.searchsorted(keys, wanted, sorter=order), len(keys) - 1)]
            return at, keys[at] == wanted

        def of(at: np.ndarray, ok: np.ndarray, values: np.ndarray) -> np.ndarray:
            return np.where(ok, values[at], 0) if len(values) else np.zeros(len(at))

        word, pair, first = found(self.ids, ids), found(self.pairs, context), found(self.firsts, context // BASE)
        e1 = found(self.index1 * len(self.firsts) + self.at1, np.where(word[1] & first[1], word[0] * len(self.firsts) + first[0], -1))
        e2 = found(self.index * len(self.pairs) + self.at2, np.where(word[1] & pair[1], word[0] * len(self.pairs) + pair[0], -1))
        c, t = (of(*first, x) for x in self.parents(flat))
        p0 = root_chance(of(*word, self.c0), of(*word, self.t0), words, flat, prior)
        p1 = (of(*e1, self.c1) - d[1] * of(*e1, self.t1) + (s[1] + d[1] * t) * p0) / (s[1] + c)
        c, t = (of(*pair, np.bincount(self.at2, x, len(self.pairs))) for x in (self.c2, self.t2))
        return (of(*e2, self.c2) - d[2] * of(*e2, self.t2) + (s[2] + d[2] * t) * p1) / (s[2] + c)

    # what a bucket asks the words, and hears from them

    def parts(self, m: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each word bucket: the words asked for, and the entries of frequent words before."""
        to, of = word_buckets_of(self.ids[self.asked], m), word_buckets_of(self.ids[self.index1[self.out1]], m)
        for b in np.unique(to):
            yield int(b), self.asked[to == b], self.out1[of == b]

    def asks(self, m: int) -> Iterator[tuple[int, bytes]]:
        """The words that are asked for and their count, and which of them come after which frequent words."""
        for b, words, out in self.parts(m):
            yield b, pack(self.ids[words], small(self.count[words]), small(np.searchsorted(words, self.index1[out])), small(self.place[self.at1[out]]))

    def sends(self, m: int) -> Iterator[tuple[int, bytes]]:
        """Customers that the seating here sends to what was asked for, and the words' customers and tables before it."""
        for b, words, out in self.parts(m):
            yield b, pack(small(self.c0[words]), small(self.c1[out]), small(self.heard0[words]), small(self.t0[words]))

    def hear(self, replies: dict[int, list[np.ndarray]], m: int) -> None:
        """Takes the customers and tables of words and of frequent words before; at first also the words' count."""
        self.c0, self.t0, self.t1 = self.c0.copy(), np.zeros(len(self.ids), np.int64), self.t1.copy()
        for b, words, out in self.parts(m):
            c0, t0, c1, t1, count = replies[b]
            self.c0[words], self.t0[words], self.c1[out], self.t1[out] = c0, t0, c1, t1
            if len(count):
                self.count[words] = count
        self.heard0 = self.c0


def small(a: np.ndarray) -> np.ndarray:
    """The same whole numbers, none negative, in as few bytes as hold the largest."""
    return a.astype(np.min_scalar_type(int(a.max(initial=0))))


# --- passes over the corpus ---------------------------------------------------------------------------


def _held_out(ids: list[int | None], folds: int, fold: int) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % folds == fold for i in ids], bool)


def _cut(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts, an empty one after those of each for its end, and how many each text gives."""
    data = np.frombuffer(b"\n".join([*texts, b""]).lower(), np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    inside = ~_BLANK[data]
    starts = np.flatnonzero(inside & np.append(True, ~inside[:-1]))
    letters, at = np.cumsum(inside), np.searchsorted(starts, ends)
    offsets = np.append(np.insert(letters[starts] - 1, at, letters[ends]), letters[-1]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
    return words, np.diff(at, prepend=0) + 1


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(doc ids, tokens of each, numbers of the word before each token, of the one before it and of the token, ids by number)
    for some TOKENS tokens or DOCS documents at most. The tokens of each text are those of ``tokens``."""
    docs, texts, sizes, words, size, total = [], [], [], [], 0, 0

    def cut() -> int:
        new, n = _cut(texts)
        words.append(new)
        sizes.append(n)
        texts.clear()
        return len(new)

    def out() -> tuple:
        coded = pa.concat_arrays([pa.array([b""], pa.binary()), *words]).dictionary_encode()
        words.clear()
        word, none = coded.indices.to_numpy()[1:], np.zeros(1, np.int32)
        ids = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
        ids[0] = END
        # a token is the next one's word before; the end and no word before are both 0
        first = np.concatenate([none, word[:-1]])
        second = np.where(first == 0, none, np.concatenate([none, first[:-1]]))
        return docs, np.concatenate(sizes), first, second, word, ids

    for batch in batches:
        for name, text in zip(column_of(batch, "doc_id").to_pylist(), texts_of(column_of(batch, "text")), strict=True):
            docs.append(name)
            texts.append(text)
            size += len(text)
            if size >= BYTES or len(docs) == DOCS:
                size, total = 0, total + cut()
            if total >= TOKENS or len(docs) == DOCS:
                yield out()
                docs, sizes, words, total = [], [], [], 0
    if texts:
        cut()
    if docs:
        yield out()


def _frequent(rows: DataFrame, n: int, one_in: int) -> np.ndarray:
    """Ids of the words before that seem to have more than a bucket's share of the tokens, sorted; n at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("n", pa.int64())])
        for _, _, first, _, _, ids in _gathered(batches):
            yield batch_of(schema, [ids.view(np.int64), np.bincount(first, minlength=len(ids))])

    part = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(one_in)) == 0)
    seen = staged(part.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")), "frequent")
    total = seen.agg(F.sum("n")).first()[0] or 0
    got = seen.where(F.col("n") * n > total).select("id").collect()
    return np.sort(np.array([r.id for r in got], np.int64).view(np.uint64))


_MODEL, _USES, _DOCS, _STATE, _ASK, _SENDS, _REPLY, _TOTAL = range(8)
_SENT = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("run", pa.int64()), ("blob", pa.binary())])
_TALK = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("source", pa.int32()), ("sweep", pa.int32()), ("n", pa.float64()), ("blob", pa.binary())])
_SENT_DDL = "bucket int, kind int, run long, blob binary"
_TALK_DDL = "bucket int, kind int, source int, sweep int, n double, blob binary"


def _table(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([batch_of(schema, zip(*rows, strict=True))]) if rows else schema.empty_table()


def _kept(df: DataFrame, path: str) -> DataFrame:
    """Writes ``df`` over what was there and reads it back; files that its shuffles left are removed with the end of the write."""
    spark, name = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)
    return spark.read.schema(df.schema).parquet(path)


def _sent(rows: DataFrame, n: int, frequent: np.ndarray, turn: int, passes: int, rounds: int) -> DataFrame:
    """Every token of the buckets of a pass with its context, packed by run of documents for the bucket of the context."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for k, (names, sizes, first, second, word, ids) in enumerate(_gathered(batches)):
            m, held, home = len(names), _held_out(names, 10, 0), (task + k) % n
            null, names, sizes = np.array([x is None for x in names]), np.array([x or 0 for x in names], "<i8"), sizes.astype("<i8")
            # every pass has to meet the same runs: one with other documents gets another number
            run = xxhash.xxh3_64_intdigest(np.concatenate([[task, k], names, sizes]).tobytes()) >> 1
            if home % rounds % passes == turn:
                yield _table(_SENT, [(home, _DOCS, run, pack(names, null, held, sizes))]).to_batches()[0]
            bucket = buckets_of(ids, n)[first]
            dealt = np.isin(ids, frequent)[first]
            bucket[dealt] = buckets_of(ids[first[dealt]] ^ scatter(ids[second[dealt]]), n)
            mine = np.flatnonzero(bucket % rounds % passes == turn)
            doc, bucket = np.repeat(np.arange(m), sizes)[mine], bucket[mine]
            order = np.argsort(bucket.astype(np.uint16) if n < 1 << 16 else bucket, kind="stable")
            at = mine[order]
            first, second, word, doc = first[at], second[at], word[at], doc[order]
            cut = np.searchsorted(bucket[order], np.arange(n + 1))
            bits, out = np.packbits(held), []
            mark, place = np.zeros(len(ids), bool), np.zeros(len(ids), np.int32)
            for b in np.flatnonzero(np.diff(cut)):
                at = slice(cut[b], cut[b + 1])
                three = first[at], second[at], word[at]
                for x in three:
                    mark[x] = True
                used = np.flatnonzero(mark)
                mark[used], place[used] = False, np.arange(len(used))
                out.append((int(b), _USES, run, pack(ids[used], *[place[x].astype(np.min_scalar_type(len(used))) for x in three], small(np.diff(doc[at], prepend=0)), bits)))
            yield _table(_SENT, out).to_batches()[0]

    return rows.mapInArrow(send, _SENT_DDL)


def _merge(group: pa.Table) -> pa.Table:
    """The entries of a bucket with their training counts, and the entry of every token of each run."""
    bucket, rows, runs, parts = group.column("bucket")[0].as_py(), [], [], []
    for kind, run, blob in zip(*[group.column(c).to_pylist() for c in ("kind", "run", "blob")], strict=True):
        if kind == _DOCS:
            rows.append((bucket, _DOCS, run, blob))
        else:
            runs.append(run)
            parts.append(unpack(blob))
    if not runs:
        return _table(_SENT, rows)
    ids, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    of = np.split(inverse, np.cumsum([len(p[0]) for p in parts])[:-1])
    first, second, word = (np.concatenate([i[p[k]] for i, p in zip(of, parts, strict=True)]) for k in (1, 2, 3))
    if len(ids) < 1 << 21:
        keys, entry = np.unique((word * len(ids) + first) * len(ids) + second, return_inverse=True)
        word, context = keys // len(ids) ** 2, keys % len(ids) ** 2
        first, second = context // len(ids), context % len(ids)
    else:
        pairs, at = np.unique(first * BASE + second, return_inverse=True)
        keys, entry = np.unique(word * len(pairs) + at, return_inverse=True)
        word, context = keys // len(pairs), pairs[keys % len(pairs)]
        first, second = context // BASE, context % BASE
    docs = [np.cumsum(p[4].astype(np.int64)) for p in parts]
    train = np.concatenate([np.unpackbits(p[5])[d] == 0 for p, d in zip(parts, docs, strict=True)])
    count = np.bincount(entry, train, len(keys)).astype(np.int64)
    per = np.bincount(word, minlength=len(ids))
    rows.append((bucket, _MODEL, 0, pack(ids, small(per), small(first), small(second), small(count))))
    lo = 0
    for run, p in zip(runs, parts, strict=True):
        rows.append((bucket, _USES, run, pack(small(entry[lo : lo + len(p[4])]), p[4])))
        lo += len(p[4])
    return _table(_SENT, rows)


def _bucket(number: int, blob: bytes, shared: np.ndarray) -> Bucket:
    ids, per, first, second, count = unpack(blob)
    return Bucket(number, ids, np.repeat(np.arange(len(ids)), per), first.astype(np.int64) * BASE + second, count.astype(np.int64), shared)


def _back(talk: pa.Table, sweep: int) -> tuple[list[np.ndarray], dict[int, list[np.ndarray]]]:
    """A bucket's state after a sweep and the replies to it, by word bucket."""
    state, replies = [], {}
    for kind, source, at, blob in zip(*[talk.column(c).to_pylist() for c in ("kind", "source", "sweep", "blob")], strict=True):
        if at == sweep and kind == _STATE:
            state = [x.astype(np.int64) for x in unpack(blob)]
        elif at == sweep:
            replies[source] = unpack(blob)
    return state, replies


def _restore(b: Bucket, talk: pa.Table, sweep: int, m: int) -> None:
    state, replies = _back(talk, sweep)
    b.t2, b.t1 = state[:2]
    b.sum_up()
    if len(state[2]):
        b.count[b.asked] = state[2]
    b.hear(replies, m)


class Learned:
    """Seatings of a corpus: ``talk`` has each bucket's state and the words' replies after every sweep, by round. Of these the
    last before a sweep and the samples are kept; tables that nothing asks for any more are written over."""

    def __init__(self, models: list[DataFrame], frequent: np.ndarray, n: int, m: int, prior: Prior, folder: str) -> None:
        self.models, self.frequent, self.n, self.m, self.prior, self.folder = models, frequent, n, m, prior, folder
        self.totals, self.talk = Totals(0, 0), []
        for sweep in range(prior.burn_in + prior.samples + 1):
            self._sweep(sweep)

    def _slot(self, sweep: int, first: int) -> int:
        """The sweep whose tables give way to those of this one; those before ``first`` stay."""
        return self._slot(sweep - 2, first) if first <= sweep - 2 <= self.prior.burn_in else sweep

    def _dealt(self, df: DataFrame, n: int):  # noqa: ANN202
        """Grouped by bucket, in as many partitions as there are buckets at least: a task with several takes more memory."""
        return df.repartition(max(n, partitions(df.sparkSession)), "bucket").groupBy("bucket")

    def _sweep(self, sweep: int) -> None:
        """Sweep 0 is the start, at which every dish has one table."""
        frequent, m, prior, size = self.frequent, self.m, self.prior, len(self.frequent) + 1
        words = self.totals.words
        flat = Totals.split(self.totals.sweeps[-1]) if sweep else []

        def contexts(group: pa.Table, talk: pa.Table) -> pa.Table:
            if not group.num_rows:
                return _TALK.empty_table()
            b = _bucket(group.column("bucket")[0].as_py(), group.column("blob")[0].as_py(), frequent)
            if sweep:
                _restore(b, talk, sweep - 1, m)
                b.reseat(sweep, words, flat, prior)
            rows = [(b.number, _STATE, b.number, sweep, None, pack(small(b.t2), small(b.t1), small(b.count[b.asked] if sweep else b.count[:0])))]
            rows += [(to, _SENDS, b.number, sweep, None, blob) for to, blob in b.sends(m)]
            if not sweep:
                rows += [(to, _ASK, b.number, sweep, None, blob) for to, blob in b.asks(m)]
            return _table(_TALK, rows)

        def by_word(group: pa.Table, seated: pa.Table) -> pa.Table:
            number, sources = group.column("bucket")[0].as_py(), group.column("source").to_pylist()
            asked = [unpack(x) for x in group.column("blob").to_pylist()]
            sent = dict(zip(seated.column("source").to_pylist(), seated.column("blob").to_pylist(), strict=True))
            sent = [unpack(sent[x]) for x in sources]
            ids, inverse = np.unique(np.concatenate([a[0] for a in asked]), return_inverse=True)
            of = np.split(inverse, np.cumsum([len(a[0]) for a in asked])[:-1])
            key = np.concatenate([i[a[2]] * size + a[3] for i, a in zip(of, asked, strict=True)])
            keys, entry = np.unique(key, return_inverse=True)
            of1 = np.split(entry, np.cumsum([len(a[2]) for a in asked])[:-1])
            word, place = keys // size, keys % size
            c0 = np.bincount(inverse, np.concatenate([a[0] for a in sent]), len(ids)).astype(np.int64)
            c1 = np.bincount(entry, np.concatenate([a[1] for a in sent]), len(keys)).astype(np.int64)
            count = np.zeros(0, np.int64)
            if sweep:
                last = np.zeros((2, len(ids)))
                for i, a in zip(of, sent, strict=True):
                    last[0, i], last[1, i] = a[2], a[3]
                p0 = root_chance(last[0], last[1], words, flat, prior)
                rng = np.random.default_rng([prior.seed, 1 << 31 | number, sweep])
                d, s = prior.discount[1], prior.strength[1]
                t1 = seat(c1, (s + d * flat[1][place]) * p0[word], d, rng)
            else:
                count = np.bincount(inverse, np.concatenate([a[1] for a in asked]), len(ids)).astype(np.int64)
                t1 = (c1 > 0).astype(np.int64)
            c0 += np.bincount(word, t1, len(ids)).astype(np.int64)
            t0 = root_tables(c0, words, flat, prior, rng) if sweep else (c0 > 0).astype(np.int64)
            rows = [
                (to, _REPLY, number, sweep, None, pack(small(c0[i]), small(t0[i]), small(c1[j]), small(t1[j]), small(count[i] if len(count) else count)))
                for to, i, j in zip(sources, of, of1, strict=True)
            ]
            c, t = np.bincount(place, c1, size), np.bincount(place, t1, size)
            c[-1], t[-1] = c0.sum(), t0.sum()
            rows += [(at, _TOTAL, number, sweep, float(x), None) for at, x in enumerate([*c, *t, (count > 0).sum(), count.sum()])]
            return _table(_TALK, rows)

        rounds, said = len(self.models), []
        none = self.models[0].sparkSession.createDataFrame([], _TALK_DDL)
        for turn, model in enumerate(self.models):
            left = model.where(F.col("kind") == _MODEL).select("bucket", "blob")
            before = self.talk[-1][turn] if sweep else none
            met = self._dealt(left, self.n).cogroup(before.groupBy("bucket")).applyInArrow(contexts, _TALK_DDL)
            said.append(_kept(met, f"{self.folder}/seats-{self._slot(sweep, 1)}-{turn}"))
        every = reduce(DataFrame.unionByName, said)
        if not sweep:
            self.asked = every.where(F.col("kind") == _ASK).select("bucket", "source", "blob")
        sent = every.where(F.col("kind") == _SENDS).select("bucket", "source", "blob")
        heard = _kept(self._dealt(self.asked, m).cogroup(sent.groupBy("bucket")).applyInArrow(by_word, _TALK_DDL), f"{self.folder}/words-{self._slot(sweep, 0)}")
        one = np.zeros(2 * size + 2)
        for r in heard.where(F.col("kind") == _TOTAL).groupBy("bucket").agg(F.sum("n").alias("n")).collect():
            one[r.bucket] = r.n
        if not sweep:
            self.totals = Totals(int(one[-2]), int(one[-1]))
        self.totals.sweeps.append(one[:-2])
        replies = heard.where(F.col("kind") == _REPLY)
        self.talk.append([x.where(F.col("kind") == _STATE).unionByName(replies.where(F.col("bucket") % rounds == k)) for k, x in enumerate(said)])

    def scores(self) -> DataFrame:
        """Known tokens, base and own score that the buckets of each round add to the documents of a run."""
        frequent, m, prior, totals = self.frequent, self.m, self.prior, self.totals
        sweeps = range(prior.burn_in + 1, prior.burn_in + prior.samples + 1)

        def run(group: pa.Table, talk: pa.Table) -> pa.Table:
            kinds, blobs = group.column("kind").to_pylist(), group.column("blob").to_pylist()
            if _MODEL not in kinds:
                return _SENT.empty_table()
            b = _bucket(group.column("bucket")[0].as_py(), blobs[kinds.index(_MODEL)], frequent)
            p = np.zeros(len(b.index))
            for k in sweeps:
                _restore(b, talk, k, m)
                p += b.p2(totals.words, Totals.split(totals.sweeps[k]), prior)
            p = np.log10(p / prior.samples)
            known, base = (b.count > 0)[b.index], np.log10(b.count + 0.1)[b.index]
            rows = []
            for kind, at, blob in zip(kinds, group.column("run").to_pylist(), blobs, strict=True):
                if kind == _USES:
                    entry, step = unpack(blob)
                    doc = np.cumsum(step.astype(np.int64))
                    sums = [np.bincount(doc, x[entry]) for x in (known, base, p)]
                    rows.append((b.number, _USES, at, pack(sums[0].astype("<u4"), *sums[1:])))
            return _table(_SENT, rows)

        out = []
        for turn, model in enumerate(self.models):
            talk = reduce(DataFrame.unionByName, [self.talk[k][turn] for k in sweeps])
            left = self._dealt(model.where(F.col("kind") != _DOCS), self.n)
            sums = left.cogroup(talk.groupBy("bucket")).applyInArrow(run, _SENT_DDL)
            # over the seats of the start, which nothing asks for now
            out.append(_kept(sums.groupBy("run").applyInArrow(_summed, _SENT_DDL), f"{self.folder}/seats-0-{turn}"))
        return reduce(DataFrame.unionByName, out)


def _sums(blobs: list[bytes], docs: int) -> list[np.ndarray]:
    """Known tokens, base and own score of a run's documents, from parts that need not reach the last ones."""
    out = [np.zeros(docs, np.int64), np.zeros(docs), np.zeros(docs)]
    for blob in blobs:
        for whole, part in zip(out, unpack(blob), strict=True):
            whole[: len(part)] += part
    return out


def _summed(group: pa.Table) -> pa.Table:
    """The parts of a run as one."""
    blobs = group.column("blob").to_pylist()
    known, base, mine = _sums(blobs, DOCS)
    return _table(_SENT, [(0, _USES, group.column("run")[0].as_py(), pack(known.astype("<u4"), base, mine))])


_RESULT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def score(docs: DataFrame, prior: Prior = Prior(), least_buckets: int = 64, docs_per_bucket: int = 2048, one_in: int = 64, rounds: int = 4, passes: int = 2) -> DataFrame:  # noqa: B008
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` for every row.

    Learned from the rows whose crc32(doc_id as text) mod 10 is not 0 (null id: ''). ``score`` is the sum over tokens
    of log10 of the predictive probability, averaged over sampled seatings; perplexity is 10 to the power
    -score / n_tokens. ``base_score`` is that of add-0.1 word frequencies. Null text: empty, so one token, the end.
    Repeated rows are learned from and scored each. Without training rows both scores are 0. An empty table gives no row.

    All tokens go to the bucket of their context, where those of the training rows are the customers and all are scored.
    Each of ``passes`` reads all texts, so ``docs`` has to give the same rows in the same partitions and order every time, as a table
    in storage does, or an error is raised. Few documents take fewer ``rounds`` and passes. One of ``one_in`` texts is read before to find the words
    before that are too frequent for one bucket.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    count = rows.select("doc_id").count()
    n = max(least_buckets, -(-count // docs_per_bucket))
    rounds = min(rounds, 1 + count // docs_per_bucket)
    frequent = _frequent(rows, n, one_in)
    folder = f"{shared_folder(spark)}/pitmanyor-{uuid.uuid4().hex}"
    passes, filled = min(passes, rounds), []
    for turn in range(passes):
        sent = _sent(rows, n, frequent, turn, passes, rounds).repartition(max(n, partitions(spark)), "bucket")
        filled.append(_kept(sent.groupBy("bucket").applyInArrow(_merge, _SENT_DDL), f"{folder}/model-{turn}"))
    models = [filled[k % passes].where(F.col("bucket") % rounds == k) for k in range(rounds)]
    learned = Learned(models, frequent, n, max(4, n // 4), prior, folder)
    totals = learned.totals

    def finish(group: pa.Table) -> pa.Table:
        kinds, blobs = group.column("kind").to_pylist(), group.column("blob").to_pylist()
        if _DOCS not in kinds:
            raise ValueError("the documents came in another order when they were read again; score a table in storage")
        names, null, held, size = (a.copy() for a in unpack(blobs[kinds.index(_DOCS)]))
        known, base, mine = (x[: len(names)] for x in _sums([b for k, b in zip(kinds, blobs, strict=True) if k == _USES], DOCS))
        every = np.log10(totals.tokens + 0.1 * (totals.words + 1))
        out = [pa.array(names, mask=null), held, size, known, np.full(len(names), totals.tokens), base - size * every, mine]
        return pa.Table.from_batches([batch_of(_RESULT, out)])

    named = reduce(DataFrame.unionByName, [x.where(F.col("kind") == _DOCS) for x in filled])
    met = learned.scores().unionByName(named)
    done = met.groupBy("run").applyInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return _kept(done, f"{folder}/scores")
