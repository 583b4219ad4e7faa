"""Phrases of two to four words that stand together, by best-first growth of prefixes under score bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_of, column_of, scatter, small_batches, staged, texts_of

#: A-Z to a-z; the marks that end a piece all become a full stop, which is thus never part of a word.
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + b"." * 9)
#: Bits of a filter over hashed words or word pairs: 4 MB. A filter may let more through, never less.
FILTER_BITS = 1 << 25
SALTS = 64
_ROUND = 1_000_000  # tokens that a task counts before it hands counts on

_KEYS = ["lang", "w1", "w2", "w3", "w4"]


# --- words --------------------------------------------------------------------------------------------


class Local(dict):
    """Word bytes to a running number, from 1; 0 is the end of a piece."""

    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self)
        return at


class Held:
    """Texts of a task by language until they are counted: running numbers of their words, pieces kept apart."""

    def __init__(self) -> None:
        self.words = Local()
        self.words[b"."] = 0
        self.ids: dict[str, list[np.ndarray]] = {}
        self.size = 0

    def add(self, lang: str, texts: list[bytes]) -> None:
        got = b" . ".join(texts).translate(_FOLD).replace(b".", b" . ").split()
        got.append(b".")
        ids = np.fromiter(map(self.words.__getitem__, got), np.int64, len(got))
        self.ids.setdefault(lang, [np.zeros(1, np.int64)]).append(ids)
        self.size += len(ids)

    def hashes(self, lang: str, seed: int) -> np.ndarray:
        """One number for each word; 0 only for the end of a piece."""
        out = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) or 1 for w in self.words), np.uint64, len(self.words))
        out[0] = 0
        return out


def _scan(docs: DataFrame, count, out: str) -> DataFrame:  # noqa: ANN001
    """``count(held, lang, ids)`` over all texts, in rounds of about _ROUND tokens of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held()
        for batch in batches:
            langs, texts = column_of(batch, "lang").to_pylist(), texts_of(column_of(batch, "text"))
            by: dict[str, list[bytes]] = {}
            for lang, text in zip(langs, texts, strict=True):
                by.setdefault(lang, []).append(text)
            for lang, mine in by.items():
                lo, size = 0, 0
                for hi, text in enumerate(mine, 1):  # long texts are handed on one by one
                    size += len(text)
                    if size > 4_000_000 or hi == len(mine):
                        held.add(lang, mine[lo:hi])
                        lo, size = hi, 0
                        if held.size > _ROUND:
                            for lang2, ids in held.ids.items():
                                yield from count(held, lang2, np.concatenate(ids))
                            held = Held()
        for lang, ids in held.ids.items():
            yield from count(held, lang, np.concatenate(ids))

    return docs.mapInArrow(run, out)


def word_counts(docs: DataFrame, seed: int) -> DataFrame:
    """``lang``, ``word`` (bytes), ``w`` (its number), ``n`` of every distinct word of a language."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.binary()), ("w", pa.int64()), ("n", pa.int64())])

    def count(held: Held, lang: str, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        n = np.bincount(ids, minlength=len(held.words))
        n[0] = 0
        at = np.flatnonzero(n)
        words = list(held.words)
        yield batch_of(schema, [[lang] * len(at), [words[i] for i in at], held.hashes(lang, seed)[at].view(np.int64), n[at]])

    return _scan(docs, count, "lang string, word binary, w long, n long").groupBy("lang", "word", "w").agg(F.sum("n").alias("n"))


# --- filters ------------------------------------------------------------------------------------------


def mixed(lang: str, *words: np.ndarray) -> np.ndarray:
    """Bit of a filter for each word or word pair of a language."""
    with np.errstate(over="ignore"):
        out = np.full(len(words[0]), xxhash.xxh3_64_intdigest(lang.encode()), np.uint64)
        for w in words:
            out = scatter(out ^ w)
    return (out >> np.uint64(64 - FILTER_BITS.bit_length() + 1)).astype(np.int64)


class Filter:
    """A bit for each number below FILTER_BITS. Spark builds it in parts of 4 KB; the driver and each task hold the whole."""

    def __init__(self, rows: DataFrame, *words: str) -> None:
        @F.arrow_udf("long")
        def bit(lang: pa.Array, *ws: pa.Array) -> pa.Array:
            langs = lang.dictionary_encode()
            own = langs.indices.to_numpy(zero_copy_only=False)
            out = np.zeros(len(lang), np.int64)
            for k, name in enumerate(langs.dictionary.to_pylist()):
                at = np.flatnonzero(own == k)
                out[at] = mixed(name, *[w.to_numpy(zero_copy_only=False)[at].view(np.uint64) for w in ws])
            return pa.array(out)

        at = rows.select((bit("lang", *words) + 1).alias("b"))  # Spark's bitmap parts count from 1
        parts = at.groupBy(F.bitmap_bucket_number("b").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bits")).collect()
        self.bits = np.zeros(FILTER_BITS // 8, np.uint8)
        for r in parts:
            self.bits[(r.part - 1) * 4096 : r.part * 4096] = np.frombuffer(bytes(r.bits), np.uint8)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


# --- counts -------------------------------------------------------------------------------------------


def _rows(lang: str, hashes: np.ndarray, words: list[np.ndarray], n: np.ndarray) -> pa.RecordBatch:
    schema = pa.schema([("lang", pa.string()), *[(f"w{i}", pa.int64()) for i in (1, 2, 3, 4)], ("n", pa.int64())])
    cols = [hashes[w].view(np.int64) for w in words] + [np.zeros(len(n), np.int64)] * (4 - len(words))
    return batch_of(schema, [[lang] * len(n), *cols, n.astype(np.int64)])


_COUNTS = "lang string, w1 long, w2 long, w3 long, w4 long, n long"


def _summed(counts: DataFrame, least: int) -> DataFrame:
    return counts.groupBy(*_KEYS).agg(F.sum("n").alias("a")).where(F.col("a") >= least)


def pair_counts(docs: DataFrame, usual: Filter, seed: int, least: int) -> DataFrame:
    """Word pairs found ``least`` times; only occurrences of two words that may be as frequent are counted."""

    def count(held: Held, lang: str, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        hashes = held.hashes(lang, seed)
        ok = usual[mixed(lang, hashes)]
        ok[0] = False
        good = ok[ids]
        at = np.flatnonzero(good[:-1] & good[1:])
        key, n = np.unique((ids[at] << 31) | ids[at + 1], return_counts=True)
        yield _rows(lang, hashes, [key >> 31, key & ((1 << 31) - 1)], n)

    return _summed(_scan(docs, count, _COUNTS), least)


def longer_counts(docs: DataFrame, pairs: Filter, live: Filter, ends: Filter, seed: int, least: int) -> DataFrame:
    """Phrases of three and four words found ``least`` times, all of whose pairs may be as frequent, and of which
    one pair is live; phrases of three also where a live pair may stand before them (they are its right part)."""

    def count(held: Held, lang: str, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        hashes = held.hashes(lang, seed)
        end = ends[mixed(lang, hashes)]
        at = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
        key, inv = np.unique((ids[at] << 31) | ids[at + 1], return_inverse=True)
        bit = mixed(lang, hashes[key >> 31], hashes[key & ((1 << 31) - 1)])
        two, hot = np.zeros(len(ids), bool), np.zeros(len(ids), bool)
        two[at], hot[at] = pairs[bit][inv], live[bit][inv]
        pair = np.zeros(len(ids), np.int64)
        pair[at] = inv  # a pair's number in this round
        three = np.flatnonzero(two[:-1] & two[1:] & (hot[:-1] | hot[1:] | end[ids[:-1]]))
        tri, at3, n = np.unique((pair[three] << 31) | pair[three + 1], return_index=True, return_counts=True)
        first = three[at3]
        yield _rows(lang, hashes, [ids[first], ids[first + 1], ids[first + 2]], n)
        four = np.flatnonzero(two[:-2] & two[1:-1] & two[2:] & (hot[:-2] | hot[1:-1] | hot[2:]))
        # pairs at 1 and 3 name all four words
        _, at4, n = np.unique((pair[four] << 31) | pair[four + 2], return_index=True, return_counts=True)
        first = four[at4]
        yield _rows(lang, hashes, [ids[first + k] for k in range(4)], n)

    return _summed(_scan(docs, count, _COUNTS), least)


# --- scores -------------------------------------------------------------------------------------------


def _score(a: Column, both: Column) -> Column:
    """floor(2000000 a / both), exact: products pass 64 bits."""
    return F.call_function("div", F.lit(2_000_000).cast("decimal(7,0)") * a.cast("decimal(19,0)"), both.cast("decimal(20,0)"))


def _scored(pairs: DataFrame, longer: DataFrame, words: DataFrame, tau: DataFrame) -> DataFrame:
    """Candidates that reach their language's ``tau``, with ``l``, ``r`` and ``score`` of their lowest cut."""
    zero = F.lit(0).cast("long")
    known = words.select("lang", F.col("w").alias("w1"), zero.alias("w2"), zero.alias("w3"), zero.alias("w4"), F.col("n").alias("a"))
    known = known.unionByName(pairs.select(*_KEYS, "a")).unionByName(longer.select(*_KEYS, "a"))
    w = [F.col(f"w{i}") for i in (1, 2, 3, 4)]
    length = F.when(w[2] == 0, 2).when(w[3] == 0, 3).otherwise(4)
    some = pairs.select(*_KEYS, "a").unionByName(longer.select(*_KEYS, "a")).withColumn("len", length)
    cut = lambda k: F.struct(F.lit(k).alias("k"), *[(w[i] if i < k else zero).alias(f"p{i + 1}") for i in range(4)], *[(w[i + k] if i + k < 4 else zero).alias(f"q{i + 1}") for i in range(4)])
    cuts = some.withColumn("cut", F.explode(F.slice(F.array(cut(1), cut(2), cut(3)), F.lit(1), F.col("len") - 1)))
    left = known.select("lang", *[F.col(f"w{i}").alias(f"p{i}") for i in (1, 2, 3, 4)], F.col("a").alias("l"))
    right = known.select("lang", *[F.col(f"w{i}").alias(f"q{i}") for i in (1, 2, 3, 4)], F.col("a").alias("r"))
    flat = cuts.select(*_KEYS, "a", "len", "cut.*")
    # a part that wasn't counted belongs to a phrase whose first pair can't reach tau
    met = flat.join(left, ["lang", "p1", "p2", "p3", "p4"]).join(right, ["lang", "q1", "q2", "q3", "q4"])
    each = F.struct(_score(F.col("a"), F.col("l") + F.col("r")).alias("score"), "k", "l", "r")
    best = met.groupBy(*_KEYS, "a", "len").agg(F.min(each).alias("m"), F.count(F.lit(1)).alias("cuts"))
    best = best.where("cuts = len - 1").select(*_KEYS, "a", "len", "m.l", "m.r", "m.score")
    return best.join(F.broadcast(tau), "lang").where("score >= tau")  # a row a language


def _survivors(scored: DataFrame, longer: DataFrame) -> DataFrame:
    """Candidates that no longer phrase of at least four fifths of their count holds."""
    zero = F.lit(0).cast("long")
    w = [F.col(f"w{i}") for i in (1, 2, 3, 4)]
    part = lambda lo, n: F.struct(*[(w[lo + i] if i < n else zero).alias(f"w{i + 1}") for i in range(4)])
    parts = F.when(w[3] == 0, F.array(part(0, 2), part(1, 2))).otherwise(F.array(part(0, 2), part(1, 2), part(2, 2), part(0, 3), part(1, 3)))
    inside = longer.select("lang", "a", F.explode(parts).alias("p")).groupBy("lang", "p.w1", "p.w2", "p.w3", "p.w4").agg(F.max("a").alias("most"))
    return scored.join(inside, _KEYS, "left").where(F.col("most").isNull() | (F.col("most").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * 80)).drop("most")


def collocations(docs: DataFrame, top: int = 2000, least: int = 30, slack: int = 4, seed: int = 0) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``: each language's first ``top`` phrases.

    Words and pairs are counted first. A pair with count p after a word with count l can start no phrase of a
    score above 2000000 p / (l + p): a phrase is found at most p times, and the cut after its first word leaves parts
    found l times and as often as the phrase at least. Pairs are a frontier, ordered by that bound. The best are grown
    first: those whose bound reaches ``tau``, the score that ``slack`` x ``top`` pairs of the language reach. Phrases around
    them are counted whole, with all that can be a part of them or hold them. If ``top`` candidates at or above tau survive,
    nothing behind can be among the first (ties included); else the language's tau falls, its frontier is grown further, and so on until all is grown.

    Null texts are empty, null languages are ``und``. Repeated rows count each time. A language without a surviving
    candidate, and an empty table, give no row. Extra columns aren't read. Words are told apart by a 64-bit hash, tested for
    collisions with frequent words; with one, all starts anew under another seed.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    every = staged(word_counts(rows, seed), "words")
    clash = every.groupBy("lang", "w").agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("n")).where((F.col("k") > 1) & (F.col("n") >= least))
    if not clash.isEmpty():
        return collocations(docs, top, least, slack, seed + 1)
    total = every.groupBy("lang").agg(F.sum("n").alias("n"))
    words = every.where(F.col("n") >= least)
    counted = staged(pair_counts(rows, Filter(words, "w"), seed, least), "pairs")
    of = words.select("lang", F.col("w").alias("w1"), F.col("n").alias("l")), words.select("lang", F.col("w").alias("w2"), F.col("n").alias("r"))
    # a word that passed the filter by chance has no count here, and its pairs none of use
    pairs = counted.join(of[0], ["lang", "w1"]).join(of[1], ["lang", "w2"])
    pairs = pairs.withColumns({"score": _score(F.col("a"), F.col("l") + F.col("r")), "bound": _score(F.col("a"), F.col("l") + F.col("a"))})
    pairs = staged(pairs.select(*_KEYS, "a", "score", "bound"), "scored-pairs")
    usual = Filter(pairs, "w1", "w2")

    # scores by thousands: at most 1,001 rows a language
    steps: dict[str, list[tuple[int, int]]] = {}
    for r in pairs.groupBy("lang", F.expr("score div 1000").alias("step")).agg(F.count(F.lit(1)).alias("k")).collect():
        steps.setdefault(r.lang, []).append((r.step, r.k))

    def reach(lang: str, want: int) -> int:
        """Largest multiple of 1,000 that ``want`` pairs reach; 0 without so many."""
        sum_ = 0
        for step, k in sorted(steps[lang], reverse=True):
            sum_ += k
            if sum_ >= want:
                return step * 1000
        return 0

    done, open_ = [], sorted(steps)
    while open_:
        tau_of = {lang: reach(lang, slack * top) for lang in open_}
        tau = spark.createDataFrame(list(tau_of.items()), "lang string, tau long")
        mine = pairs.join(F.broadcast(tau), "lang")
        live = mine.where("bound >= tau")
        longer = staged(longer_counts(rows.join(F.broadcast(tau.select("lang")), "lang", "left_semi"), usual, Filter(live, "w1", "w2"), Filter(live, "w2"), seed, least), "longer")
        found = staged(_survivors(_scored(mine.select(*_KEYS, "a"), longer, words, tau), longer), "survivors")
        have = {r.lang: r.k for r in found.groupBy("lang").agg(F.count(F.lit(1)).alias("k")).collect()}
        settled = [lang for lang in open_ if have.get(lang, 0) >= top or not tau_of[lang]]
        done.append(found.where(F.col("lang").isin(settled)))
        open_ = [lang for lang in open_ if lang not in settled]
        slack *= 8
    if not done:
        return spark.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    found = done[0]
    for more in done[1:]:
        found = found.union(more)
    # what can't be among the first by score and count needs no text
    by = [F.desc("score"), F.desc("a")]
    salted = Window.partitionBy("lang", "salt").orderBy(*by)
    found = found.withColumn("salt", F.pmod(F.xxhash64("w1", "w2", "w3", "w4"), F.lit(SALTS))).withColumn("place", F.rank().over(salted)).where(F.col("place") <= top)
    for i in (1, 2, 3, 4):
        found = found.join(words.select("lang", F.col("w").alias(f"w{i}"), F.decode("word", "UTF-8").alias(f"t{i}")), ["lang", f"w{i}"], "left")
    named = found.withColumn("phrase", F.concat_ws(" ", "t1", "t2", "t3", "t4"))
    for part in (["lang", "salt"], ["lang"]):
        named = named.withColumn("rank", F.row_number().over(Window.partitionBy(*part).orderBy(*by, "phrase"))).where(F.col("rank") <= top)
    return named.join(F.broadcast(total), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
