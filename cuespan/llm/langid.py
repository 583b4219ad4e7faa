"""Language of a text by rank-order profiles of its most frequent letter n-grams."""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_of, column_of, own_name, remembered, small_batches

BLANK, LETTER = 0x20, 1 << 31
#: N-grams that a profile and a text are ranked by; rows of a task's first cut before a language's profile is chosen.
RANKS, SALTS = 400, 64
#: Profiles go to every task: 10,000 languages of 400 n-grams are 64 MB. More raise an error.
MOST_LANGUAGES = 10_000
_SLICE = 1 << 20

_GRAMS = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])


def _letters() -> np.ndarray:
    """For each code point: its lower case with the letter bit for letters, plain for marks, a blank for all else."""
    table = np.full(0x110000, BLANK, np.uint32)
    for at in range(0x110000):
        c = chr(at)
        kind = unicodedata.category(c)[0]
        if kind in "LM":
            low = c.lower()
            table[at] = (ord(low) if len(low) == 1 else at) | (LETTER if kind == "L" else 0)
    return table


def letters(text: str) -> tuple[np.ndarray, bool]:
    """Lower-case code points of the text's words, one blank before, between and after them, and whether a
    letter is among them. Words are runs of letters and marks."""
    table = remembered("letters", _letters)
    a = table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    some = bool((a >= LETTER).any())
    a = np.concatenate(([BLANK], a & np.uint32(LETTER - 1), [BLANK])).astype(np.uint32)
    keep = np.ones(len(a), bool)
    keep[1:] = (a[1:] != BLANK) | (a[:-1] != BLANK)
    return a[keep], some


def gram_keys(a: np.ndarray) -> Iterator[np.ndarray]:
    """Runs of one to three code points that lie in one padded word, as numbers that order like the strings.
    Long texts come in slices; a run belongs to the slice that it ends in."""
    for lo in range(0, len(a), _SLICE):
        s = a[max(0, lo - 2) : lo + _SLICE].astype(np.int64)
        skip = min(lo, 2)
        one = s[skip:]
        two = s[max(0, skip - 1) :]
        mid = s[1:-1] != BLANK
        yield np.concatenate([
            one[one != BLANK] << 42,
            (two[:-1] << 42) | (two[1:] << 21),
            ((s[:-2] << 42) | (s[1:-1] << 21) | s[2:])[mid] if len(s) > 2 else s[:0],
        ])


def counted(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sum of several counts of keys."""
    if len(parts) == 1:
        return parts[0]
    keys, inv = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(inv, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def ranked(a: np.ndarray, ranks: int) -> np.ndarray:
    """The text's most frequent n-grams; equal counts stand in the order of the n-grams."""
    keys, n = counted([np.unique(k, return_counts=True) for k in gram_keys(a)])
    return keys[np.argsort(-n, kind="stable")[:ranks]]


class Profiles:
    """Ranks of each language's n-grams, kept by n-gram: ``grams`` sorted, each with its languages and ranks."""

    def __init__(self, rows: list[tuple[str, int, int]], ranks: int) -> None:
        self.ranks = ranks
        self.langs = sorted({lang for lang, _, _ in rows})
        at = {lang: i for i, lang in enumerate(self.langs)}
        gram = np.array([g for _, g, _ in rows], np.int64)
        order = np.argsort(gram, kind="stable")
        self.lang = np.array([at[lang] for lang, _, _ in rows], np.int64)[order]
        self.rank = np.array([r for _, _, r in rows], np.int64)[order]
        self.grams, self.start = np.unique(gram[order], return_index=True)
        self.start = np.append(self.start, len(rows))

    def nearest(self, a: np.ndarray) -> tuple[str | None, float]:
        """Language of the least out-of-place distance (ties: the first by name) and 1 - distance / largest distance.
        An n-gram that a profile lacks is ``ranks`` out of place."""
        own = ranked(a, self.ranks)
        if not len(self.langs) or not len(own):
            return None, 0.0
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        i = np.flatnonzero(self.grams[at] == own)
        size = self.start[at[i] + 1] - self.start[at[i]]
        entry = np.repeat(self.start[at[i]] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum()) if len(i) else i
        saved = self.ranks - np.abs(np.repeat(i, size) - self.rank[entry])
        saved = np.bincount(self.lang[entry], saved, len(self.langs)).astype(np.int64)
        best, most = int(np.argmax(saved)), self.ranks * len(own)
        return self.langs[best], 1 - (most - int(saved[best])) / most


def learn(docs: DataFrame, allowed: Column, ranks: int = RANKS) -> Profiles:
    """Profiles of all rows of ``docs`` (``text``, ``lang``) that ``allowed`` lets teach and whose language isn't null.

    Every text is counted whole. Counts are combined in the task, summed by (language, n-gram), and cut to the first
    ``ranks`` twice: in salted parts of a language, then in what they leave. Null and empty texts and texts without
    a letter count nothing; repeated rows count as often as they stand there. An empty table gives no profile.
    """
    spark = docs.sparkSession
    small_batches(spark)
    own = docs.where(allowed & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = defaultdict(list), 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, keys in held.items():
                grams, n = np.unique(np.concatenate(keys), return_counts=True)
                yield batch_of(_GRAMS, [[lang] * len(grams), grams, n.astype(np.int64)])

        for batch in batches:
            for lang, text in zip(column_of(batch, "lang").to_pylist(), column_of(batch, "text").to_pylist(), strict=True):
                for keys in gram_keys(letters(text)[0]):
                    held[lang].append(keys)
                    size += len(keys)
                    if size > 4 * _SLICE:
                        yield from flush()
                        held, size = defaultdict(list), 0
        yield from flush()

    sums = own.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    first = lambda *by: F.row_number().over(Window.partitionBy("lang", *by).orderBy(F.desc("n"), "gram"))
    sums = sums.withColumn("salt", F.pmod(F.xxhash64("gram"), F.lit(SALTS))).withColumn("r", first("salt")).where(F.col("r") <= ranks)
    top = sums.withColumn("r", first()).where(F.col("r") <= ranks).select("lang", "gram", "r")
    rows = top.limit(MOST_LANGUAGES * ranks + 1).collect()
    if len(rows) > MOST_LANGUAGES * ranks:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    return Profiles([(r.lang, r.gram, r.r - 1) for r in rows], ranks)


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1, higher: closer to the profile).

    ``und`` with score 0: null and empty texts, texts without a letter, and every text where nothing was learned.
    All other columns stay, whatever their names; the two new ones replace columns of their names.
    """
    small_batches(docs.sparkSession)

    @F.arrow_udf("struct<lang: string, score: double>")
    def guess(text: pa.Array) -> pa.Array:
        out = []
        for t in text.to_pylist():
            a, some = letters(t or "")
            lang, score = profiles.nearest(a) if some else (None, 0.0)
            out.append({"lang": "und" if lang is None else lang, "score": score})
        return pa.array(out, pa.struct([("lang", pa.string()), ("score", pa.float64())]))

    found = own_name("guess")
    rows = docs.withColumn(found, guess(F.col("text").cast("string")))
    return rows.withColumns({"lang_pred": F.col(f"{found}.lang"), "score": F.col(f"{found}.score")}).drop(found)
