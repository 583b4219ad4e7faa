"""Factorisation machines over hashed words, word beginnings, structure statistics and metadata."""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_of, column_of, remembered, small_batches, texts_of

#: Structure statistics are cut into steps; each step is a feature of its own.
_SHARE = np.array([0, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])
_SIZE = np.array([1, 2, 3, 4, 5, 6, 8, 10, 15, 20, 50, 100, 300, 1000, 3000, 10000, 30000, 100000])
STRUCTURE = ("symbols", "capitals", "digits", "repeated_lines", "distinct_words", "same_as_before", "word_chars", "line_words", "words")

_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


@dataclass(frozen=True)
class Features:
    """What a text's features are. ``buckets``: of hashed terms; ``prefixes``: lengths in bytes of word beginnings."""

    buckets: int = 1 << 22
    words: bool = True
    prefixes: tuple[int, ...] = (4, 5, 6)
    structure: bool = True
    metadata: tuple[str, ...] = ()

    @property
    def width(self) -> int:
        return self.buckets + 32 * (len(STRUCTURE) + len(self.metadata))


class TermIds(dict):
    """A word's ids: its own and those of its beginnings, remembered; forgets all beyond ``limit`` words."""

    def __init__(self, spec: Features, limit: int = 300_000) -> None:
        super().__init__()
        self.spec, self.limit = spec, limit

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= self.limit:
            self.clear()
        w, n = word.lower().strip(_PUNCTUATION), self.spec.buckets
        out: tuple[int, ...] = ()
        if w and self.spec.words:
            out = (xxhash.xxh3_64_intdigest(w) % n,)
        out += tuple(xxhash.xxh3_64_intdigest(w[:p], p) % n for p in self.spec.prefixes if len(w) >= p)
        self[word] = out
        return out


def term_ids(spec: Features) -> TermIds:
    return remembered(("terms", spec), lambda: TermIds(spec))


def _structure(text: bytes, words: list[bytes], distinct: set[bytes]) -> list[float]:
    n, inside = max(1, len(words)), b"".join(words)
    size = max(1, len(inside))
    symbols = len(inside) - len(inside.translate(None, b"#*$%&|<>"))
    capitals = len(inside) - len(inside.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = len(inside) - len(inside.translate(None, b"0123456789"))
    lines = [x for x in text.split(b"\n") if x.strip()]
    m = max(1, len(lines))
    again = sum(map(operator.eq, words, words[1:]))
    return [symbols / n, capitals / size, digits / size, 1 - len(set(lines)) / m, len(distinct) / n, again / n, size / n, len(words) / m, len(words)]


def featurize(text: bytes, meta: tuple, spec: Features) -> np.ndarray:
    """Sorted distinct feature ids of a whole text. A null metadatum has a step of its own."""
    words = text.split()
    distinct = set(words)
    known = term_ids(spec)
    ids = {i for w in distinct for i in known[w]}
    steps = []
    if spec.structure:
        for k, v in enumerate(_structure(text, words, distinct)):
            steps.append(32 * k + int(np.searchsorted(_SHARE if k < 6 else _SIZE, v, "right")))
    for k, v in enumerate(meta):
        at = 31 if v is None or v != v else int(np.searchsorted(_SIZE, float(v), "right"))
        steps.append(32 * (len(STRUCTURE) + k) + at)
    ids.update(spec.buckets + s for s in steps)
    return np.array(sorted(ids), np.int32)


@dataclass
class Machine:
    """score = sigmoid(bias + sum w_i + sum over pairs <v_i, v_j>) over the features that a text has.

    ``ids`` are the kept features, sorted; all others weigh nothing.
    """

    spec: Features
    ids: np.ndarray
    w: np.ndarray
    v: np.ndarray
    bias: float

    def score(self, features: np.ndarray) -> float:
        at = np.searchsorted(self.ids, features)
        at[at == len(self.ids)] = 0
        at = at[self.ids[at] == features] if len(self.ids) else at[:0]
        v = self.v[at]
        pairs = 0.5 * float((v.sum(0) ** 2 - (v**2).sum(0)).sum())
        return float(1 / (1 + np.exp(-np.clip(self.bias + float(self.w[at].sum()) + pairs, -35, 35))))


def _beyond(now: np.ndarray, gradient: np.ndarray, step: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """``now`` after a step, drawn back to 0 by ``chance``."""
    to = now - step * gradient
    return np.sign(to) * np.maximum(0, np.abs(to) - step * chance)


def fit(rows: list[np.ndarray], labels: np.ndarray, spec: Features, rank: int = 4, epochs: int = 40, rate: float = 0.05, decay: float = 2e-4, least_z: float = 0.0, least_docs: int = 3, least_lift: float = 1.0, shrink: float = 4.0, balance: float = 0.5, seed: int = 7) -> Machine:
    """Fit on a bounded sample by mini-batch AdaGrad on the log loss. ``balance`` 0 weighs rows
    alike, 1 classes.

    Terms that fewer than ``least_docs`` texts have are left out, and on demand those whose shares in the
    classes differ by under ``least_z`` standard errors or a factor under ``least_lift``. All others have a
    weight and factors, which leave their start only by what their gradients have beyond ``shrink`` times
    what chance gives them; a weight with evidence of its own is shrunk by less. Without both classes the
    score is the label's mean, without rows 0.5.
    """
    n = len(rows)
    y = np.asarray(labels, float)
    none = np.zeros(0, np.int32)
    if not n or y.min() == y.max():
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3) if n else 0.5
        return Machine(spec, none, np.zeros(0), np.zeros((0, rank)), float(np.log(p / (1 - p))))
    flat, lengths = np.concatenate(rows), np.array([len(r) for r in rows])
    of = np.repeat(np.arange(n, dtype=np.int32), lengths)
    ids, inv = np.unique(flat, return_inverse=True)
    inv = inv.astype(np.int32)
    del flat
    n1, n0 = y.sum(), n - y.sum()
    a = np.bincount(inv, y[of], len(ids))
    df = np.bincount(inv, minlength=len(ids))
    b = df - a
    p = (df + 1) / (n + 2)
    z = np.abs(a / n1 - b / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
    lift = np.abs(np.log((a + 0.5) / (n1 + 1)) - np.log((b + 0.5) / (n0 + 1)))
    take = (df >= least_docs) & ((ids >= spec.buckets) | (z >= least_z) & (lift >= np.log(least_lift)))
    ids, place = ids[take], (np.cumsum(take) - 1).astype(np.int32)
    ok = take[inv]
    col, row = place[inv[ok]], of[ok]
    del inv, of, ok
    starts = np.searchsorted(row, np.arange(n + 1))
    rng = np.random.default_rng(seed)
    z = z[take]
    # in long texts factors start smaller, those of neutral terms most: else their pairs drown all others
    first = 0.02 * np.minimum(1, np.maximum(1, z / 3) * np.sqrt(3 * n / max(1, len(col))))
    start = rng.normal(0, first[:, None], (len(ids), rank))
    w, v, bias = np.zeros(len(ids)), start.copy(), 0.0
    gw, gv, gb = np.full(len(ids), 1e-3), np.full((len(ids), rank), 1e-3), 1e-3
    weight = np.where(y > 0, 0.5 * n / n1, 0.5 * n / n0) ** balance
    # what chance adds to a feature's gradient in an epoch, dealt over the batches that have the feature
    batches = -(-n // 256)
    chance = shrink * np.sqrt(df[take] * np.mean((weight * (y - y.mean())) ** 2)) / 256
    chance /= np.maximum(1, batches * (1 - (1 - 1 / batches) ** df[take]))
    chance_w = chance * np.minimum(1, (shrink / np.maximum(z, 1e-9)) ** 2)
    for _ in range(max(epochs, -(-400 // batches))):  # few rows make few batches
        order = rng.permutation(n)
        for k in range(0, n, 256):
            part = order[k : k + 256]
            sizes = starts[part + 1] - starts[part]
            if not len(part):
                continue
            at = np.repeat(starts[part] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
            c, r = col[at], np.repeat(np.arange(len(part)), sizes)
            vc = v[c]
            total = np.stack([np.bincount(r, vc[:, f], len(part)) for f in range(rank)], 1)
            squares = np.bincount(r, (vc**2).sum(1), len(part))
            s = bias + np.bincount(r, w[c], len(part)) + 0.5 * ((total**2).sum(1) - squares)
            err = (1 / (1 + np.exp(-np.clip(s, -35, 35))) - y[part]) * weight[part] / len(part)
            used = np.flatnonzero(np.bincount(c, minlength=len(ids)))
            dw = np.bincount(c, err[r], len(ids))[used] + decay * w[used] / 10
            each = err[r][:, None] * (total[r] - vc)
            dv = np.stack([np.bincount(c, each[:, f], len(ids))[used] for f in range(rank)], 1) + decay * v[used]
            gw[used] += dw**2
            gv[used] += dv**2
            gb += err.sum() ** 2
            w[used] = _beyond(w[used], dw, 4 * rate / np.sqrt(gw[used]), chance_w[used])
            v[used] = start[used] + _beyond(v[used] - start[used], dv, rate / np.sqrt(gv[used]), 2 * chance[used, None] * np.sqrt((total**2).mean(0)))
            bias -= rate * err.sum() / np.sqrt(gb)
    return Machine(spec, ids, w, v, bias)


def learn(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, spec: Features, most_rows: int = 12_000, **how) -> Machine:  # noqa: ANN003
    """Fit on at most ``most_rows`` labelled rows, the first in the order of a hash of id and text.

    ``allowed``: which rows of ``docs`` may be learned from. Rows with a null label, and ids with labels
    that differ, teach nothing; equal ones count once, and so does an id that ``docs`` repeats. The sample is the only thing that is collected,
    as feature ids, of which a text has no more than the machine has buckets.
    """
    small_batches(docs.sparkSession)
    marks = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(label).alias("__y"), F.max(label).alias("__y2")).where("__y = __y2 and __y in (0, 1)")
    marks = marks.select(F.col("doc_id").alias("__id"), "__y")
    own = docs.where(allowed).select(F.col("doc_id").alias("__id"), F.col("text").cast("string").alias("text"), *[F.col(m).cast("double").alias(m) for m in spec.metadata])
    order = F.xxhash64("__id")
    # the order needs ids only: texts are fetched for the chosen ones
    chosen = own.select("__id").join(marks, "__id").select("__id", "__y", order.alias("__o")).dropDuplicates(["__id"]).orderBy("__o", "__id").limit(most_rows)
    kept = chosen.select("__id", "__y")
    rows = own.join(F.broadcast(kept), "__id")  # at most most_rows ids: a bound whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("y", pa.int32()), ("ids", pa.binary()), ("o", pa.int64())])
        for batch in batches:
            meta = zip(*[column_of(batch, m).to_pylist() for m in spec.metadata], strict=True) if spec.metadata else iter(lambda: (), None)
            texts = texts_of(column_of(batch, "text"))
            ids = [featurize(t, m, spec).tobytes() for t, m in zip(texts, meta, strict=False)]
            yield batch_of(schema, [column_of(batch, "__y").cast(pa.int32()), ids, column_of(batch, "__id").cast(pa.int64())])

    found = rows.select("__id", "__y", "text", *spec.metadata).mapInArrow(run, "y int, ids binary, o long")
    # one row of each id, however often the table repeats it
    got = [r.m for r in found.groupBy("o").agg(F.min(F.struct("ids", "y", "o")).alias("m")).collect()]
    got.sort(key=lambda r: r.o)
    return fit([np.frombuffer(bytes(r.ids), np.int32) for r in got], np.array([r.y for r in got]), spec, **how)


def scored(docs: DataFrame, machine: Machine, threshold: float) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 at ``threshold`` or more).

    Each text is read whole; null and empty texts are scored by what features they have. The machine
    goes out with the task code: its size is bounded by the feature buckets. Extra columns stay; the
    two new ones replace columns of their names.
    """
    spec = machine.spec
    small_batches(docs.sparkSession)

    @F.arrow_udf("double")
    def score(text: pa.Array, *meta: pa.Array) -> pa.Array:
        columns = [m.to_pylist() for m in meta]
        return pa.array([machine.score(featurize(t, tuple(c[i] for c in columns), spec)) for i, t in enumerate(texts_of(text))], pa.float64())

    out = docs.withColumn("score", score(F.col("text").cast("string"), *[F.col(m).cast("double") for m in spec.metadata]))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


#: The quality machine sees words, structure and the recorded length, the toxicity machine only terms.
QUALITY = Features(buckets=1 << 22, prefixes=(), metadata=("n_chars",))
TOXICITY = Features(buckets=1 << 22, structure=False)
