"""Quality rules whose cutoffs follow quantile sketches of each language and source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, batch_of, column_of, own_name, remembered, rolling, small_batches, staged, texts_of

#: Sketch resolution: a value's bucket bounds it within half a percent of itself.
GAMMA = 1.005

#: Measures, with the least spread that a group's middle half is taken to have: where its quartiles coincide, noise is no outlier.
GUARDS = {"symbol_share": 0.0125, "dup_line_share": 0.05, "repeat_share": 0.034, "mean_word_chars": 0.05}

_STATS = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"
_ARROW = pa.struct([(x.split()[0], pa.int64()) for x in _STATS.split(", ")])


def repeated_words(h: np.ndarray, width: int = 8) -> int:
    """Words in a window of ``width`` words that the text has twice or more, first one included."""
    w = rolling(h, width)
    if len(w) < 2:
        return 0
    s = np.sort(w)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(w, twice))
    edge = np.zeros(len(h) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def text_counts(text: bytes, hashes: WordHashes) -> tuple[int, ...]:
    words = text.split()
    inside = b"".join(words)
    chars = len(inside) if inside.isascii() else len(inside.decode())
    symbols = len(inside) - len(inside.translate(None, b"#*$%&|<>"))
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(words), chars, symbols, len(lines), len(lines) - len(set(lines)), repeated_words(hashes.array(words))


def _hashes() -> WordHashes:
    return remembered("word hashes", WordHashes)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _hashes()
    for batch in batches:
        rows = [text_counts(t, hashes) for t in texts_of(column_of(batch, "text"))]
        extra = batch.schema.get_field_index("text")
        keep = [(f, c) for i, (f, c) in enumerate(zip(batch.schema, batch.columns, strict=True)) if i != extra]
        own = list(zip(*rows, strict=True)) if rows else [[]] * len(_ARROW)
        schema = pa.schema([f for f, _ in keep] + [_ARROW.field(i) for i in range(len(_ARROW))])
        yield batch_of(schema, [c for _, c in keep] + [pa.array(c, pa.int64()) for c in own])


def _structs(text: pa.Array) -> pa.Array:
    hashes = _hashes()
    rows = [text_counts(t, hashes) for t in texts_of(text)]
    return pa.array([dict(zip(_ARROW.names, r, strict=True)) for r in rows], _ARROW)


def counts_of(text: Column) -> Column:
    """The counts as a struct column, where a row must keep its other columns. Texts are counted once: a deterministic function
    would be evaluated again for each filter that Spark moves below a join."""
    return F.arrow_udf(_structs, _STATS).asNondeterministic()(text)


def text_stats(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``lang``, ``source`` and the counts of every whole text."""
    small_batches(docs.sparkSession)
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return kept.mapInArrow(_counts, "doc_id long, lang string, source string, " + _STATS)


def measures(get) -> dict[str, Column]:  # noqa: ANN001
    """Ratios of the counts; ``get`` gives a count's column."""
    words, lines = F.greatest(get("n_words"), F.lit(1)), F.greatest(get("n_lines"), F.lit(1))
    return {
        "symbol_share": get("n_symbols") / words,
        "dup_line_share": get("n_dup_lines") / lines,
        "repeat_share": get("n_repeat_words") / words,
        "mean_word_chars": get("word_chars") / words,
    }


def base_failed(get) -> Column:  # noqa: ANN001
    return (get("n_words") < 20) | (100 * get("n_repeat_words") > 30 * get("n_words"))


def sketch(stats: DataFrame, keys: list[str]) -> DataFrame:
    """Mergeable sketch of every measure: ``keys``, ``measure``, ``bucket``, ``n``.

    Buckets grow by GAMMA; counts of equal buckets add up, so sketches of parts merge exactly, in any
    order, and the result is the same on every run. A hot source costs each task a few hundred rows.
    """
    long = stats.select(*keys, F.explode(F.create_map(*[x for k, v in measures(F.col).items() for x in (F.lit(k), v.cast("double"))])).alias("measure", "value"))
    bucket = F.when(F.col("value") <= 1e-6, F.lit(None).cast("int")).otherwise(F.ceil(F.log(F.col("value")) / float(np.log(GAMMA))).cast("int"))
    return long.groupBy(*keys, "measure", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    return sketches.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, keys: list[str], shares: tuple[float, ...]) -> DataFrame:
    """Columns q0, q1, ... of each key and measure, and ``n``. A sketch has a few thousand buckets at most,
    so its window is small whatever the number of rows behind it."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys, "measure")
    value = F.coalesce(F.pow(F.lit(GAMMA), F.col("bucket")), F.lit(0.0))
    run = sketches.select(*keys, "measure", value.alias("value"), "n", F.sum("n").over(w.orderBy(F.col("bucket").asc_nulls_first())).alias("upto"), F.sum("n").over(w).alias("total"))
    return run.groupBy(*keys, "measure").agg(F.max("total").alias("n"), *[F.min(F.when(F.col("upto") >= s * F.col("total"), F.col("value"))).alias(f"q{i}") for i, s in enumerate(shares)])


def cutoffs(sketches: DataFrame, least_rows: int = 200, reach: float = 8.0) -> DataFrame:
    """``lang``, ``source`` and a lower and an upper cutoff per measure (``min_*``, ``max_*``).

    Cutoffs: ``reach`` times the quartile distance outside the quartiles; a distance below the measure's guard counts as the guard.
    Groups of under ``least_rows`` documents take the cutoffs of their language, languages that small those of the
    whole corpus: both from merged sketches of the groups.
    """
    guard = F.create_map(*[x for k, v in GUARDS.items() for x in (F.lit(k), F.lit(v))])[F.col("measure")]

    def fences(keys: list[str], name: str) -> DataFrame:
        q = quantiles(merge(sketches, keys), keys, (0.25, 0.75))
        spread = reach * F.greatest(F.col("q1") - F.col("q0"), guard)
        both = F.struct((F.col("q0") - spread).alias("low"), (F.col("q1") + spread).alias("high"))
        return q.select(*keys, "measure", F.when(F.col("n") >= least_rows, both).alias(name) if keys else both.alias(name))

    own = fences(["lang", "source"], "own").withColumn("l", F.coalesce("lang", F.lit("\0")))
    lang = fences(["lang"], "of_lang").withColumn("l", F.coalesce("lang", F.lit("\0"))).drop("lang")
    joined = own.join(lang, ["l", "measure"], "left").join(fences([], "of_all"), "measure", "left")
    cut = F.coalesce("own", "of_lang", "of_all")
    each = [F.max(F.when(F.col("measure") == m, cut[end])).alias(f"{name}_{m}") for m in GUARDS for name, end in (("min", "low"), ("max", "high"))]
    return joined.groupBy("lang", "source").agg(*each)


def _within(get, tag: str) -> Column:  # noqa: ANN001
    """Every measure lies between its cutoffs; a bucket's width counts as equal."""
    ok = F.lit(True)
    for k, v in measures(get).items():
        ok = ok & (v <= F.col(f"{tag}max_{k}") * GAMMA) & (v * GAMMA >= F.col(f"{tag}min_{k}"))
    return ok


def _with_cutoffs(rows: DataFrame, cuts: DataFrame) -> tuple[DataFrame, str]:
    """Rows with the cutoffs of their group, in columns whose names start with the second value."""
    tag = own_name("cut")
    cuts = cuts.select(*[F.col(c).alias(tag + c) for c in cuts.columns])
    return rows.join(cuts, rows["lang"].eqNullSafe(F.col(f"{tag}lang")) & rows["source"].eqNullSafe(F.col(f"{tag}source")), "left"), tag


def judge(stats: DataFrame, least_rows: int = 200, reach: float = 8.0) -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` for every row of ``text_stats``.

    A text without words fails the base. Null language or source is a group of its own. Repeated rows
    count and are judged each. An empty table gives no row.
    """
    cuts = staged(cutoffs(sketch(stats, ["lang", "source"]), least_rows, reach), "cutoffs")
    failed = base_failed(F.col)
    rows, tag = _with_cutoffs(stats, cuts)
    return rows.select(*stats.columns, failed.alias("base_failed"), (~failed & _within(F.col, tag)).alias("kept"))


def keep_good(docs: DataFrame, least_rows: int = 200, reach: float = 8.0) -> DataFrame:
    """The documents that ``judge`` keeps, with the columns they came with, whatever their names.

    Null and empty texts fail the base; a very long text is read whole; ties with a cutoff stay; repeated rows stay or go together.
    """
    # written out, so that its size is known: small tables are broadcast, and texts then aren't shuffled
    cuts = staged(cutoffs(sketch(text_stats(docs), ["lang", "source"]), least_rows, reach), "cutoffs")
    counts = own_name("counts")
    rows, tag = _with_cutoffs(docs.withColumn(counts, counts_of(F.col("text").cast("string"))), cuts)
    get = lambda k: F.col(f"{counts}.{k}")
    return rows.where(~base_failed(get) & _within(get, tag)).select(*docs.columns)
