"""Transcripts: recognised text with per-character times cut into timed sentences."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuespan import constants as K
from cuespan.functions.fuzzy import bound
from cuespan.operators.ordered import lane, scan
from cuespan.session import stored

_ENDS = "[" + K.SENTENCE_ENDS + "]"
_SENTENCE = f"([^{K.SENTENCE_ENDS}]*{_ENDS}|[^{K.SENTENCE_ENDS}]+)"
_SOUNDLESS = r"[^\p{L}\p{N}]"


def _sounds(piece: Column) -> Column:
    return F.length(F.regexp_replace(piece, _SOUNDLESS, "")).cast("long")


def split_sentences(docs: DataFrame, keys: tuple[str, ...], text: str = "text") -> DataFrame:
    """Pieces of the text up to and including each sentence end, with their place ``pos``."""
    rest = [c for c in docs.columns if c != text]
    pieces = F.regexp_extract_all(F.col(text), F.lit(_SENTENCE), 1)
    return docs.select(*rest, F.posexplode(pieces).alias("pos", "piece"))


def timed_sentences(docs: DataFrame, keys: tuple[str, ...] = ("session", "src")) -> DataFrame:
    """Sentences (keys, id, start, end, text) from text and ``stamps`` array<array<ms>>.

    Letters and digits take the next stamp each, other characters none. A sentence runs from its
    first to its last stamped character; without any it is dropped. A text none of whose sentences
    got a time is one sentence over all stamps.

    A text has its stamps in its own row, so its sentences are timed there and no stamp is shuffled. Texts that
    share their keys count on through each other's characters; only those are joined with stamps.
    """
    named = reduce(and_, [F.col(k).isNotNull() for k in keys])
    shared = stored(docs.where(named).groupBy(*keys).agg(F.count("*").alias("__n")).where("__n > 1").select(*keys))
    alone = docs.join(shared, list(keys), "left_anti")
    own = alone.select(*keys, F.inline(_own_sentences(named)))
    return own.unionByName(_shared_sentences(docs.join(shared, list(keys), "left_semi"), keys))


def _seconds(stamp: Column, place: int) -> Column:
    return F.get(stamp, F.lit(place)) / 1000.0


def _whole(text: Column, stamps: Column) -> Column:
    return F.struct(
        F.lit(0).alias("id"), _seconds(F.get(stamps, F.lit(0)), 0).alias("start"),
        _seconds(F.element_at(stamps, -1), 1).alias("end"), F.btrim(text).alias("text"),
    )


def _own_sentences(named: Column) -> Column:
    """Sentences of the row's text over the row's stamps; a row without all of its keys is one sentence."""

    def of(v: Column) -> Column:
        pieces = F.when(named, F.regexp_extract_all(v["text"], F.lit(_SENTENCE), 1))
        counted = F.transform(pieces, lambda p: F.struct(p.alias("piece"), _sounds(p).alias("k")))
        timed = bound(counted, lambda c: bound(_upto(c), lambda upto: F.filter(
            F.transform(c, lambda x, i: _timed(v["stamps"], i, x, F.get(upto, i))), lambda s: s.isNotNull())))
        lone = F.when((F.size(v["stamps"]) > 0) & (F.btrim(v["text"]) != ""), F.array(_whole(v["text"], v["stamps"])))
        return bound(timed, lambda t: F.when(F.size(t) > 0, t).otherwise(lone))

    return bound(F.struct("text", "stamps"), of)


def _timed(stamps: Column, pos: Column, piece: Column, upto: Column) -> Column:
    first, final = upto - piece["k"], F.least(upto, F.size(stamps).cast("long")) - 1
    good = (piece["k"] > 0) & (first < F.size(stamps)) & (F.btrim(piece["piece"]) != "")
    return F.when(good, F.struct(
        pos.alias("id"), _seconds(F.get(stamps, first.cast("int")), 0).alias("start"),
        _seconds(F.get(stamps, final.cast("int")), 1).alias("end"), F.btrim(piece["piece"]).alias("text"),
    ))


def _upto(counted: Column, run: int = 64) -> Column:
    """Running sums of ``k``: sums of the runs before, and of the run's own up to the entry."""
    zero = F.lit(0).cast("long")

    def sum_of(start: Column, length: Column) -> Column:
        return F.aggregate(F.slice(counted, start, length), zero, lambda a, x: a + x["k"])

    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(counted) - 1) / run).cast("int")), lambda r: sum_of(r * run + 1, F.lit(run)))
    none = F.array(zero)
    before = F.aggregate(runs, none, lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    sums = bound(before, lambda b: F.transform(
        counted, lambda _, i: F.get(b, F.floor(i / run).cast("int")) + sum_of(i - i % run + 1, i % run + 1)))
    return F.when(F.size(counted) > 0, sums)


def _shared_sentences(docs: DataFrame, keys: tuple[str, ...], block: int = 256) -> DataFrame:
    """Sentences of texts that may share their keys. Stamps meet their sentence in blocks, by the number of the block."""
    rows = split_sentences(docs.select(*keys, F.size("stamps").alias("__n"), "text"), keys)
    rows = scan(rows.withColumn("__k", _sounds(F.col("piece"))), lane(keys, ("pos",), 4096.0), running={"upto": F.col("__k")})
    n = F.col("__n").cast("long")
    rows = rows.withColumn("first", F.col("upto") - F.col("__k")).withColumn(
        "final", F.least(F.col("upto"), n) - 1
    ).where((F.col("__k") > 0) & (F.col("first") < n) & (F.btrim("piece") != ""))
    cut = lambda s, b: F.slice(s, b * block + 1, F.lit(block))
    blocks = docs.where(F.size("stamps") > 0).select(*keys, F.inline(bound(F.col("stamps"), lambda s: F.transform(
        F.sequence(F.lit(0), F.floor((F.size(s) - 1) / block).cast("int")),
        lambda b: F.struct(
            b.cast("long").alias("block"), F.transform(cut(s, b), lambda x: F.get(x, F.lit(0))).alias("opening"),
            F.transform(cut(s, b), lambda x: F.get(x, F.lit(1))).alias("closing"),
        ),
    ))))

    def met(sents: DataFrame, at: str, side: str) -> DataFrame:
        place = (F.col(at) % block).cast("int")
        found = sents.withColumn("block", F.floor(F.col(at) / block)).join(blocks.select(*keys, "block", side), [*keys, "block"])
        return found.where(place < F.size(side)).withColumn(side, F.get(side, place)).drop("block")

    sents = met(met(rows, "first", "opening"), "final", "closing").select(
        *keys, F.col("pos").alias("id"), (F.col("opening") / 1000.0).alias("start"),
        (F.col("closing") / 1000.0).alias("end"), F.btrim("piece").alias("text"),
    )
    whole = (
        docs.where((F.size("stamps") > 0) & (F.btrim("text") != ""))
        .join(sents.select(*keys).distinct(), list(keys), "left_anti")
        .select(*keys, F.inline(F.array(_whole(F.col("text"), F.col("stamps")))))
    )
    return sents.unionByName(whole)


def prefer_labelled(raw: DataFrame, labelled: DataFrame) -> DataFrame:
    """Host sentences of the labelled transcript where a source has one, else the raw ones."""
    key = ["session", "src"]
    have = labelled.select(*key).distinct()
    hosts = labelled.where(F.coalesce("speaker", F.lit("host")) == "host")
    return hosts.unionByName(raw.join(have, key, "left_anti"), allowMissingColumns=True)
