"""From raw documents to packed sequences: rules, classifier, near duplicates, mixture, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuespan.llm import fm, mixing, queries, rules, shinglejoin
from cuespan.llm.common import doc_bucket, staged


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the cutoffs of their language and source."""
    return rules.keep_good(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine takes for good. It learns from the labelled rows of the
    raw table, as the rules before have taken out most of the bad ones."""
    raw = queries.table(spark, sf_dir, "documents")
    machine = fm.learn(raw, queries.table(spark, sf_dir, "labels"), "quality", doc_bucket(F.col("doc_id"), 3) != 1, fm.QUALITY)
    names = docs.columns
    return fm.scored(docs.select(*names), machine, 0.5).where("predicted = 1").select(*names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shingle Jaccard links hold together."""
    return shinglejoin.one_of_each(docs)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in files that follow the mixture's order."""
    return mixing.in_order(mixing.mix(docs)).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 ids."""
    return queries.packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("source_mixture", source_mixture),
    ("packing", packing),
]

#: The classifier is trained and the windows are filled online: SQL can't express either.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read by the next."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
