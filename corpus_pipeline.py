"""Five stages that take a raw corpus to packed training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomspan.llm import decontamination, packing, quality_classifier, quality_rules, simhash
from loomspan.llm.common import discard, stored, table


def _rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; null, empty and wordless texts fail the base rules and go. Each row is
    judged on its own text, so repeated rows and null ids need no rule of their own. A long text counts whole."""
    return quality_rules.keep_good(docs)


def _classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more; null and empty texts are scored like any other. Each row is
    judged by itself, so repeated rows share a verdict."""
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id, once. Null and wordless texts
    are copies of one another; rows without a doc_id stay."""
    return simhash.keep_one(docs)


def _decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item in them. Null texts hold none; rows without a doc_id stay; of a repeated id
    all rows go if one does. Null and empty items match nothing."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of the sequences; a null text is one piece, its end id. Repeated rows and null ids are packed
    each for itself."""
    return packing.pack_documents(docs)


#: Every stage takes an empty table to an empty one and keeps columns that it doesn't read, whatever their names; the last has its own.
STAGES = [
    ("quality rules", _rules),
    ("quality classifier", _classifier),
    ("simhash near-dedup", _near_duplicates),
    ("benchmark decontamination", _decontamination),
    ("best-fit packing", _packing),
]

#: Fingerprints, the classifier and the tokenizer have no form in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are written and read again as the next one's documents; earlier files go once they are no longer read."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs, path = stored(stage(spark, docs, sf_dir))
        if before:
            discard(spark, before)
        before = path
    return docs
