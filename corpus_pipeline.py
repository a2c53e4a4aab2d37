"""A training corpus in five stages: language, near-duplicates, benchmarks, personal data, mix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from addonscope.llm import anchors, langid, mixing, pseudonyms, resemblance, tiling
from addonscope.llm.common import fresh, read, row_key
from addonscope.llm.queries import PII_KEY, training
from addonscope.session import materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in which one learned language has at least half of the text.

    The languages are learned from the labelled documents outside the held-out third.
    Texts that are null or have no letter go.
    """
    return langid.kept(docs, langid.fit(training(docs)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: the smallest id, nulls last.

    Near are fingerprints within 4 bits, and texts that share four fifths of their
    five-word shingles. Of repeated rows with that id and text, one stays.
    """
    marked = anchors.near_duplicates(docs, lambda rows: resemblance.links(docs, rows))
    first = anchors.representatives(marked)
    row = fresh(docs, "row_key")
    marked = docs.withColumn(row, row_key())
    return (
        marked.join(first.withColumnRenamed("row", row), row, "left_semi").dropDuplicates([row]).drop(row)
    )


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose tiles cover four fifths of a benchmark item."""
    found = tiling.contamination(docs, read(spark, sf_dir, "benchmark"))
    found = materialize(found.select("row"), "contaminated")
    row = fresh(docs, "row_key")
    marked = docs.withColumn(row, row_key())
    return marked.join(found.withColumnRenamed("row", row), row, "left_anti").drop(row)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by pseudonyms of the same format and length."""
    found = fresh(docs, "pii")
    return pseudonyms.pseudonymize(docs, PII_KEY, found=found).drop(found)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, in its order, with the words taken of each."""
    return mixing.mixture(docs)


STAGES = [
    ("language_id", language),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("pii", personal_data),
    ("mixing", mix),
]

#: Fingerprints, mixtures of languages and keyed permutations are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
