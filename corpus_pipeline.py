"""The corpus pipeline: rules, near copies, benchmark passages, secrets, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallygrade.llm import decontamination, entries, jaccard, packing, rules, secrets
from tallygrade.session import cut


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def good_quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the base rules or the quality model reject go."""
    return rules.passing(docs, _table(spark, folder, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity of 0.8."""
    return jaccard.one_of_each(docs, words=5, percent=80)


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents with an occurrence of a 10-word window of a benchmark item go."""
    return decontamination.without_contaminated(docs, _table(spark, folder, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Every document stays; secrets in its text are replaced."""
    return secrets.redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Places of what is left in sequences of 2048 ids."""
    return packing.best_fit_packing(docs, entries.vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality rules", good_quality),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", clean_of_benchmarks),
    ("secret scans", without_secrets),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over documents; what one keeps is written to the shared folder and read by the next."""
    docs = _table(spark, folder, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, folder)
        if i < len(STAGES) - 1:
            docs = cut(docs, f"stage{i}")
    return docs


#: The quality model has no SQL; the tests compare with a brute-force version.
ORACLE_SQL = None
