"""The registered queries of this folder, each over its whole table, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tallygrade.llm import cotrain, decontamination, html, ids, jaccard, language, maxent, packing, rules, secrets, spelling, sql, turns, warc
from tallygrade.session import shared_folder


def vocabulary(name: str) -> str:
    """Where the installed package of public tokenizers keeps a vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document, by compression."""
    return language.language_id(_table(spark, folder, "documents"))


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Base counts and the verdict of the model trained on the quality labels."""
    return rules.quality_rules(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op3_token_ids(spark: SparkSession, folder: str) -> DataFrame:
    """All documents written as coded ids to the shared folder, and read back from there."""
    path = f"{shared_folder(spark).rstrip('/')}/ids-{uuid.uuid4().hex}"
    ids.write_ids(_table(spark, folder, "documents"), path, vocabulary("byte_bpe_50k.json"), end=2)
    return ids.read_ids(spark, path)


def op4_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """Log probabilities of all documents under word shares and the maximum-entropy model."""
    return maxent.lm_scores(_table(spark, folder, "documents"))


def op5_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of all documents by two co-trained views."""
    return cotrain.cotrained(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op6_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of secrets by fixed patterns and by Markov models."""
    return secrets.secret_scan(_table(spark, folder, "documents"))


def op7_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Places of all documents in sequences of 2048 ids."""
    return packing.best_fit_packing(_table(spark, folder, "documents"), vocabulary("word_bpe_49k.json"))


def op8_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose 3-word shingles agree to 90 per cent."""
    return jaccard.jaccard_components(_table(spark, folder, "documents"), words=3, percent=90)


def op9_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of every page."""
    return html.extracted(_table(spark, folder, "pages"))


def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Occurrences of 10-word windows of benchmark items in documents."""
    return decontamination.contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op11_warc(spark: SparkSession, folder: str) -> DataFrame:
    """All pages written as WARC files to the shared folder, and what their records say when read back."""
    path = f"{shared_folder(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    warc.write_archives(_table(spark, folder, "pages"), path)
    return warc.page_facts(warc.read_archives(spark, path))


def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Faults of all damaged conversations and the cheapest edits that mend them."""
    conversations = _table(spark, folder, "conversations")
    return turns.repaired(conversations, turns.damaged(conversations))


def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Words of all documents, grouped by their more frequent neighbours."""
    return spelling.spelling_groups(spelling.damaged_runs(_table(spark, folder, "documents")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_quality_rules,
        op3_token_ids,
        op4_lm_scoring,
        op5_quality_classifier,
        op6_secret_scans,
        op7_best_fit_packing,
        op8_ngram_jaccard,
        op9_html_extraction,
        op10_decontamination,
        op11_warc,
        op12_conversation_repair,
        op13_spelling_variants,
    )
}
ORACLES = {
    "op8_ngram_jaccard": sql.JACCARD,
    "op10_decontamination": sql.DECONTAMINATION,
    "op11_warc": sql.WARC,
    "op12_conversation_repair": sql.TURNS,
    "op13_spelling_variants": sql.SPELLING,
}
