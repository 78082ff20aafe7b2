"""Corpus pipeline: language, near-duplicates, benchmark passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all documents that the stage before kept; all but the last return the
columns of ``documents``.  An empty table gives no rows, null texts are in no language and go with the first stage,
repeated rows stay repeated but for the near-duplicate stage, which keeps one, and columns may have any names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtrace.llm.common import free_name, table, written
from fieldtrace.llm.decontaminate import drop_contaminated
from fieldtrace.llm.language import fit_language_network, predict_language
from fieldtrace.llm.near_dups import drop_near_duplicates
from fieldtrace.llm.packing import pack_documents
from fieldtrace.llm.pii import redact_personal_data

#: Below this probability of its best language a document counts as being in none.
LEAST_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages of the labels; those without a letter or a likely language go."""
    pred, score = free_name(docs, "_lang"), free_name(docs, "_score")
    scored = predict_language(docs, fit_language_network(docs), pred=pred, score=score)
    return scored.where((F.col(pred) != "und") & (F.col(score) >= LEAST_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, identifiers replaced by their kind and ``n_chars`` counted anew where there is such a column."""
    clean = redact_personal_data(docs)
    if "n_chars" not in clean.columns:
        return clean
    return clean.withColumn("n_chars", F.length("text").cast(clean.schema["n_chars"].dataType)).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2048 tokens."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, room=2048)


STAGES = [
    ("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
    ("personal_data", personal_data), ("packing", packing),
]

#: A trained network and a vocabulary cannot be written in SQL; the tests hold each stage against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs)
    return docs
