"""The training-data pipeline over `documents`: each stage is one of the operators of millrace.llm.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents, and further columns
that docs may have, whatever their names.

Rows without an id are rows like any other but for the removal of duplicates and of repeated passages, which leave them
alone. Rows with one id are one document there: one row of it stays. A null or empty text fails the quality rules, so it
goes in the first stage; where a stage is run on its own it stays as it is. An empty table gives empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from millrace.llm import near, pack, pii, quality, suffix
from millrace.llm.store import Scratch
from millrace.session import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the robust outlier test reject are dropped; equal rows get equal verdicts."""
    return quality.filter_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates (0.8) the document with the smallest id stays; empty texts and null ids stay."""
    return near.keep_first(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of fifty words and more are cut out of their texts; n_chars follows. No row goes."""
    return suffix.remove_repeats(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kinds; n_chars follows. No row goes, null texts stay null."""
    return pii.redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are tokenised and packed into full windows of several sizes; one row per piece, an empty text is its end alone."""
    return pack.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicate removal", near_dedup),
    ("repeated-passage removal", repeated_passages),
    ("personal-data redaction", personal_data),
    ("packing", packing),
]

#: Sketches, suffix order, a trained span classifier and a tokenizer are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
