"""Registered queries of the training-data operators: each reads its whole table and returns its contract's columns."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import table
from . import ann, bpe, license, lm, near, pack, pii, quality, suffix, warc
from .sql import ORACLES


def op1_robust_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.near_duplicates(table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


def op2_brown_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op3_sparse_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeated_spans(table(spark, sf_dir, "documents"))


def op4_bitmap_queue_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_licence_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(table(spark, sf_dir, "documents"))


def op7_zip_warc_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_weakly_supervised_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op9_setsketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op10_robust_outlier_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def lm_base_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op2 that don't depend on the trained classes."""
    return op2_brown_class_lm(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"))


def passage_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of op3 without the documents that they are copies of."""
    return op3_sparse_suffix_array(spark, sf_dir).select("doc_id", "start_word", "end_word", "start_byte", "end_byte")


def pii_base_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op8 that don't depend on the trained classifier."""
    return op8_weakly_supervised_pii(spark, sf_dir).drop("spans")


def quality_base_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op10 that don't depend on the robust estimate."""
    return op10_robust_outlier_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


#: Queries beside the ten, for what SQL can express of them.
PARTS = (lm_base_columns, passage_spans, pii_base_columns, quality_base_columns)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: f for name, f in globals().items() if name.startswith("op") and callable(f)} | {"pipeline": corpus_pipeline.run}
    return found | {f.__name__: f for f in PARTS}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
