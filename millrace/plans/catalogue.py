"""The registered queries of the engine's own operators and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import table
from . import assembly_queries, build_queries, dedup_queries, policy_queries, text_queries  # noqa: F401
from .registry import QUERIES, SQL, Query


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, documents, passed, reviewed, rejected): distinct documents once evaluation text is protected, and all decisions."""
    judged = QUERIES["quality_decision"](spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    decided = judged.groupBy("source").agg(*(F.count_if(F.col("quality_decision") == d).alias(n) for n, d in (("passed", "pass"), ("reviewed", "review"), ("rejected", "reject"))))
    return QUERIES["distinct_documents_by_source"](spark, sf_dir).join(decided, "source")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
