"""Corpus statistics, audits and metric logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from .assemble import token_estimate

MARKS = {"median": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def named(c: Column) -> Column:
    """A label for counting: stripped, and `missing` if null or blank."""
    return F.coalesce(F.nullif(T.strip(c.cast("string")), F.lit("")), F.lit("missing"))


def corpus_statistics(df: DataFrame, *by: str) -> DataFrame:
    """Documents, characters, words, estimated tokens, and the distribution of characters and tokens (interpolated)."""
    rows = df.select(*by, F.length("text").cast("long").alias("c"), F.size(T.space_words(F.col("text"))).cast("long").alias("w"), token_estimate(F.col("text")).alias("t"))
    out = [F.count("*").alias("documents"), F.sum("c").alias("characters"), F.sum("w").alias("words"), F.sum("t").alias("tokens")]
    for name, c in (("characters", "c"), ("tokens", "t")):
        out += [F.min(c).alias(f"{name}_min"), F.max(c).alias(f"{name}_max"), F.bround(F.avg(c), 6).alias(f"{name}_mean")]
        out += [F.bround(F.percentile(c, F.lit(q)), 6).alias(f"{name}_{m}") for m, q in MARKS.items()]
    return rows.groupBy(*by).agg(*out) if by else rows.agg(*out)


def totals(df: DataFrame, split: str) -> DataFrame:
    """Documents and characters of each split and of all together (split `all`)."""
    rolled = df.rollup(split).agg(F.grouping(split).alias("_all"), F.count("*").alias("documents"), F.sum(F.length("text")).alias("characters"))
    return rolled.select(F.when(F.col("_all") == 1, "all").otherwise(named(F.col(split))).alias("split"), "documents", "characters")


def source_audit(available: DataFrame, used: DataFrame, by: str = "source", key: str = "doc_id") -> DataFrame:
    """Available, used and unused documents and tokens of each source."""
    marked = available.join(used.select(key).distinct().withColumn("_used", F.lit(True)), key, "left")
    on = F.coalesce("_used", F.lit(False))
    return marked.groupBy(by).agg(
        F.count("*").alias("available_documents"), F.sum("tokens").alias("available_tokens"), F.count_if(on).alias("used_documents"), F.sum(F.when(on, F.col("tokens")).otherwise(0)).alias("used_tokens"),
        F.count_if(~on).alias("unused_documents"), F.sum(F.when(on, 0).otherwise(F.col("tokens"))).alias("unused_tokens"),
    )


def mixture(df: DataFrame, evaluation: DataFrame, domain: str, key: str = "doc_id") -> DataFrame:
    """One row: token shares of each of two domains and documents shared with the evaluation set."""
    seen = df.join(evaluation.select(key).distinct().withColumn("_eval", F.lit(True)), key, "left")
    medical = F.sum(F.when(F.col(domain) == "medical", F.col("tokens")).otherwise(0))
    total = F.sum("tokens")
    return seen.agg(total.alias("tokens"), F.bround(medical / total, 6).alias("medical_share"), F.bround((total - medical) / total, 6).alias("general_share"), F.count_if(F.col("_eval").isNotNull()).alias("evaluation_overlap"))


def running_best(log: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """log with best (smallest value so far), improved, and the length of the run without improvement (stale)."""
    w = Window.partitionBy(group).orderBy(*order)
    past = F.min(value).over(w.rowsBetween(Window.unboundedPreceding, -1))
    df = log.withColumn("improved", F.coalesce(F.col(value) < past, F.lit(True)))
    df = df.withColumn("_island", F.sum(F.col("improved").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumns({"best": F.min(value).over(w.rowsBetween(Window.unboundedPreceding, 0)), "stale": (F.row_number().over(Window.partitionBy(group, "_island").orderBy(*order)) - 1).cast("long")})
    return df.drop("_island")


def retention_bands(log: DataFrame, group: str, value: str, baseline: Column, warn: float = 0.05, stop: float = 0.15) -> DataFrame:
    """Rows of each group by how far value lies above a baseline: ok, warn or stop."""
    rise = F.col(value) / baseline - 1
    band = F.when(rise > stop, "stop").when(rise > warn, "warn").otherwise("ok")
    return log.select(group, band.alias("band")).groupBy(group, "band").agg(F.count("*").alias("n"))


def weighted_loss(df: DataFrame, by: str, nll: str, tokens: str, most: float = 20.0) -> DataFrame:
    """Token-weighted loss and perplexity; the exponent is guarded against overflow."""
    loss = F.sum(nll) / F.sum(tokens)
    return df.groupBy(by).agg(F.sum(tokens).alias("tokens"), F.bround(loss, 6).alias("loss")).withColumn("perplexity", F.bround(F.exp(F.least(F.col("loss"), F.lit(most))), 4))


def compare_sources(a: DataFrame, b: DataFrame, by: str, value: str) -> DataFrame:
    """Values of both sides and their difference; a source that one side lacks has a null there."""
    left, right = a.select(by, F.col(value).alias("left")), b.select(by, F.col(value).alias("right"))
    return left.join(right, by, "full_outer").withColumn("difference", F.bround(F.col("right") - F.col("left"), 6))
