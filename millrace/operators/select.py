"""Small decisions over logs, registrations and configurations: summaries, selection, order and agreement by name."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

#: The rank of splits, evaluation before training, and that of any other name.
SPLIT_RANK = {"test": 0, "validation": 1, "train": 2}


def nested(c: Column, *path: str) -> Column:
    """A value in nested maps (or a JSON text) by its path; null where a step is missing."""
    for name in path:
        c = F.try_element_at(c, F.lit(name))
    return c


def license_summary(df: DataFrame, source: str = "source", license_: str = "license", decision: str = "license_decision") -> DataFrame:
    """Examples of each source with their licences, counts of decisions and whether a release needs a review."""
    said = F.coalesce(F.col(decision), F.lit("unknown"))
    out = df.groupBy(F.coalesce(F.col(source), F.lit("unknown")).alias("source")).agg(
        F.count("*").alias("examples"), F.array_sort(F.collect_set(F.coalesce(F.col(license_), F.lit("unknown")))).alias("licenses"), F.count_if(said == "pass").alias("passed"),
        F.count_if(said == "review").alias("reviewed"), F.count_if(~said.isin("pass", "review")).alias("invalid"),
    )
    return out.withColumn("release_status", F.when(F.col("reviewed") > 0, "requires_manual_review").otherwise("not_assessed_by_dataset_license_gate"))


def response_accuracy(df: DataFrame, *by: str, ignore: int = -100) -> DataFrame:
    """Correct and supervised places of rows with predictions and labels (arrays of one length) and their ratio.

    Place i of the predictions stands for label i + 1; ignored labels don't count. No supervised place is an error.
    """
    pairs = F.zip_with(F.slice("predictions", F.lit(1), F.size("labels") - 1), F.slice("labels", F.lit(2), F.size("labels") - 1), lambda p, x: F.struct(p.alias("p"), x.alias("x")))
    held = F.filter(pairs, lambda y: y["x"] != ignore)
    each = df.select(*by, F.size(held).alias("n"), F.size(F.filter(held, lambda y: y["p"] == y["x"])).alias("right"))
    out = each.groupBy(*by).agg(F.sum("right").alias("correct"), F.sum("n").alias("supervised"))
    none = F.coalesce(F.col("supervised"), F.lit(0)) == 0
    return out.withColumn("accuracy", F.when(none, F.raise_error(F.lit("no supervised place")).cast("double")).otherwise(F.bround(F.col("correct") / F.col("supervised"), 6)))


def aliases(pointers: DataFrame) -> DataFrame:
    """(checkpoint, pointers): names that point to one checkpoint together, sorted."""
    return pointers.groupBy("checkpoint").agg(F.array_sort(F.collect_set("pointer")).alias("pointers"))


def bands(candidates: DataFrame, baseline: Mapping[str, float], preferred: Mapping[str, float], most: Mapping[str, float], loss: str = "loss") -> DataFrame:
    """Adds the rise of perplexity over the baseline for each retention loss, improves, preferred and eligible.

    preferred and most: by name of a retention loss column, the largest rise that is preferred or allowed.
    """
    out = candidates.withColumns({f"{n}_rise": F.exp(F.col(n) - baseline[n]) - 1 for n in preferred})
    improves = F.col(loss) < baseline[loss]
    within = lambda limits: F.forall(F.array(*(F.col(f"{n}_rise") <= x for n, x in limits.items())), lambda x: x)
    return out.withColumns({"improves": improves, "preferred": improves & within(preferred), "eligible": improves & within(most)})


def best_candidate(candidates: DataFrame, loss: str = "loss", name: str = "checkpoint") -> DataFrame:
    """One row: the preferred candidate with the least loss (the first by name among equals); none is an error."""
    best = candidates.agg(F.min(F.when(F.col("preferred"), F.struct(loss, name))).alias("b"))
    return best.select(F.when(F.col("b").isNull(), F.raise_error(F.lit("no candidate is preferred")).cast("string")).otherwise(F.col(f"b.{name}")).alias(name), F.col(f"b.{loss}").alias(loss))


def stage_order(splits: DataFrame, dataset: str = "dataset", split: str = "split") -> DataFrame:
    """Adds position: evaluation splits before training ones, then by data set and name. Rows are a configuration's, so few."""
    from pyspark.sql import Window

    rank = F.coalesce(*(F.when(F.col(split) == n, r) for n, r in SPLIT_RANK.items()), F.lit(1))
    return splits.withColumn("position", F.row_number().over(Window.orderBy(rank, dataset, split)).cast("long"))


def matched(registered: DataFrame, tested: DataFrame, name: str = "profile", identity: str = "checkpoint") -> DataFrame:
    """registered with the columns of tested by name; a profile that wasn't tested, or on another checkpoint, is an error."""
    other = tested.withColumnRenamed(identity, "_identity").withColumn("_there", F.lit(True))
    both = registered.join(other, name, "left")
    problem = F.when(F.col("_there").isNull(), F.concat(F.lit("not tested: "), name)).when(~F.col("_identity").eqNullSafe(F.col(identity)), F.concat(F.lit("another checkpoint was tested: "), name))
    kind = dict(both.dtypes)[identity]
    checked = F.when(problem.isNotNull(), F.raise_error(problem).cast(kind)).otherwise(F.col(identity))
    return both.withColumn(identity, checked).drop("_identity", "_there")


def compared(left: DataFrame, right: DataFrame, by: str, loss: str) -> DataFrame:
    """Losses of two runs by source, their difference and the relative change of perplexity; sources must agree."""
    both = left.select(by, F.col(loss).alias("left"), F.lit(True).alias("_l")).join(right.select(by, F.col(loss).alias("right"), F.lit(True).alias("_r")), by, "full_outer")
    one = F.col("_l").isNull() | F.col("_r").isNull()
    a = F.when(one, F.raise_error(F.concat(F.lit("in one run only: "), by)).cast("double")).otherwise(F.col("left"))
    both = both.withColumn("left", a)
    return both.select(by, "left", "right", F.bround(F.col("right") - F.col("left"), 6).alias("difference"), F.bround(F.exp(F.col("right") - F.col("left")) - 1, 6).alias("perplexity_change"))
