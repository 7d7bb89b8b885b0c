"""Corpus assembly: token estimates, budgets, evaluation splits, balanced mixtures, inclusion and id sets.

Budgets are prefixes, so they need running sums in an explicit order. running_total() takes them in two levels: totals
of ranges of the order, about equal in rows, and a window within each range. No source is ever one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T

CELLS, ROWS = 1 << 16, 200_000  # cells that ranges are made of; wanted rows of a range


def token_estimate(c: Column, characters_per_token: float = 4.0) -> Column:
    """Characters over characters per token, ties to even, one at least."""
    return F.greatest(F.lit(1), F.bround(F.length(c) / F.lit(characters_per_token), 0)).cast("long")


def running_total(df: DataFrame, group: str, order: str, value: str, name: str = "total") -> DataFrame:
    """df with the sum of value over the rows of its group up to and including its own, and the row's number (name_n).

    order must be a whole number that is unique within the group.
    """
    edge = df.agg(F.min(order).alias("lo"), F.max(order).alias("hi"), F.count(order).alias("n")).first()
    if edge["lo"] is None:
        return df.withColumns({name: F.lit(None).cast("long"), f"{name}_n": F.lit(None).cast("long")})
    width = max(1, -(-(edge["hi"] - edge["lo"] + 1) // CELLS))
    cell = F.floor((F.col(order) - edge["lo"]) / width).cast("int")
    # cells of equal width are counted and put together to ranges of as many rows each, however the order is spread
    counted = df.groupBy(cell.alias("_cell")).agg(F.count("*").alias("_k"))
    before = F.sum("_k").over(Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))  # at most CELLS rows
    ranges = counted.select("_cell", F.floor(F.coalesce(before, F.lit(0)) / max(1, min(ROWS, -(-edge["n"] // 64)))).cast("int").alias("_range"))
    cut = df.withColumn("_cell", cell).join(F.broadcast(ranges), "_cell").drop("_cell")
    sums = cut.groupBy(group, "_range").agg(F.sum(value).alias("_sum"), F.count("*").alias("_n"))
    past = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(group, "_range", F.coalesce(F.sum("_sum").over(past), F.lit(0)).alias("_before"), F.coalesce(F.sum("_n").over(past), F.lit(0)).alias("_rows"))
    inside = Window.partitionBy(group, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.withColumns({"_s": F.sum(value).over(inside), "_i": F.row_number().over(inside)})
    out = local.join(base, [group, "_range"]).withColumns({name: F.col("_s") + F.col("_before"), f"{name}_n": (F.col("_i") + F.col("_rows")).cast("long")})
    return out.select(*df.columns, name, f"{name}_n")


def token_budget(df: DataFrame, targets: DataFrame, excluded: DataFrame, group: str = "source", order: str = "doc_id", tokens: str = "tokens") -> tuple[DataFrame, DataFrame]:
    """The rows taken for targets(group, target), and a report of each group.

    Excluded ids and blank texts are passed over; a group's rows are taken in order until the next one would exceed the
    target; the first is always taken. Excluded rows are counted up to the row at which the group stops.
    """
    rows = df.join(excluded.select(order).withColumn("_out", F.lit(True)).distinct(), order, "left").join(targets, group)
    usable = rows.where(F.col("_out").isNull() & ~T.blank(F.col("text"))).drop("_out")
    run = running_total(usable, group, order, tokens, "total")
    # the first row that exceeds the target ends the group, even if a later one were smaller; sums never fall
    taken = run.where((F.col("total_n") == 1) | (F.col("total") <= F.col("target")))
    full = F.min(F.when(F.col("total") >= F.col("target"), F.col(order)))
    stop = run.groupBy(group).agg(F.min(F.when((F.col("total_n") > 1) & (F.col("total") > F.col("target")), F.col(order))).alias("_over"), full.alias("_full"))
    counted = rows.where(F.col("_out")).join(stop, group, "left").where(F.col(order) < F.coalesce(F.least("_over", "_full"), F.lit(2**62)))
    counted = counted.groupBy(group).agg(F.count("*").alias("excluded_documents"))
    report = taken.groupBy(group, "target").agg(F.count("*").alias("documents"), F.sum(tokens).alias("tokens")).join(counted, group, "left")
    report = report.withColumns({"excluded_documents": F.coalesce("excluded_documents", F.lit(0)), "exhausted": F.col("tokens") < F.col("target")})
    return taken, report


def evaluation_splits(df: DataFrame, sizes: dict[str, int], group: str = "source", order: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """Disjoint splits, one after the other in each group: each takes rows until its total reaches its size, the crossing row included."""
    out, rest = None, df
    for name, size in sizes.items():
        run = running_total(rest, group, order, tokens, "_total")
        mine = run.where(F.col("_total") - F.col(tokens) < size)
        part = mine.select(*df.columns, F.lit(name).alias("split"))
        out = part if out is None else out.unionByName(part)
        rest = run.where(F.col("_total") - F.col(tokens) >= size).select(*df.columns)
    return out


def round_robin(df: DataFrame, group: str, order: str) -> DataFrame:
    """As many rows of each group as the smallest has, numbered so that the i-th rows of all groups stand together (position)."""
    numbered = running_total(df.withColumn("_one", F.lit(1)), group, order, "_one", "_k")
    smallest = numbered.groupBy(group).agg(F.max("_k_n").alias("n")).agg(F.min("n").alias("n"), F.count("*").alias("groups"))
    ranks = df.select(group).distinct().withColumn("_rank", F.row_number().over(Window.orderBy(group)))  # a row for each source
    out = numbered.crossJoin(F.broadcast(smallest)).where("_k_n <= n").join(ranks, group)
    return out.select(*df.columns, ((F.col("_k_n") - 1) * F.col("groups") + F.col("_rank")).alias("position"))


def limit_each(df: DataFrame, group: str, order: str, most: int) -> DataFrame:
    """The first rows of each group, before any filter."""
    return running_total(df.withColumn("_one", F.lit(1)), group, order, "_one", "_k").where(F.col("_k_n") <= most).select(*df.columns)


def exclusion_reasons(quality: str = "quality_decision", license_: str = "license_decision", include_review: bool = True) -> Column:
    """Why a row isn't taken into a corpus: text, id, and the decisions of both stages."""
    rules = [(F.col("text").isNull(), "invalid_text_type"), (F.col("text").isNotNull() & T.blank(F.col("text")), "empty_text"), (F.col("doc_id").isNull(), "missing_document_id")]
    for name, c in (("quality", F.col(quality)), ("license", F.col(license_))):
        rules += [(c.isNull(), f"missing_{name}_decision"), (c.isNotNull() & ~c.isin("pass", "review"), f"{name}_not_accepted")]
        if not include_review:
            rules.append((c == "review", f"{name}_review_excluded"))
    return F.array_compact(F.array(*(F.when(c, F.lit(r)) for c, r in rules)))


def id_set_hash(ids: DataFrame, column: str) -> DataFrame:
    """One row: sha256 over the sorted ids, each followed by a newline. The set is concatenated, so it must fit one task."""
    joined = F.array_join(F.array_sort(F.collect_set(F.col(column))), "\n")
    return ids.agg(F.count_distinct(column).alias("ids"), F.sha2(F.when(F.count(column) == 0, F.lit("")).otherwise(F.concat(joined, F.lit("\n"))), 256).alias("ids_sha256"))


def epoch_order(df: DataFrame, key: str, seed: int, epoch: int, size: int, cursor: int = 0, drop_last: bool = False) -> DataFrame:
    """df in batches of a seeded order: adds batch and place; batches before the cursor are left out.

    The order is that of the first 60 bits of the digest of seed + epoch and the key, which must be unique.
    """
    digest = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed + epoch)), F.col(key)), 256), 1, 15), 16, 10).cast("long")
    mixed = running_total(df.withColumns({"_g": F.lit(0), "_one": F.lit(1), "_o": digest}), "_g", "_o", "_one", "_k")
    at = F.col("_k_n") - 1
    out = mixed.withColumns({"batch": F.floor(at / size), "place": at % size}).where(F.col("batch") >= cursor)
    if drop_last:
        whole = df.count() // size
        out = out.where(F.col("batch") < whole)
    return out.select(*df.columns, "batch", "place")
