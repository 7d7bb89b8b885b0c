"""Packing of token streams into fixed-width records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .assemble import running_total


def pack(docs: DataFrame, width: int, order: str = "doc_id", ids: str = "ids", per_shard: int = 8192) -> DataFrame:
    """(record, shard, tokens): all documents one after the other, cut into records of width + 1 ids; the rest is left out.

    Documents are cut where records end, by prefix sums, so slices are shuffled and not tokens: a row for each document
    and one for each record edge in it.
    """
    size = width + 1
    sized = docs.select(F.lit(0).alias("_g"), order, ids, F.size(ids).cast("long").alias("_n"))
    # documents without ids are left out after the running total, whose passes over the order alone then read no ids
    placed = running_total(sized, "_g", order, "_n", "_end").where("_n > 0").select(ids, "_n", (F.col("_end") - F.col("_n")).alias("_start"), "_end")
    first, last = F.floor(F.col("_start") / size), F.floor((F.col("_end") - 1) / size)

    def piece(record: Column) -> Column:
        begin = F.greatest(record * size - F.col("_start"), F.lit(0))
        end = F.least((record + 1) * size - F.col("_start"), F.col("_n"))
        return F.struct(record.alias("record"), (F.col("_start") + begin).alias("at"), F.slice(ids, (begin + 1).cast("int"), (end - begin).cast("int")).alias("piece"))

    each = placed.select(F.explode(F.transform(F.sequence(first, last), piece)).alias("x")).select("x.record", F.struct("x.at", "x.piece").alias("x"))
    records = each.groupBy("record").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    records = records.select("record", F.flatten(F.transform("xs", lambda x: x["piece"])).alias("tokens")).where(F.size("tokens") == size)
    return records.select("record", F.floor(F.col("record") / per_shard).alias("shard"), "tokens")


def training_view(records: DataFrame) -> DataFrame:
    """input_ids and labels of packed records: the same ids, one place apart."""
    n = F.size("tokens") - 1
    return records.select("record", F.slice("tokens", F.lit(1), n).alias("input_ids"), F.slice("tokens", F.lit(2), n).alias("labels"), F.array_repeat(F.lit(1), n).alias("attention_mask"))


def statistics(docs: DataFrame, width: int, ids: str = "ids") -> DataFrame:
    """One row: documents, stream tokens, records, tokens in no record, smallest and largest id."""
    n = F.sum(F.size(ids))
    return docs.agg(F.count("*").alias("documents"), n.alias("tokens"), F.floor(n / (width + 1)).alias("records"), (n % (width + 1)).alias("tail"), F.min(F.array_min(ids)).alias("smallest"), F.max(F.array_max(ids)).alias("largest"))


def token_type(vocabulary: int, wanted: str = "auto") -> str:
    """uint16 for vocabularies of up to 65536 ids, else uint32; a wanted type must be wide enough."""
    if vocabulary < 1:
        raise ValueError("a vocabulary has one id at least")
    limits = {"uint16": 1 << 16, "uint32": 1 << 32}
    if wanted == "auto":
        wanted = "uint16" if vocabulary <= limits["uint16"] else "uint32"
    if wanted not in limits or vocabulary > limits[wanted]:
        raise ValueError(f"{wanted} doesn't hold {vocabulary} ids")
    return wanted


def checked(docs: DataFrame, vocabulary: int, ids: str = "ids") -> DataFrame:
    """docs, with an error at run time if an id is negative or outside the vocabulary."""
    bad = F.exists(ids, lambda i: (i < 0) | (i >= vocabulary))
    return docs.withColumn(ids, F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit(f"token id outside 0..{vocabulary - 1}")).cast(dict(docs.dtypes)[ids])).otherwise(F.col(ids)))
