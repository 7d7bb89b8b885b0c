"""JSON-lines scans and sinks, text corpora, immutable and resumable writes, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as S

from ..functions import text as T
from ..operators.assemble import running_total

DOCUMENT = S.StructType(
    [S.StructField(n, S.StringType()) for n in ("id", "source", "source_dataset", "source_config", "source_split", "license", "language", "text")] + [S.StructField("metadata", S.MapType(S.StringType(), S.StringType()))]
)
#: The fields that name a record for resuming, in their order.
KEYS = ("pmcid", "pmid", "doi", "source_document_id", "id")


def read_jsonl(spark: SparkSession, path: str, schema: S.StructType = DOCUMENT) -> DataFrame:
    """Records of a JSON-lines file or folder; blank lines are skipped and a broken or non-object line is an error.

    The error names the file and shows the line.
    """
    kept = S.StructType([*schema.fields, S.StructField("_broken", S.StringType())])
    rows = spark.read.schema(kept).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(path)
    first = schema.fields[0]
    problem = F.concat(F.lit("not a JSON object in "), F.col("_metadata.file_path"), F.lit(": "), F.substring("_broken", 1, 200))
    checked = F.when(F.col("_broken").isNotNull(), F.raise_error(problem).cast(first.dataType)).otherwise(F.col(first.name))
    return rows.select(checked.alias(first.name), *(f.name for f in schema.fields[1:]))


def read_texts(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """(text) of a JSON-lines file or folder: stripped, not empty; with most, the first in the order of paths and lines."""
    rows = spark.read.schema("text string").option("mode", "FAILFAST").json(path)
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
    rows = rows.select(place.alias("_o"), T.strip(F.col("text")).alias("text")).where("text <> ''")
    return (rows.orderBy("_o").limit(most) if most is not None else rows).select("text")


def write_jsonl(df: DataFrame, path: str) -> int:
    """Write compact JSON lines to a folder that must not exist; the number of rows, counted while they are written."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("errorifexists").json(path)
    return int(seen.get["n"])


def resume_key(df: DataFrame) -> Column:
    """The first of KEYS that a row has, else the digest of its text."""
    there = [F.when(~T.blank(F.col(k).cast("string")), F.concat(F.lit(f"{k}:"), F.col(k).cast("string"))) for k in KEYS if k in df.columns]
    return F.coalesce(*there, F.concat(F.lit("text:"), F.sha2(F.coalesce("text", F.lit("")), 256)))


def append_unseen(df: DataFrame, path: str, order: str, most: int | None = None) -> int:
    """Append the rows whose key isn't in the Parquet folder yet, the first of each key in order, up to `most` rows in the folder."""
    spark, known = df.sparkSession, 0
    rows = df.withColumn("resume_key", resume_key(df))
    first = rows.groupBy("resume_key").agg(F.min(order).alias(order))
    rows = rows.join(first, ["resume_key", order], "left_semi")
    try:
        old = spark.read.parquet(path).select("resume_key")
        known = old.count()
        rows = rows.join(old, "resume_key", "left_anti")
    except Exception as e:  # only a folder that isn't there yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    if most is not None:
        rows = running_total(rows.withColumns({"_g": F.lit(0), "_one": F.lit(1)}), "_g", order, "_one", "_k").where(F.col("_k_n") <= most - known).drop("_g", "_one", "_k", "_k_n")
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    return int(seen.get["n"])


def write_corpus(df: DataFrame, path: str, order: str, flatten: bool = True, separator: str = "\n") -> None:
    """Documents in order, one line each with white space flattened, or as they are; the separator stands between them.

    Blank documents are left out.
    """
    text = T.flatten_line(F.col("text")) if flatten else T.strip(F.col("text"))
    lines = df.select(order, text.alias("value")).where("value <> ''")
    rows = lines.repartitionByRange(order).sortWithinPartitions(order).select("value")
    rows.write.mode("errorifexists").option("lineSep", separator).text(path)


def write_immutable(df: DataFrame, path: str, **options) -> None:
    df.write.mode("errorifexists").options(**options).parquet(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, size_bytes, sha256) of all files below a path. Files are read whole, so they must fit a task."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change) of files that a manifest and a later one don't share: missing, added or changed."""
    both = before.select("path", F.col("sha256").alias("a")).join(after.select("path", F.col("sha256").alias("b")), "path", "full_outer")
    kind = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "added").when(F.col("a") != F.col("b"), "changed")
    return both.select("path", kind.alias("change")).where("change is not null")
