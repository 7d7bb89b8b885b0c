"""What a session needs before operators run on its executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
BATCH = 4 << 20  # bytes of an Arrow batch: 10,000 long texts, Spark's own bound, are too much for a worker


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers of the session's application, once, and bound what they are sent at a time.

    A bound that the application was started with is left alone.
    """
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext.getConf().get(size) is None:
        spark.conf.set(size, str(BATCH))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="millrace-"), "millrace.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in sorted(os.walk(root)):
            for name in sorted(names):
                if name.endswith(".py"):
                    file = os.path.join(folder, name)
                    z.write(file, os.path.join("millrace", os.path.relpath(file, root)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, as Spark reads it.

    A file that can't be split into as many parts as half the cores is dealt out anew, as text operators are bound by
    the processor; large tables have more parts than that and are left alone. Rows are dealt by their first column, the
    id, so they lie in the same place whatever columns a plan reads.
    """
    ship(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores, df.columns[0]) if df.rdd.getNumPartitions() * 2 <= cores else df
