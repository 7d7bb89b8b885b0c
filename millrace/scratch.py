"""Shared scratch tables: lineage is cut by writing Parquet below spark.checkpoint.dir, never by localCheckpoint."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .session import ship


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a session within one process may do without; it gets a folder of its own. On a cluster that would scatter
    tables over machines, so it is an error there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    """Remove a path of any file system that Spark knows."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


class Scratch:
    """Tables of one operator run, below one folder of the shared directory.

    drop() removes a table that nothing reads any more, close() all of them; what is left goes when the process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark, self.base, self.n = spark, f"{shared_dir(spark)}/millrace-{name}-{uuid.uuid4().hex[:12]}", 0
        atexit.register(self._clean)

    def path(self, label: str) -> str:
        self.n += 1
        return f"{self.base}/{self.n:03d}-{label}"

    def save(self, df: DataFrame, label: str = "t") -> DataFrame:
        """Write df and return it as read from the files, so that lost executors cost a re-read only."""
        path = self.path(label)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        delete(self.spark, df._scratch_path)

    def close(self) -> None:
        delete(self.spark, self.base)
        atexit.unregister(self._clean)

    def _clean(self) -> None:
        if self.spark.sparkContext._jsc is not None:
            try:
                delete(self.spark, self.base)
            except Exception:  # the session is gone: nothing can be removed any more
                pass
