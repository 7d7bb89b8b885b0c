"""Reports and manifests: small documents written to any file system that Spark knows."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from .files import manifest


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def write_text(spark: SparkSession, path: str, text: str, replace: bool = False) -> None:
    """Write one small file under another name and rename it when it is whole; an existing one is an error unless replaced."""
    fs, p = _fs(spark, path)
    if fs.exists(p) and not replace:
        raise FileExistsError(path)
    part = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.partial")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    if replace:
        fs.delete(p, False)
    fs.rename(part, p)


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def write_json(spark: SparkSession, path: str, value: Mapping, replace: bool = False) -> None:
    write_text(spark, path, json.dumps({"generated_at_utc": datetime.now(UTC).isoformat(), **value}, indent=2, ensure_ascii=False, default=str) + "\n", replace)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(read_text(spark, path))


def rows(df: DataFrame) -> list[dict]:
    """The rows of a report (bounded: one for each split, source or reason) as plain dictionaries."""
    return [r.asDict(recursive=True) for r in df.collect()]


def markdown(title: str, tables: Mapping[str, Sequence[Mapping]]) -> str:
    """A Markdown document with a heading and a table for each list of rows."""
    out = [f"# {title}", ""]
    for name, found in tables.items():
        out += [f"## {name}", ""]
        if not found:
            out += ["No rows.", ""]
            continue
        columns = list(found[0])
        out += [f"| {' | '.join(columns)} |", f"|{' --- |' * len(columns)}"]
        out += [f"| {' | '.join(str(r.get(c, '')).replace('|', chr(92) + '|').replace(chr(10), ' ') for c in columns)} |" for r in found] + [""]
    return "\n".join(out)


def artifacts(spark: SparkSession, folder: str) -> list[dict]:
    """Path below the folder, size and digest of its data files, in order; markers are left out."""
    found = manifest(spark, folder).where(~F.col("path").rlike(r"/[._][^/]*$"))
    return rows(found.select(F.regexp_replace("path", r"^.*?" + folder.rstrip("/").rpartition("/")[2].replace(".", r"\.") + "/", "").alias("path"), "size_bytes", "sha256").orderBy("path"))


def verify(spark: SparkSession, folder: str, known: Sequence[Mapping]) -> list[str]:
    """What differs from a list of artifacts: missing, changed and added files."""
    now, before = ({r["path"]: r["sha256"] for r in x} for x in (artifacts(spark, folder), known))
    return sorted([f"missing {p}" for p in before.keys() - now.keys()] + [f"added {p}" for p in now.keys() - before.keys()] + [f"changed {p}" for p in before.keys() & now.keys() if before[p] != now[p]])
