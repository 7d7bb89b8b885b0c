"""Binary token shards: fixed-width little-endian records, a number of them per file."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.packing import token_type


def filesystem(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder (a path of this machine or any URI that Arrow knows) and its path there."""
    system, base = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    return system, base.rstrip("/")


def write_shards(records: DataFrame, folder: str, vocabulary: int, wanted: str = "auto") -> DataFrame:
    """Write (record, shard, tokens) to shard-NNNNN.bin files of a shared folder; (shard, path, records) of each.

    A shard is one task and is renamed when it is whole, so a task that runs again replaces its file.
    """
    kind = np.dtype(token_type(vocabulary, wanted)).newbyteorder("<")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("record")
        shard = int(pdf["shard"].iloc[0])
        system, base = filesystem(folder)
        system.create_dir(base, recursive=True)
        path = f"{base}/shard-{shard:05d}.bin"
        rows = np.stack([np.asarray(t) for t in pdf["tokens"]])
        if rows.min() < 0 or rows.max() >= vocabulary:
            raise ValueError(f"shard {shard} holds an id outside 0..{vocabulary - 1}")
        temporary = f"{base}/.{uuid.uuid4().hex}.partial"
        with system.open_output_stream(temporary) as out:
            out.write(rows.astype(kind).tobytes())
        system.move(temporary, path)
        return pd.DataFrame({"shard": [shard], "path": [path], "records": [len(rows)]})

    return records.select("record", "shard", "tokens").groupBy("shard").applyInPandas(run, "shard long, path string, records long")


def read_shards(spark: SparkSession, folder: str, width: int, kind: str) -> DataFrame:
    """(record, tokens) of the shards of a folder, records numbered in shard order; a file that isn't whole is an error."""
    dtype = np.dtype(kind).newbyteorder("<")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder).select("path", "length", "content")
    size = width * dtype.itemsize
    sizes = sorted((r["path"], r["length"]) for r in files.select("path", "length").collect())  # one row per file
    if bad := [p for p, n in sizes if n % size]:
        raise ValueError(f"{bad[0]} isn't a whole number of records")
    starts, at = {}, 0
    for p, n in sizes:
        starts[p] = at
        at += n // size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                rows = np.frombuffer(content, dtype).reshape(-1, width).astype(np.int64)
                for i in range(0, len(rows), 4096):
                    part = rows[i : i + 4096]
                    yield pd.DataFrame({"record": np.arange(starts[path] + i, starts[path] + i + len(part)), "tokens": list(part)})

    return files.drop("length").mapInPandas(run, "record long, tokens array<long>")


def at(records: DataFrame, index: int) -> DataFrame:
    """One record by its number; negative numbers count from the end."""
    if index < 0:
        index += records.count()
    return records.where(F.col("record") == index)


def read_record(folder: str, width: int, kind: str, index: int) -> np.ndarray:
    """One record of a folder's shards by its number, from the end if negative: a look at the sizes and one range read."""
    size = width * np.dtype(kind).itemsize
    system, base = filesystem(folder)
    found = sorted((f.path, f.size // size) for f in system.get_file_info(fs.FileSelector(base)) if f.path.endswith(".bin"))
    left = index + sum(n for _, n in found) if index < 0 else index
    for path, n in found if left >= 0 else ():
        if left < n:
            with system.open_input_file(path) as source:
                return np.frombuffer(source.read_at(size, left * size), np.dtype(kind).newbyteorder("<")).astype(np.int64)
        left -= n
    raise IndexError(index)
