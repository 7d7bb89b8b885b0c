"""The column operators over unbounded input: cleaning and decisions on streams, deduplication behind a watermark."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from ..functions import text as T
from ..operators import quality
from ..operators.clean import CleaningPolicy, clean


def clean_stream(stream: DataFrame, policy: CleaningPolicy = CleaningPolicy(), rules: quality.QualityPolicy = quality.QualityPolicy()) -> DataFrame:
    """Cleaned, judged and accepted documents of a stream: the batch operators as they are, row by row."""
    cleaned = clean(stream, policy).where("reason is null").drop("reason", "cleaning")
    return quality.evaluate(cleaned, rules).where("quality_decision <> 'reject'")


def distinct_stream(stream: DataFrame, time: str, delay: str = "1 hour", text: str = "text") -> DataFrame:
    """The first of each canonical text within the watermark; state older than that is dropped."""
    hashed = stream.withColumn("content_hash", F.sha2(T.squash(F.col(text)), 256))
    return hashed.withWatermark(time, delay).dropDuplicatesWithinWatermark(["content_hash"])


def windowed_counts(stream: DataFrame, time: str, by: str, size: str = "10 minutes", slide: str | None = None, delay: str = "10 minutes", value: str = "value") -> DataFrame:
    """Rows and sums by tumbling (or sliding) windows; late rows within the delay count."""
    window = F.window(time, size, slide) if slide else F.window(time, size)
    return stream.withWatermark(time, delay).groupBy(window.alias("window"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def session_counts(stream: DataFrame, time: str, by: str, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Rows of sessions that end after a gap without any."""
    return stream.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("session"), by).agg(F.count("*").alias("n"))


def budgeted_stream(stream: DataFrame, by: str, tokens: str, targets: Mapping[str, int]) -> DataFrame:
    """Rows of each source until its token target is met, as they come: (by, id, tokens, total).

    A source ends with the first row that would exceed the target; its first row is always taken. The state of a source is
    one sum and whether it has ended. Within a micro-batch rows count in the order of their ids.
    """
    limits = dict(targets)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, ended = state.get if state.exists else (0, False)
        rows = pd.concat(list(frames)).sort_values("id", kind="stable")
        taken = []
        for i, n in zip(rows["id"].tolist(), rows["tokens"].tolist(), strict=True):
            if ended or key[0] not in limits or (total and total + n > limits[key[0]]):
                ended = True
                break
            total += n
            ended = total >= limits[key[0]]
            taken.append((key[0], i, n, total))
        state.update((total, ended))
        yield pd.DataFrame(taken, columns=["source", "id", "tokens", "total"])

    rows = stream.select(F.col(by).alias("source"), "id", F.col(tokens).cast("long").alias("tokens"))
    kept = rows.groupBy("source").applyInPandasWithState(run, "source string, id long, tokens long, total long", "total long, ended boolean", "append", "NoTimeout")
    return kept.withColumnRenamed("source", by)


def write_once(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Everything that is there now, exactly once, to Parquet; run again to continue."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
