"""Tokenizer plug-ins: encoding, metrics, fragmentation and comparison."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from ..session import ship

_loaded: dict[str, object] = {}
PIECE = 1 << 18  # characters that are encoded at a time: a token's entry takes far more memory than its characters


def load(path: str):
    """One tokenizer for each worker process and file."""
    if path not in _loaded:
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def pieces(texts: list[str], most: int = PIECE) -> Iterator[list[str]]:
    """Runs of texts of about so many characters, one text at least."""
    held, n = [], 0
    for t in texts:
        held.append(t)
        n += len(t)
        if n >= most:
            yield held
            held, n = [], 0
    if held:
        yield held


def encode(c: Column, path: str) -> Column:
    """Token ids of a text column, without special tokens; a null text is empty."""

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = load(path)
        for texts in batches:
            yield pd.Series([e.ids for p in pieces(texts.fillna("").tolist()) for e in t.encode_batch_fast(p, add_special_tokens=False)], index=texts.index)

    return run(c)


def token_count(c: Column, path: str, eos: int = 1) -> Column:
    """Exact tokens of a text with its end, for budgets."""
    return (F.size(encode(c, path)) + eos).cast("long")


def _measured(t, texts: list[str], unknown: str) -> list[tuple[int, int, int, bool]]:
    """Tokens, single characters, unknown tokens and whether the text comes back, of each text."""
    made = t.encode_batch(texts, add_special_tokens=False)
    ids = [e.ids for e in made]
    back = t.decode_batch(ids, skip_special_tokens=False)
    missing = t.token_to_id(unknown)
    return [(len(i), sum(len(x) == 1 for x in e.tokens), i.count(missing), a == b) for e, i, a, b in zip(made, ids, texts, back, strict=True)]


def metrics(df: DataFrame, path: str, by: str, unknown: str = "<unk>") -> DataFrame:
    """Tokenizer metrics overall and by one column: tokens, ratios, single-character, unknown and round-trip rates, length summary."""

    @F.pandas_udf("struct<tokens: long, singles: long, unknowns: long, same: boolean>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        t = load(path)
        for texts in batches:
            yield pd.DataFrame([row for p in pieces(texts.fillna("").tolist()) for row in _measured(t, p, unknown)], columns=["tokens", "singles", "unknowns", "same"])

    ship(df.sparkSession)
    rows = df.select(by, F.length("text").alias("c"), F.octet_length("text").alias("b"), F.size(T.space_words(F.col("text"))).alias("w"), run(F.col("text")).alias("e")).select(by, "c", "b", "w", "e.*")
    rate = lambda a, b: F.when(b == 0, 0.0).otherwise(F.bround(a / b, 6))
    total = F.sum("tokens")
    out = rows.groupingSets([[], [by]], by).agg(
        F.grouping(by).alias("_all"), F.count("*").alias("documents"), total.alias("tokens"), rate(total, F.sum("w")).alias("tokens_per_word"), rate(F.sum("c"), total).alias("characters_per_token"),
        rate(F.sum("b"), total).alias("bytes_per_token"), rate(F.sum("singles"), total).alias("single_character_rate"), rate(F.sum("unknowns"), total).alias("unknown_rate"), F.bround(F.avg(F.col("same").cast("double")), 6).alias("round_trip_rate"),
        F.min("tokens").alias("tokens_min"), F.max("tokens").alias("tokens_max"), F.percentile("tokens", F.lit(0.5)).alias("tokens_median"), F.percentile("tokens", F.lit(0.95)).alias("tokens_p95"),
    )
    return out.withColumn(by, F.when(F.col("_all") == 1, "all").otherwise(F.col(by))).drop("_all")


def fragmentation(terms: DataFrame, path: str, column: str) -> DataFrame:
    """(term, tokens): into how many tokens each term falls with a space before it."""
    ship(terms.sparkSession)
    return terms.select(column, F.size(encode(F.concat(F.lit(" "), F.col(column)), path)).cast("long").alias("tokens"))


def common_tokens(df: DataFrame, path: str, most: int = 50) -> DataFrame:
    """(token_id, token, n): the most frequent tokens of a text column, ties by their numbers."""
    ship(df.sparkSession)

    @F.pandas_udf("string")
    def name(ids: pd.Series) -> pd.Series:
        return ids.map(load(path).id_to_token)

    counted = df.select(F.explode(encode(F.col("text"), path)).alias("token_id")).groupBy("token_id").agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), "token_id").limit(most).select("token_id", name("token_id").alias("token"), "n")


def vocabulary_use(df: DataFrame, path: str) -> DataFrame:
    """One row: vocabulary size, distinct ids in use, and their share."""
    ship(df.sparkSession)
    size = load(path).get_vocab_size()
    used = df.select(F.explode(encode(F.col("text"), path)).alias("id")).agg(F.count_distinct("id").alias("used"))
    return used.select(F.lit(size).alias("vocabulary"), "used", F.bround(F.col("used") / size, 6).alias("share"))


def compare(baseline: dict[str, float], other: dict[str, float]) -> dict[str, object]:
    """Percent changes of metrics and which tokenizer most of the criteria favour (a tie favours the other)."""
    change = {k: round(100 * (other[k] - v) / v, 6) if v else 0.0 for k, v in baseline.items() if k in other}
    lower, higher = ("tokens_per_word", "single_character_rate", "fragmentation"), ("characters_per_token", "bytes_per_token")
    wins = sum(change[k] < 0 for k in lower if k in change) + sum(change[k] > 0 for k in higher if k in change)
    losses = sum(change[k] > 0 for k in lower if k in change) + sum(change[k] < 0 for k in higher if k in change)
    return {"change_percent": change, "recommended": "baseline" if losses > wins else "other"}
