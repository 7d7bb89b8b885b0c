"""Language verification: text samples for a predictor, and the decision on its predictions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T

PREDICTIONS = "array<struct<language: string, confidence: double>>"


class Detector(Protocol):
    """A predictor of languages; made once per worker."""

    def predict(self, text: str, top_k: int) -> list[tuple[str, float]]: ...


@dataclass(frozen=True)
class LanguagePolicy:
    expected: str = "en"
    minimum_confidence: float = 0.80
    keep_low_confidence: bool = False
    keep_in_top_k: bool = False
    top_k: int = 3
    minimum_characters: int = 40
    sample_characters: int = 5000
    name_missing: bool = True  # missing and empty texts have reasons of their own

    def __post_init__(self) -> None:
        if not 0 <= self.minimum_confidence <= 1:
            raise ValueError("minimum_confidence must lie between 0 and 1")
        if self.top_k < 1 or self.sample_characters < 3 or self.minimum_characters < 0:
            raise ValueError("top_k and sample_characters must be positive")


def sample(c: Column, most: int) -> Column:
    """One line of at most `most` characters and two spaces: the beginning, the middle and the end of longer texts."""
    flat = T.squash(c)
    third = most // 3
    n = F.length(flat)
    middle = F.greatest(F.lit(0), F.floor(n / 2) - third // 2)
    parts = F.array(F.substring(flat, F.lit(1), F.lit(third)), F.substring(flat, (middle + 1).cast("int"), F.lit(third)), F.right(flat, F.lit(most - 2 * third)))
    return F.when(n <= most, flat).otherwise(F.array_join(F.filter(parts, lambda p: p != ""), " "))


def predictor(make: Callable[[], Detector], top_k: int) -> Callable[[Column], Column]:
    """A column function that runs a detector over samples, loading it once per worker."""

    @F.pandas_udf(PREDICTIONS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        detector = make()
        for texts in batches:
            yield texts.map(lambda t: [{"language": a, "confidence": float(b)} for a, b in detector.predict(t, top_k)] if t else [])

    return run


def decide(df: DataFrame, p: LanguagePolicy, predictions: str = "predictions", text: str = "text", length: Column | None = None) -> DataFrame:
    """Adds language_reason and language_keep; predictions are sorted from the surest on.

    length is what minimum_characters bounds: if not given, that of the text without its outer white space.
    """
    top = F.get(F.col(predictions), F.lit(0))
    sure = lambda x: x["confidence"] >= p.minimum_confidence
    ours = top["language"] == p.expected
    later = F.get(F.filter(F.slice(predictions, 2, 1000), lambda x: x["language"] == p.expected), F.lit(0))
    n = F.length(T.strip(F.col(text))) if length is None else length
    named = F.lit(p.name_missing)
    reason = (
        F.when(named & F.col(text).isNull(), "invalid_text_type").when(named & (n == 0), "empty_text").when(n < p.minimum_characters, "too_short_for_reliable_detection")
        .when(F.coalesce(F.size(predictions), F.lit(0)) <= 0, "no_prediction").when(ours & sure(top), "expected_language_high_confidence")
        .when(ours, "expected_language_low_confidence_kept" if p.keep_low_confidence else "expected_language_low_confidence")
    )
    if p.keep_in_top_k:
        reason = reason.when(F.coalesce(sure(later), F.lit(False)), "expected_language_in_top_k")
    kept = ("too_short_for_reliable_detection", "expected_language_high_confidence", "expected_language_low_confidence_kept", "expected_language_in_top_k")
    df = df.withColumn("language_reason", reason.otherwise("unexpected_language"))
    return df.withColumn("language_keep", F.col("language_reason").isin(*kept))
