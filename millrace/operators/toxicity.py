"""Toxicity audit: context terms, chunks, score aggregation and the decision; models are plugged in."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T


class Scorer(Protocol):
    """A multi-label classifier of texts; made once per worker."""

    def score(self, texts: Sequence[str]) -> list[dict[str, float]]: ...


@dataclass(frozen=True)
class ToxicityPolicy:
    monitored: Sequence[str] = ("toxic", "severe_toxic", "obscene", "threat", "insult", "identity_hate")
    severe: Sequence[str] = ("severe_toxic", "threat")
    review: float = 0.70
    reject: float = 0.95
    auto_reject: bool = False
    context_protects: bool = True
    medical_terms: Sequence[str] = ()
    educational_terms: Sequence[str] = ()
    minimum_matches: int = 1

    def __post_init__(self) -> None:
        if not 0 <= self.review <= self.reject <= 1:
            raise ValueError("thresholds must satisfy 0 <= review <= reject <= 1")
        if not self.monitored or self.minimum_matches < 1:
            raise ValueError("monitored labels are needed, and minimum_matches must be positive")


def term_pattern(term: str) -> str:
    """Whole-word pattern of one normalised term."""
    return rf"(?<![\p{{L}}\p{{N}}_]){re.escape(term)}(?![\p{{L}}\p{{N}}_])"


def term_counts(flat: Column, terms: Sequence[str]) -> Column:
    """Map of the terms that occur as whole words or phrases in a folded, flattened text to their counts."""
    clean = [x for x in dict.fromkeys(" ".join(t.casefold().split()) for t in terms) if x]
    if not clean:
        return F.expr("cast(map() as map<string, int>)")
    return F.map_filter(F.create_map(*(c for t in clean for c in (F.lit(t), F.regexp_count(flat, F.lit(term_pattern(t)))))), lambda _, n: n > 0)


def context(df: DataFrame, p: ToxicityPolicy, text: str = "text") -> DataFrame:
    """Adds medical_context, educational_context and the sorted matched terms of both."""
    df = T.let(df, x_flat=T.fold(T.squash(F.coalesce(F.col(text), F.lit("")))))
    df = T.let(df, x_medical=term_counts(F.col("x_flat"), p.medical_terms), x_educational=term_counts(F.col("x_flat"), p.educational_terms))
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0), lambda a, n: a + n) >= p.minimum_matches
    out = {f"{k}_context": total(f"x_{k}") for k in ("medical", "educational")} | {f"{k}_matches": F.array_sort(F.map_keys(f"x_{k}")) for k in ("medical", "educational")}
    return df.withColumns(out).drop("x_flat", "x_medical", "x_educational")


def even_indices(count: Column, most: int) -> Column:
    """At most `most` evenly spaced indices below count, ties to even, each once."""
    if most < 1:
        raise ValueError("most must be positive")
    if most == 1:
        return F.when(count > 0, F.array(F.lit(0))).otherwise(F.expr("cast(array() as array<int>)"))
    all_of = F.when(count > 0, F.sequence(F.lit(0), (count - 1).cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))
    spread = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.bround(i * (count - 1) / F.lit(most - 1), 0).cast("int"))
    return F.when(count <= most, all_of).otherwise(F.array_distinct(spread))


def chunks(c: Column, size: int, stride: int) -> Column:
    """Overlapping windows of words; the last one reaches the end."""
    w = T.space_words(c)
    n = F.size(w)
    starts = F.when(n <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), (F.ceil((n - size) / F.lit(stride)) * stride).cast("int"), F.lit(stride)))
    return F.transform(starts, lambda i: F.array_join(F.slice(w, i + 1, size), " "))


def scorer(make: Callable[[], Scorer]) -> Callable[[Column], Column]:
    """A column function from texts to label scores, loading the model once per worker."""

    @F.pandas_udf("map<string, double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for texts in batches:
            yield pd.Series(model.score(texts.fillna("").tolist()), index=texts.index)

    return run


def predict(df: DataFrame, make: Callable[[], Scorer], size: int = 300, stride: int = 200, most: int = 5, text: str = "text") -> DataFrame:
    """Adds scores (the largest of each label over the chosen chunks, to six digits) and chunks_processed.

    A text is cut into overlapping windows of words, of which at most `most` evenly spaced ones are scored, so that a
    passage within a long text counts and the work for each text is bounded. Blank texts have no scores.
    """
    if size < 1 or stride < 1 or stride > size or most < 1:
        raise ValueError("size, stride and most must be positive, and windows must overlap or touch")

    @F.pandas_udf("map<string, double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for lists in batches:
            flat = [c for held in lists for c in held]
            scores, out, at = model.score(flat) if flat else [], [], 0
            for held in lists:
                top: dict[str, float] = {}
                for one in scores[at : at + len(held)]:
                    for label, value in one.items():
                        top[label] = max(top.get(label, 0.0), float(value))
                out.append({label: round(top[label], 6) for label in sorted(top)})
                at += len(held)
            yield pd.Series(out, index=lists.index)

    # a text is cut into words once, and only the windows that are scored are put together
    df = T.let(df, x_words=T.space_words(F.coalesce(F.col(text), F.lit(""))))
    n = F.size("x_words")
    df = T.let(df, x_at=even_indices(F.when(n == 0, 0).when(n <= size, 1).otherwise(F.ceil((n - size) / F.lit(stride)).cast("int") + 1), most))
    df = T.let(df, x_chunks=F.transform("x_at", lambda i: F.array_join(F.slice("x_words", i * stride + 1, size), " ")))
    return df.withColumns({"scores": run("x_chunks"), "chunks_processed": F.size("x_chunks")}).drop("x_words", "x_at", "x_chunks")


def snake_labels(names: dict[int, str]) -> list[str]:
    """A model's labels in the order of their numbers, as lower-case words joined by underscores."""
    return [re.sub(r"[^a-z0-9]+", "_", names[k].strip().lower()).strip("_") for k in sorted(names)]


def strongest(chunk_scores: DataFrame, key: str, label: str = "label", score: str = "score") -> DataFrame:
    """(key, scores): the largest score of each label over a document's chunks, to six digits."""
    top = chunk_scores.groupBy(key, label).agg(F.bround(F.max(score), 6).alias("s"))
    return top.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(label, "s")))).alias("scores"))


def decide(df: DataFrame, p: ToxicityPolicy, scores: str = "scores") -> DataFrame:
    """Adds decision, risk, maximum_score, maximum_label, triggered_labels and reasons to rows with scores and context."""
    of = lambda label: F.coalesce(F.element_at(F.col(scores), F.lit(label)), F.lit(0.0))
    df = T.let(df, t_list=F.array(*(F.struct(F.lit(x).alias("label"), of(x).alias("score")) for x in p.monitored)))
    top = F.array_max(F.transform("t_list", lambda x: x["score"]))
    df = T.let(df, t_top=top, t_severe=F.array_max(F.array(F.lit(0.0), *(of(x) for x in p.severe if x in p.monitored))))
    protected = (F.col("medical_context") | F.col("educational_context")) & F.lit(p.context_protects)
    low, mid = F.col("t_top") < p.review, F.col("t_top") < p.reject
    cause = F.when(low, "below_review_threshold").when(mid, "review_threshold_exceeded").when(protected, "high_score_with_protected_context").otherwise("automatic_reject_threshold_exceeded" if p.auto_reject else "automatic_rejection_disabled")
    decision = F.when(low, "pass").when(mid | protected, "review").otherwise("reject" if p.auto_reject else "review")
    notes = (F.when(F.col("medical_context"), "medical_context_detected"), F.when(F.col("educational_context"), "educational_context_detected"), F.when(F.col("t_severe") >= p.reject, "severe_label_threshold_exceeded"))
    return df.withColumns(
        {
            "decision": decision, "risk": F.when(low, "low").when(mid, "elevated").otherwise("high"), "maximum_score": F.bround("t_top", 6),
            "maximum_label": F.get(F.filter("t_list", lambda x: x["score"] == F.col("t_top")), F.lit(0))["label"],
            "triggered_labels": F.array_sort(F.transform(F.filter("t_list", lambda x: x["score"] >= p.review), lambda x: x["label"])), "reasons": F.array_compact(F.array(cause, *notes)),
        }
    ).drop("t_list", "t_top", "t_severe")
