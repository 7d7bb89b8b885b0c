"""Explainable quality rules: metrics, rule evaluation, penalties, decisions and profiles."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import cache
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from ..session import ship

#: Rules in their order, with the penalties that hold if none are configured.
PENALTIES = {
    "too_few_words": 0.40, "too_many_words": 0.25, "too_few_sentences": 0.10, "low_alphabetic_ratio": 0.35, "high_digit_ratio": 0.15, "high_symbol_ratio": 0.30, "high_uppercase_ratio": 0.15,
    "low_unique_word_ratio": 0.20, "high_repeated_line_ratio": 0.10, "high_repeated_sentence_ratio": 0.20, "high_repeated_ngram_ratio": 0.25, "too_many_urls": 0.10, "too_many_emails": 0.10, "high_very_long_word_ratio": 0.15,
}
#: The rules whose failure rejects, and those whose failure asks for a review.
HARD = ("too_few_words", "too_many_words", "low_alphabetic_ratio", "high_symbol_ratio")
REVIEW = ("high_repeated_line_ratio", "high_repeated_sentence_ratio", "high_repeated_ngram_ratio", "low_unique_word_ratio", "high_digit_ratio", "high_uppercase_ratio", "too_many_urls", "too_many_emails", "high_very_long_word_ratio")


@dataclass(frozen=True)
class QualityPolicy:
    """Thresholds, rule classes and penalties; checked when it is made."""

    pass_score: float = 0.80
    review_score: float = 0.60
    min_words: int = 20
    max_words: int = 20000
    min_sentences: int = 2
    min_alphabetic_ratio: float = 0.55
    max_digit_ratio: float = 0.30
    max_symbol_ratio: float = 0.20
    max_uppercase_ratio: float = 0.40
    min_unique_word_ratio: float = 0.12
    max_repeated_line_ratio: float = 0.30
    max_repeated_sentence_ratio: float = 0.30
    max_repeated_ngram_ratio: float = 0.40
    repeated_ngram_size: int = 3
    max_urls: int = 20
    max_emails: int = 10
    max_very_long_word_ratio: float = 0.05
    very_long_word_length: int = 30
    hard_rules: tuple[str, ...] = HARD
    review_rules: tuple[str, ...] = REVIEW
    penalties: Mapping[str, float] = field(default_factory=lambda: {"low_unique_word_ratio": 0.10, "high_repeated_ngram_ratio": 0.15})

    def __post_init__(self) -> None:
        for name, value in vars(self).items():
            if (name.endswith("_ratio") or name.endswith("_score")) and not 0 <= value <= 1:
                raise ValueError(f"{name} must lie between 0 and 1")
            if isinstance(value, int) and value < 0:
                raise ValueError(f"{name} must not be negative")
        if self.min_words > self.max_words or self.review_score > self.pass_score:
            raise ValueError("a lower bound exceeds its upper bound")
        if self.repeated_ngram_size < 1 or self.very_long_word_length < 1:
            raise ValueError("sizes must be positive")

    def profile(self, **changes) -> QualityPolicy:
        """Another policy; lists that are given replace the old ones whole."""
        return replace(self, **changes)


PRETRAINING = QualityPolicy(max_words=100000)
SFT = QualityPolicy(min_words=3, min_sentences=0, min_alphabetic_ratio=0.35, max_symbol_ratio=0.35, hard_rules=("too_many_words", "low_alphabetic_ratio", "high_symbol_ratio"))


#: The metrics, and the parts of COUNTS that each is made from.
METRICS = {
    "character_count": ("chars",), "non_whitespace_character_count": ("chars", "spaces"), "word_count": ("words",), "sentence_count": ("sentences",), "line_count": ("lines",),
    "average_word_length": ("word_chars", "words"), "alphabetic_ratio": ("letters", "chars", "spaces"), "digit_ratio": ("digits", "chars", "spaces"), "symbol_ratio": ("symbols", "chars", "spaces"), "whitespace_ratio": ("spaces", "chars"), "uppercase_ratio": ("uppers", "letters"),
    "unique_word_ratio": ("distinct", "words"), "repeated_line_ratio": ("line_copies", "real_lines"), "repeated_sentence_ratio": ("sentence_copies", "sentences"), "repeated_ngram_ratio": ("gram_copies", "grams"),
    "url_count": ("urls",), "email_count": ("emails",), "very_long_word_ratio": ("long_words", "words"),
}
COUNTS = tuple(dict.fromkeys(p for parts in METRICS.values() for p in parts))
_WORD = re.compile(r"\w+(?:['’\-]\w+)*")
_SENTENCE_END = re.compile(r"(?<=[.!?])[\"')\]]* +")
_URL = re.compile(r"(?<!\w)(?:[hH][tT][tT][pP][sS]?://|[wW]{3}\.)[^ \t-\r]+")
_EMAIL = re.compile(r"(?<!\w)[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}(?!\w)")
_PROSE = frozenset(".,;:!?'’\"-–—()[]{}/%")


@cache
def _classes() -> np.ndarray:
    """The class of every character: 1 white space, 2 letter, 3 capital letter, 4 digit, 5 symbol or mark that is no prose, 0 other."""

    def of(x: str) -> int:
        c = unicodedata.category(x)
        return 1 if x.isspace() else 3 if c == "Lu" else 2 if c[0] == "L" else 4 if c == "Nd" else 5 if c[0] in "SP" and x not in _PROSE else 0

    return np.array([of(chr(i)) for i in range(sys.maxunicode + 1)], np.uint8)


def _fold(text: str) -> str:
    return text.lower().replace("ß", "ss")


def _copies(items: Iterable) -> int:
    """How many items have an equal one."""
    return sum(n for n in Counter(items).values() if n > 1)


def counts(text: str, wanted: frozenset[str], ngram: int, long_word: int) -> dict[str, int]:
    """The wanted ones of COUNTS."""
    out = dict.fromkeys(COUNTS, 0)
    out["chars"] = len(text)
    if wanted & {"spaces", "letters", "digits", "symbols", "uppers"}:
        n = np.bincount(_classes()[np.frombuffer(text.encode("utf-32-le"), np.uint32)], minlength=6).tolist()
        out |= {"spaces": n[1], "letters": n[2] + n[3], "uppers": n[3], "digits": n[4], "symbols": n[5]}
    if wanted & {"words", "word_chars", "distinct", "gram_copies", "grams", "long_words"}:
        words = _WORD.findall(text)
        out |= {"words": len(words), "word_chars": sum(map(len, words)), "long_words": sum(len(w) >= long_word for w in words)}
        # a line end is no part of a word, so all are folded at once
        folded = _fold("\n".join(words)).split("\n") if words and wanted & {"distinct", "gram_copies", "grams"} else []
        out["distinct"] = len(set(folded))
        if wanted & {"gram_copies", "grams"} and len(folded) >= ngram:
            out |= {"grams": len(folded) - ngram + 1, "gram_copies": _copies(zip(*(folded[k:] for k in range(ngram)), strict=False))}
    if wanted & {"sentences", "sentence_copies"}:
        sentences = [t for s in _SENTENCE_END.split(" ".join(text.split())) if (t := s.strip(" "))]
        out |= {"sentences": len(sentences), "sentence_copies": _copies(map(_fold, sentences)) if "sentence_copies" in wanted else 0}
    if wanted & {"lines", "real_lines", "line_copies"}:
        lines = [x for s in text.splitlines() if (x := s.strip())]
        out["lines"] = len(lines)
        if wanted & {"real_lines", "line_copies"}:
            flat = (" ".join(x.split()) for x in lines)
            real = [x for x in flat if len(x) >= 20 and len(list(islice(_WORD.finditer(x), 4))) == 4]
            out |= {"real_lines": len(real), "line_copies": _copies(map(_fold, real))}
    if "urls" in wanted and ("://" in text or "www." in text.lower()):
        out["urls"] = len(_URL.findall(text))
    if "emails" in wanted and "@" in text:
        out["emails"] = len(_EMAIL.findall(text))
    return out


def _counted(c: Column, names: Sequence[str], ngram: int, long_word: int) -> Column:
    wanted = frozenset(p for n in names for p in METRICS[n])
    made = [n for n in COUNTS if n in wanted]

    @F.pandas_udf(", ".join(f"{n} long" for n in made))
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = (counts(t or "", wanted, ngram, long_word) for t in texts)
        return pd.DataFrame([[r[n] for n in made] for r in rows], columns=made)

    return run(c)


def metrics(df: DataFrame, text: str = "text", ngram: int = 3, long_word: int = 30, names: Sequence[str] = tuple(METRICS)) -> DataFrame:
    """df with the metrics of its text column, all eighteen or the named ones; a null text counts as empty.

    Counts come from one pass in Python, several times as fast as regular expressions and lambdas over arrays in the JVM;
    ratios are rounded in the JVM.
    """
    ship(df.sparkSession)
    keep = df.columns
    df = T.let(df, m=_counted(F.col(text), names, ngram, long_word))
    out = []
    for name in names:
        first, *rest = (F.col(f"m.{p}") for p in METRICS[name])
        if name == "non_whitespace_character_count":
            c = first - rest[0]
        elif name.endswith("_count"):
            c = first
        else:
            c = T.ratio(first, rest[0] - rest[1] if len(rest) == 2 else rest[0])
        out.append(c.alias(name))
    return df.select(*keep, *out)


def failed_rules(p: QualityPolicy) -> Column:
    """The rules that the metric columns break, in order."""
    c = F.col
    broken = {
        "too_few_words": c("word_count") < p.min_words, "too_many_words": c("word_count") > p.max_words, "too_few_sentences": c("sentence_count") < p.min_sentences,
        "low_alphabetic_ratio": c("alphabetic_ratio") < p.min_alphabetic_ratio, "high_digit_ratio": c("digit_ratio") > p.max_digit_ratio, "high_symbol_ratio": c("symbol_ratio") > p.max_symbol_ratio,
        "high_uppercase_ratio": c("uppercase_ratio") > p.max_uppercase_ratio, "low_unique_word_ratio": c("unique_word_ratio") < p.min_unique_word_ratio,
        "high_repeated_line_ratio": c("repeated_line_ratio") > p.max_repeated_line_ratio, "high_repeated_sentence_ratio": c("repeated_sentence_ratio") > p.max_repeated_sentence_ratio,
        "high_repeated_ngram_ratio": c("repeated_ngram_ratio") > p.max_repeated_ngram_ratio, "too_many_urls": c("url_count") > p.max_urls, "too_many_emails": c("email_count") > p.max_emails,
        "high_very_long_word_ratio": c("very_long_word_ratio") > p.max_very_long_word_ratio,
    }
    return F.array_compact(F.array(*(F.when(broken[rule], F.lit(rule)) for rule in PENALTIES)))


def decide(df: DataFrame, p: QualityPolicy = QualityPolicy()) -> DataFrame:
    """Adds failed_rules, quality_score and quality_decision (pass, review, reject) to rows with metrics."""
    cost = {**PENALTIES, **p.penalties}
    table = F.create_map(*(F.lit(x) for kv in cost.items() for x in kv))
    df = T.let(df, failed_rules=failed_rules(p))
    total = F.aggregate("failed_rules", F.lit(0.0), lambda a, r: a + F.coalesce(F.element_at(table, r), F.lit(0.05)))
    df = df.withColumn("quality_score", F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - total)), 6))
    any_of = lambda rules: F.arrays_overlap("failed_rules", F.array(*map(F.lit, rules))) if rules else F.lit(False)
    good, fair = F.col("quality_score") >= p.pass_score, F.col("quality_score") >= p.review_score
    decision = F.when(any_of(p.hard_rules), "reject").when(any_of(p.review_rules), F.when(fair, "review").otherwise("reject")).when(good, "pass").when(fair, "review").otherwise("reject")
    return df.withColumn("quality_decision", decision)


def evaluate(df: DataFrame, p: QualityPolicy = QualityPolicy(), text: str = "text") -> DataFrame:
    return decide(metrics(df, text, p.repeated_ngram_size, p.very_long_word_length), p)


def split_decisions(judged: DataFrame, preview: int = 500) -> tuple[DataFrame, DataFrame]:
    """Rows that are kept (pass and review), and an inspection table of the rejected ones with a preview."""
    rejected = judged.where("quality_decision = 'reject'").select("doc_id", "quality_score", "failed_rules", F.substring("text", 1, preview).alias("text_preview"))
    return judged.where("quality_decision <> 'reject'"), rejected


def rule_counts(judged: DataFrame) -> DataFrame:
    """(rule, n) over all rows."""
    return judged.select(F.explode("failed_rules").alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))
