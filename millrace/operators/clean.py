"""Record cleaning: document ids, the cleaning chain, length reasons and the stage report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import arrow as A, text as T


def document_id(source: Column, split: Column, index: Column, text: Column) -> Column:
    """source-split-index (nine digits at least)-first sixteen hex digits of the text's SHA-256."""
    return F.concat(source, F.lit("-"), split, F.lit("-"), F.format_string("%09d", index.cast("long")), F.lit("-"), F.substring(F.sha2(text, 256), 1, 16))


@dataclass(frozen=True)
class CleaningPolicy:
    """Which steps run, in their fixed order, and the accepted lengths (max_characters None: no limit)."""

    repair: bool = True
    strip_html: bool = True
    form: str = "NFKC"
    strip_controls: bool = True
    normalize_spacing: bool = True
    paragraphs: bool = True
    min_characters: int = 20
    max_characters: int | None = None

    def __post_init__(self) -> None:
        if self.form not in A.FORMS:
            raise ValueError(f"unknown Unicode form {self.form!r}")
        if self.min_characters < 0 or (self.max_characters is not None and self.max_characters < self.min_characters):
            raise ValueError("lengths must satisfy 0 <= min_characters <= max_characters")


def cleaned(c: Column, p: CleaningPolicy = CleaningPolicy()) -> Column:
    """The cleaned text: encoding repair, markup, Unicode form, controls, spacing, outer white space."""
    if p.repair:
        c = A.repair_encoding(c)
    if p.strip_html:
        c = A.remove_html(c, p.paragraphs)
    c = A.normalize(c, p.form)
    if p.strip_controls:
        c = T.strip_controls(c)
    if p.normalize_spacing:
        c = T.normalize_spacing(c, p.paragraphs)
    return T.strip(c)


def clean(df: DataFrame, p: CleaningPolicy = CleaningPolicy(), text: str = "text") -> DataFrame:
    """df with the text cleaned, cleaning (original, cleaned and removed characters) and reason (null: accepted)."""
    out = T.let(df.withColumnRenamed(text, "c_raw"), c_clean=cleaned(F.col("c_raw"), p))
    n = F.length("c_clean")
    reason = F.when(F.col("c_raw").isNull(), "invalid_text_type").when(n == 0, "empty_after_cleaning").when(n < p.min_characters, "too_short")
    if p.max_characters is not None:
        reason = reason.when(n > p.max_characters, "too_long")
    before = F.length("c_raw")
    counts = F.struct(before.cast("long").alias("original"), n.cast("long").alias("cleaned"), (before - n).cast("long").alias("removed"))
    return out.withColumns({"cleaning": counts, "reason": reason}).select(*(F.col("c_clean").alias(text) if c == text else c for c in df.columns), "cleaning", "reason")


def report(judged: DataFrame) -> DataFrame:
    """(outcome, documents, original_characters, cleaned_characters) of a cleaned frame."""
    return judged.groupBy(F.coalesce("reason", F.lit("accepted")).alias("outcome")).agg(
        F.count("*").alias("documents"), F.coalesce(F.sum("cleaning.original"), F.lit(0)).alias("original_characters"), F.coalesce(F.sum("cleaning.cleaned"), F.lit(0)).alias("cleaned_characters")
    )
