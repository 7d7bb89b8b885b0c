"""Counts of quality metrics, next to the regular expressions of the JVM."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import quality

TEXTS = [
    "", " ", "Ein Maß, zwei MASS.  Drei? (\"vier\") fünf!  Sechs", "it’s a-b-c ' - x_1 ²Ⅻ ١٢", "see http://a.b/c?d WWW.x.y\xa0z xhttp://no ftp://q https://", "a.b@c.de, x@y, é@f.org b@c.dee @ A_B@C.DE9",
    "one line that is long\r\none  line that\tis LONG\x85\x0bshort one two three four five six", "a b c a b c a b", "ΑΣ ΑΣ. σας! İ", "\U0001d400 \U0001f600 $€% #–—", "w" * 30 + " " + "v" * 29, "x\x00y\x1cz",
]


def test_counts(spark):
    df = spark.createDataFrame([*enumerate(TEXTS), (99, None)], "i int, text string")
    t = F.coalesce("text", F.lit(""))
    solid = F.regexp_replace(t, f"{T.SPACE}+", "")
    size = lambda keep: F.length(F.regexp_replace(solid, keep, ""))
    want = df.select(
        "i", F.length(t).alias("character_count"), F.length(solid).alias("non_whitespace_character_count"), F.size(T.words(t)).alias("word_count"), F.size(T.sentences(t)).alias("sentence_count"), F.size(T.lines(t)).alias("line_count"),
        F.regexp_count(t, F.lit(T.URL)).alias("url_count"), F.regexp_count(t, F.lit(T.EMAIL)).alias("email_count"), T.ratio(size(r"[^\p{L}]+"), F.length(solid)).alias("alphabetic_ratio"),
        T.ratio(size(r"[^\p{Nd}]+"), F.length(solid)).alias("digit_ratio"), T.ratio(size(rf"[^\p{{S}}\p{{P}}]+|[{T.PROSE}]+"), F.length(solid)).alias("symbol_ratio"), T.ratio(size(r"[^\p{Lu}]+"), size(r"[^\p{L}]+")).alias("uppercase_ratio"),
        T.ratio(F.size(F.array_distinct(F.transform(T.words(t), T.fold))), F.size(T.words(t))).alias("unique_word_ratio"),
    )
    got = {r.i: r for r in quality.metrics(df).collect()}
    for r in want.collect():
        assert {k: v for k, v in got[r.i].asDict().items() if k in r.asDict()} == r.asDict(), TEXTS[r.i]
    assert got[6].repeated_line_ratio == pytest.approx(2 / 3, abs=1e-6) and got[7].repeated_ngram_ratio == 1.0 and got[10].very_long_word_ratio == 0.5


def test_only_what_is_asked_for_is_counted(spark):
    assert quality.metrics(spark.createDataFrame([("a@b.cd",)], "text string"), names=("email_count",)).first().asDict() == {"text": "a@b.cd", "email_count": 1}
    found = quality.counts("a b c a b c", frozenset({"words"}), 3, 30)
    assert found["words"] == 6 and found["grams"] == found["distinct"] == 0
