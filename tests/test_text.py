"""Cleaning and quality metrics against literal cases and plain Python."""

import re
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.functions import arrow as A, text as T
from millrace.operators import clean, quality

WORD = re.compile(r"[\w]+(?:['’\-][\w]+)*")


def values(spark, texts, column):
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    return [r.v for r in df.select("i", column(F.col("text")).alias("v")).orderBy("i").collect()]


ODD = ["", "  ", "a\tb c d", "x\r\ny\rz\n\n\n\nw", "Hello , world ! ok", "one\n, two", "\x1c a \x85 b", "Don't stop-gap ’tis", "Straße ÉCOLE", 'He said "go." Then (left.) Now? yes', "﻿mark"]


def test_white_space_and_words_are_those_of_python(spark):
    assert values(spark, ODD, T.squash) == [" ".join(t.split()) for t in ODD]
    assert values(spark, ODD, T.words) == [WORD.findall(t) for t in ODD]
    assert values(spark, ODD, T.strip) == [t.strip() for t in ODD]
    assert values(spark, ODD, T.lines) == [[x.strip() for x in t.splitlines() if x.strip()] for t in ODD]


def test_spacing(spark):
    def plain(t):
        t = t.replace("\r\n", "\n").replace("\r", "\n")
        t = "\n".join(re.sub(r"[^\S\r\n]+", " ", x).strip() for x in t.split("\n"))
        return re.sub(r"\s+([,.;:!?])", r"\1", re.sub(r"\n{3,}", "\n\n", t)).strip()

    assert values(spark, ODD, T.normalize_spacing) == [plain(t) for t in ODD]


def test_controls_forms_and_folding(spark):
    texts = ["a\x00b\x07c\n\t\r\x7f\x9f", "ﬁ①é", "ẞß ΑΣ", "plain"]
    keep = lambda t: "".join(c for c in t if c in "\n\r\t" or unicodedata.category(c) != "Cc")
    assert values(spark, texts, T.strip_controls) == [keep(t) for t in texts]
    for form in A.FORMS:
        assert values(spark, texts, lambda c, form=form: A.normalize(c, form)) == [unicodedata.normalize(form, t) for t in texts]
    assert values(spark, texts, A.casefold) == [t.casefold() for t in texts]
    with pytest.raises(ValueError):
        A.normalize(F.col("text"), "NFX")


def test_markup_and_repair(spark):
    assert A.html_text("a &amp; b") == "a & b"
    assert A.html_text("<p>One</p><script>x()</script><style>y</style><p>Two &lt;3</p>") == "One\nTwo <3"
    assert A.repaired("FranÃ§ais") == "Français" and A.repaired("Français") == "Français" and A.repaired("漢字") == "漢字"


def test_clean_reasons(spark):
    df = spark.createDataFrame([(1, None), (2, " \n"), (3, "short"), (4, "x" * 30), (5, "<p>long enough text &amp; more</p>")], "doc_id long, text string")
    rows = {r.doc_id: r for r in clean.clean(df, clean.CleaningPolicy(max_characters=29)).collect()}
    assert [rows[i].reason for i in range(1, 6)] == ["invalid_text_type", "empty_after_cleaning", "too_short", "too_long", None]
    assert rows[5].text == "long enough text & more" and rows[5].cleaning.original == 34
    with pytest.raises(ValueError):
        clean.CleaningPolicy(min_characters=5, max_characters=1)


def metrics(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r for r in quality.metrics(df).orderBy("doc_id").collect()]


def test_repeated_shares(spark):
    a, b, c, d = metrics(spark, "Alpha. Beta! Alpha.", "Notes\n1990\nNotes\n1990", "This is a long enough line.\nAnother line\nthis is a LONG enough line.\nOne more line that is long.", "a b c a b c")
    assert a.repeated_sentence_ratio == 0.666667 or a.sentence_count == 3
    assert b.repeated_line_ratio == 0.0
    assert c.repeated_line_ratio == 0.666667
    words = "a b c a b c".split()
    grams = Counter(tuple(words[i : i + 3]) for i in range(4))
    assert d.repeated_ngram_ratio == sum(n for n in grams.values() if n > 1) / 4


def test_empty_and_null_metrics(spark):
    for r in metrics(spark, "", None):
        assert (r.character_count, r.word_count, r.unique_word_ratio, r.repeated_ngram_ratio) == (0, 0, 0.0, 0.0)


def test_urls_and_mail(spark):
    (r,) = metrics(spark, "see https://a.b/c, WWW.x.org and me@x.org or a.b@c.de.")
    assert (r.url_count, r.email_count) == (2, 2)


def test_decisions(spark):
    good = " ".join(f"word{i}" for i in range(30)) + ". And a second sentence."
    rows = spark.createDataFrame([(1, good), (2, "too few"), (3, good + " ### $$$ ^^^ ~~~ ===" * 30), (4, "HELLO AGAIN " * 3 + good.upper())], "doc_id long, text string")
    out = {r.doc_id: r for r in quality.evaluate(rows).collect()}
    assert out[1].quality_decision == "pass" and out[1].failed_rules == [] and out[1].quality_score == 1.0
    assert out[2].quality_decision == "reject" and out[2].failed_rules[0] == "too_few_words"
    assert "high_symbol_ratio" in out[3].failed_rules and out[3].quality_decision == "reject"
    assert "high_uppercase_ratio" in out[4].failed_rules and out[4].quality_decision == "review"
    kept, rejected = quality.split_decisions(quality.evaluate(rows))
    assert kept.count() == 2 and rejected.count() == 2
    for bad in ({"min_words": 9, "max_words": 3}, {"pass_score": 1.5}, {"repeated_ngram_size": 0}, {"max_urls": -1}):
        with pytest.raises(ValueError):
            quality.QualityPolicy(**bad)
