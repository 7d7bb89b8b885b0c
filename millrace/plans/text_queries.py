"""Queries on cleaning, text metrics and quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import arrow as A, text as T
from ..operators import clean, quality
from ..session import table
from .registry import DUCK_SPACE, DUCK_WORD, fold_sql, query, squash_sql

RATIO = "CASE WHEN ({d}) = 0 THEN 0.0 ELSE round_even(({n})::DOUBLE / ({d}), 6) END"


def ratio_sql(n: str, d: str) -> str:
    return RATIO.format(n=n, d=d)


@query("SELECT doc_id, source || '-train-' || lpad(doc_id::VARCHAR, 9, '0') || '-' || substr(sha256(text), 1, 16) AS id FROM documents")
def doc_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", clean.document_id(F.col("source"), F.lit("train"), F.col("doc_id"), F.col("text")).alias("id"))


CLEAN_SQL = f"""SELECT doc_id, regexp_replace(array_to_string(list_transform(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)),
    lambda x: trim(regexp_replace(x, '[\\t\\x0b\\x0c\\x1c-\\x20\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g'))), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g') AS t FROM documents"""
CLEANED_SQL = f"SELECT doc_id, regexp_replace(regexp_replace(t, '{DUCK_SPACE}+([,.;:!?])', '\\1', 'g'), '^{DUCK_SPACE}+|{DUCK_SPACE}+$', '', 'g') AS cleaned FROM ({CLEAN_SQL})"


@query(f"SELECT doc_id, sha256(cleaned) AS cleaned_sha256, length(cleaned) AS cleaned_characters FROM ({CLEANED_SQL})")
def clean_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = T.normalize_spacing(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(c, 256).alias("cleaned_sha256"), F.length(c).cast("long").alias("cleaned_characters"))


@query(f"SELECT doc_id, CASE WHEN length(cleaned) = 0 THEN 'empty_after_cleaning' WHEN length(cleaned) < 200 THEN 'too_short' WHEN length(cleaned) > 5000 THEN 'too_long' ELSE 'accepted' END AS outcome FROM ({CLEANED_SQL})")
def clean_length_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = clean.clean(table(spark, sf_dir, "documents"), clean.CleaningPolicy(min_characters=200, max_characters=5000, form="NFC", strip_html=False, repair=False))
    return judged.select("doc_id", F.coalesce("reason", F.lit("accepted")).alias("outcome"))


@query()
def clean_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.report(clean.clean(table(spark, sf_dir, "documents"), clean.CleaningPolicy()))


@query()
def html_text_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = T.normalize_spacing(A.remove_html(F.col("html")))
    return table(spark, sf_dir, "pages").select("page_id", text.alias("text")).select("page_id", F.length("text").cast("long").alias("characters"), F.sha2("text", 256).alias("text_sha256"))


@query("SELECT doc_id, sha256(t) AS stripped_sha256, length(t) AS characters FROM (SELECT doc_id, regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x{9f}]', '', 'g') AS t FROM (SELECT doc_id, replace(text, 'e', 'e' || chr(7) || chr(133)) AS text FROM documents))")
def control_char_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirty = F.replace(F.col("text"), F.lit("e"), F.lit("e\x07\x85"))
    c = T.strip_controls(dirty)
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(c, 256).alias("stripped_sha256"), F.length(c).cast("long").alias("characters"))


WORDS_SQL = f"regexp_extract_all(text, '{DUCK_WORD}')"
SENTENCES_SQL = f"""list_filter(list_transform(string_split(regexp_replace({squash_sql('text')}, '([.!?])["'')\\]]*\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"""
LINES_SQL = f"list_filter(list_transform(string_split(regexp_replace(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]', chr(10), 'g'), chr(10)), lambda x: regexp_replace(x, '^{DUCK_SPACE}+|{DUCK_SPACE}+$', '', 'g')), lambda x: x <> '')"


def repeated_sql(items: str) -> str:
    """Share of items whose value stands more than once, for a query over documents with the list expression items."""
    return f"""SELECT doc_id, {ratio_sql('sum(CASE WHEN c > 1 THEN c ELSE 0 END)', 'sum(c)')} AS share FROM (SELECT doc_id, item, count(*) AS c FROM (SELECT doc_id, unnest({items}) AS item FROM documents) GROUP BY 1, 2) GROUP BY 1"""


def _share_sql(items: str, name: str) -> str:
    return f"SELECT d.doc_id, coalesce(r.share, 0.0) AS {name} FROM documents d LEFT JOIN ({repeated_sql(items)}) r USING (doc_id)"


LINE_ITEMS = f"list_transform(list_filter(list_transform({LINES_SQL}, lambda x: {squash_sql('x')}), lambda x: len(regexp_extract_all(x, '{DUCK_WORD}')) >= 4 AND length(x) >= 20), lambda x: {fold_sql('x')})"
SENTENCE_ITEMS = f"list_transform({SENTENCES_SQL}, lambda x: {fold_sql('x')})"
FOLDED_SQL = f"list_transform({WORDS_SQL}, lambda x: {fold_sql('x')})"
# three-grams by a window rather than by list indexes: a word list per element would be squared work
NGRAM_SQL = f"""SELECT d.doc_id, coalesce(r.share, 0.0) AS repeated_ngram_ratio FROM documents d LEFT JOIN (
  SELECT doc_id, {ratio_sql('sum(CASE WHEN c > 1 THEN c ELSE 0 END)', 'sum(c)')} AS share FROM (
    SELECT doc_id, g, count(*) AS c FROM (
      SELECT doc_id, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o AS g FROM (SELECT doc_id, unnest({FOLDED_SQL}) AS w, generate_subscripts({FOLDED_SQL}, 1) AS i FROM documents) WINDOW o AS (PARTITION BY doc_id ORDER BY i)
    ) WHERE g IS NOT NULL GROUP BY 1, 2) GROUP BY 1) r USING (doc_id)"""

METRICS_SQL = f"""SELECT b.*, l.repeated_line_ratio, s.repeated_sentence_ratio, g.repeated_ngram_ratio FROM (
  SELECT doc_id, length(text) AS character_count, length(solid) AS non_whitespace_character_count, len(words) AS word_count, len(sentences) AS sentence_count, len(lines) AS line_count,
    {ratio_sql("length(array_to_string(words, ''))", "len(words)")} AS average_word_length,
    {ratio_sql("length(regexp_replace(solid, '[^\\p{L}]+', '', 'g'))", "length(solid)")} AS alphabetic_ratio,
    {ratio_sql("length(regexp_replace(solid, '[^\\p{Nd}]+', '', 'g'))", "length(solid)")} AS digit_ratio,
    {ratio_sql("length(regexp_replace(regexp_replace(solid, '[^\\p{S}\\p{P}]+', '', 'g'), '[.,;:!?''’\"\\-–—()\\[\\]{}/%]+', '', 'g'))", "length(solid)")} AS symbol_ratio,
    {ratio_sql("length(text) - length(solid)", "length(text)")} AS whitespace_ratio,
    {ratio_sql("length(regexp_replace(solid, '[^\\p{Lu}]+', '', 'g'))", "length(regexp_replace(solid, '[^\\p{L}]+', '', 'g'))")} AS uppercase_ratio,
    {ratio_sql("len(list_distinct(folded))", "len(words)")} AS unique_word_ratio,
    len(regexp_extract_all(text, '(?i)(?:https?://|www\\.)\\S+')) AS url_count,
    len(regexp_extract_all(text, '(?i)[A-Z0-9._%+\\-]+@[A-Z0-9.\\-]+\\.[A-Z]{{2,}}')) AS email_count,
    {ratio_sql("len(list_filter(words, lambda w: length(w) >= 30))", "len(words)")} AS very_long_word_ratio
  FROM (SELECT doc_id, text, regexp_replace(text, '{DUCK_SPACE}+', '', 'g') AS solid, {WORDS_SQL} AS words, {FOLDED_SQL} AS folded, {SENTENCES_SQL} AS sentences, {LINES_SQL} AS lines FROM documents)) b
  JOIN ({_share_sql(LINE_ITEMS, 'repeated_line_ratio')}) l USING (doc_id) JOIN ({_share_sql(SENTENCE_ITEMS, 'repeated_sentence_ratio')}) s USING (doc_id) JOIN ({NGRAM_SQL}) g USING (doc_id)"""

NAMES = [
    "character_count", "non_whitespace_character_count", "word_count", "sentence_count", "line_count", "average_word_length", "alphabetic_ratio", "digit_ratio", "symbol_ratio", "whitespace_ratio",
    "uppercase_ratio", "unique_word_ratio", "repeated_line_ratio", "repeated_sentence_ratio", "repeated_ngram_ratio", "url_count", "email_count", "very_long_word_ratio",
]


def _metrics(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    return quality.metrics(table(spark, sf_dir, "documents").select("doc_id", "text"), names=names).drop("text")


@query(f"SELECT doc_id, {', '.join(NAMES)} FROM ({METRICS_SQL})")
def quality_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir, *NAMES)


@query(f"SELECT doc_id, len({WORDS_SQL}) AS words, len({SENTENCES_SQL}) AS sentences, len({LINES_SQL}) AS lines, len(string_split({squash_sql('text')}, ' ')) AS space_words FROM documents")
def word_sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", *(F.size(c).cast("long").alias(n) for n, c in (("words", T.words(t)), ("sentences", T.sentences(t)), ("lines", T.lines(t)), ("space_words", F.split(T.squash(t), " ")))))


@query(f"SELECT doc_id, alphabetic_ratio, digit_ratio, symbol_ratio, whitespace_ratio, uppercase_ratio FROM ({METRICS_SQL})")
def char_class_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir, "alphabetic_ratio", "digit_ratio", "symbol_ratio", "whitespace_ratio", "uppercase_ratio")


@query(_share_sql(LINE_ITEMS, "repeated_line_ratio"))
def repeated_line_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir, "repeated_line_ratio")


@query(_share_sql(SENTENCE_ITEMS, "repeated_sentence_ratio"))
def repeated_sentence_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir, "repeated_sentence_ratio")


@query(NGRAM_SQL)
def repeated_ngram_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir, "repeated_ngram_ratio")


@query(f"SELECT doc_id, url_count, email_count FROM ({METRICS_SQL})")
def url_email_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir, "url_count", "email_count")


def decision_sql(metrics: str, p: quality.QualityPolicy) -> str:
    cost = {**quality.PENALTIES, **p.penalties}
    broken = {
        "too_few_words": f"word_count < {p.min_words}", "too_many_words": f"word_count > {p.max_words}", "too_few_sentences": f"sentence_count < {p.min_sentences}",
        "low_alphabetic_ratio": f"alphabetic_ratio < {p.min_alphabetic_ratio}", "high_digit_ratio": f"digit_ratio > {p.max_digit_ratio}", "high_symbol_ratio": f"symbol_ratio > {p.max_symbol_ratio}",
        "high_uppercase_ratio": f"uppercase_ratio > {p.max_uppercase_ratio}", "low_unique_word_ratio": f"unique_word_ratio < {p.min_unique_word_ratio}", "high_repeated_line_ratio": f"repeated_line_ratio > {p.max_repeated_line_ratio}",
        "high_repeated_sentence_ratio": f"repeated_sentence_ratio > {p.max_repeated_sentence_ratio}", "high_repeated_ngram_ratio": f"repeated_ngram_ratio > {p.max_repeated_ngram_ratio}",
        "too_many_urls": f"url_count > {p.max_urls}", "too_many_emails": f"email_count > {p.max_emails}", "high_very_long_word_ratio": f"very_long_word_ratio > {p.max_very_long_word_ratio}",
    }
    failed = "list_filter([" + ", ".join(f"CASE WHEN {broken[r]} THEN '{r}' END" for r in quality.PENALTIES) + "], lambda x: x IS NOT NULL)"
    total = " + ".join(f"CASE WHEN {broken[r]} THEN {cost[r]}::DOUBLE ELSE 0.0::DOUBLE END" for r in quality.PENALTIES)
    some = lambda rules: "len(list_intersect(failed, [" + ", ".join(f"'{r}'" for r in rules) + "])) > 0"
    return f"""SELECT *, CASE WHEN {some(p.hard_rules)} THEN 'reject' WHEN {some(p.review_rules)} THEN CASE WHEN quality_score >= {p.review_score} THEN 'review' ELSE 'reject' END
      WHEN quality_score >= {p.pass_score} THEN 'pass' WHEN quality_score >= {p.review_score} THEN 'review' ELSE 'reject' END AS quality_decision
      FROM (SELECT *, {failed} AS failed, round_even(greatest(0.0, least(1.0, 1.0 - ({total}))), 6) AS quality_score FROM ({metrics}))"""


@query(f"SELECT doc_id, quality_score, quality_decision, array_to_string(failed, ',') AS failed_rules FROM ({decision_sql(METRICS_SQL, quality.QualityPolicy())})")
def quality_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.evaluate(table(spark, sf_dir, "documents")).select("doc_id", "quality_score", "quality_decision", F.array_join("failed_rules", ",").alias("failed_rules"))


@query(f"SELECT rule, count(*) AS n FROM (SELECT unnest(failed) AS rule FROM ({decision_sql(METRICS_SQL, quality.QualityPolicy())})) GROUP BY 1")
def quality_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rule_counts(quality.evaluate(table(spark, sf_dir, "documents")))


@query(f"SELECT doc_id, a.quality_decision AS pretraining, b.quality_decision AS sft FROM ({decision_sql(METRICS_SQL, quality.PRETRAINING)}) a JOIN ({decision_sql(METRICS_SQL, quality.SFT)}) b USING (doc_id)")
def quality_profile_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = quality.metrics(table(spark, sf_dir, "documents").select("doc_id", "text"))
    first = quality.decide(m, quality.PRETRAINING).withColumnRenamed("quality_decision", "pretraining").drop("failed_rules", "quality_score")
    return quality.decide(first, quality.SFT).select("doc_id", "pretraining", F.col("quality_decision").alias("sft"))


@query(f"SELECT quality, quality_decision, count(*) AS n FROM ({decision_sql(METRICS_SQL, quality.QualityPolicy())}) JOIN labels USING (doc_id) GROUP BY 1, 2")
def quality_vs_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.evaluate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.join(table(spark, sf_dir, "labels"), "doc_id").groupBy("quality", "quality_decision").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, quality_score, array_to_string(failed, ',') AS failed_rules, substr(text, 1, 500) AS text_preview FROM ({decision_sql(METRICS_SQL, quality.QualityPolicy())}) JOIN documents USING (doc_id) WHERE quality_decision = 'reject'")
def quality_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rejected = quality.split_decisions(quality.evaluate(table(spark, sf_dir, "documents")))
    return rejected.withColumn("failed_rules", F.array_join("failed_rules", ","))
