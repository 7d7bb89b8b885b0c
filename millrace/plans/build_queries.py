"""Queries on builds, standardizers, selection and scoring by chunks."""

from __future__ import annotations

from collections.abc import Sequence

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import dedup, minhash, select, sft, toxicity
from ..scratch import Scratch
from ..session import table
from ..sources import standardize
from . import builds
from .assembly_queries import CHATS, DOCS, PLAIN, _chats, _docs
from .registry import DUCK_SPACE, query, squash_sql

# one conversation in the fields of each instruction source
SHAPES = {
    "alpaca": {"instruction": "instruction", "output": "response"}, "chatdoctor": {"question": "instruction", "answer": "response"}, "medalpaca": {"prompt": "instruction", "context": "response", "response": "response"},
    "medinstruct": {"question": "instruction", "input": "' '", "claude-2": "response"}, "openmedinstruct": {"query": "instruction", "input": "'given ' || conv_id", "answer": "response"}, "pubmedqa": {"question": "instruction", "long_answer": "response", "final_decision": "'maybe'"},
}
_ASK, _REPLY = "'Instruction:' || chr(10) || instruction", "chr(10) || chr(10) || 'Response:' || chr(10)"
_INPUT = "chr(10) || chr(10) || 'Input:' || chr(10)"
BODIES = {
    "alpaca": f"{_ASK} || {_REPLY} || response", "chatdoctor": f"{_ASK} || {_REPLY} || response", "medalpaca": f"{_ASK} || {_INPUT} || response || {_REPLY} || response", "medinstruct": f"{_ASK} || {_REPLY} || response",
    "openmedinstruct": f"{_ASK} || {_INPUT} || 'given ' || conv_id || {_REPLY} || response", "pubmedqa": f"{_ASK} || {_REPLY} || 'maybe' || chr(10) || chr(10) || response",
}
#: The document type of each instruction source.
KINDS = {"alpaca": "alpaca_instruction", "chatdoctor": "medical_dialogue_sft", "medalpaca": "medical_flashcard_sft", "medinstruct": "medical_instruction_sft", "openmedinstruct": "open_medical_instruction_sft", "pubmedqa": "biomedical_qa"}
_ID = "source || '-train-' || printf('%09d', i) || '-' || substr(sha256(text), 1, 16)"


@query(" UNION ALL ".join(f"SELECT {_ID} AS id, source, '{KINDS[n]}' AS document_type, sha256(text) AS text_sha256 FROM (SELECT '{n}' AS source, conv_id AS i, {b} AS text FROM ({CHATS}))" for n, b in BODIES.items()))
def standardized_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The instruction sources' standardizers, each on the conversations in its own fields."""
    # saved, as every source reads them and asks for each side several times
    chats, out = Scratch(spark, "chats").save(_chats(spark, sf_dir).select("conv_id", "instruction", "response"), "chats"), None
    for name, shape in SHAPES.items():
        rows = chats.select(F.col("conv_id").alias("source_index"), *(F.expr(e).alias(c) for c, e in shape.items()))
        made = standardize.standardize(rows, standardize.Source(name, name))
        made = made.select("id", "source", F.col("metadata")["document_type"].alias("document_type"), F.sha2("text", 256).alias("text_sha256"))
        out = made if out is None else out.union(made)
    return out


LETTER = "CASE doc_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE 'D' END"
STRIPPED = f"regexp_replace(text, '^{DUCK_SPACE}+|{DUCK_SPACE}+$', '', 'g')"


@query(f"""SELECT doc_id, sha256('Instruction:' || chr(10) || t || chr(10) || chr(10) || 'Options:' || chr(10) || 'A. ' || lang || chr(10) || 'B. ' || source || chr(10) || 'C. c' || chr(10) || 'D. d' || chr(10) || chr(10) || 'Response:' || chr(10) || {LETTER} || '. '
  || CASE doc_id % 4 WHEN 0 THEN lang WHEN 1 THEN source WHEN 2 THEN 'c' ELSE 'd' END || CASE WHEN doc_id % 3 = 0 THEN chr(10) || chr(10) || 'Explanation: because' ELSE '' END) AS text_sha256 FROM (SELECT *, {STRIPPED} AS t FROM documents) WHERE doc_id % 5 < 4 AND t <> ''""")
def standardized_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiple-choice questions with made options; the answer number 4 doesn't count."""
    d = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select(
        d.alias("source_index"), F.col("text").alias("question"), F.col("lang").alias("opa"), F.col("source").alias("opb"), F.lit("c").alias("opc"), F.lit(" d ").alias("opd"),
        F.when(d % 5 < 4, d % 4).otherwise(4).cast("int").alias("cop"), F.when(d % 3 == 0, "because").alias("exp"),
    )
    made = standardize.standardize(docs, standardize.Source("medmcqa", "m"))
    return made.select(F.col("metadata")["source_index"].cast("long").alias("doc_id"), F.sha2("text", 256).alias("text_sha256"))


FOLD = squash_sql("regexp_replace(text, '[<>&\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g')")


@query(f"""SELECT doc_id, sha256('Study ' || doc_id || ' of ' || lang || chr(10) || chr(10) || 'AIM: we see it' || CASE WHEN t = '' THEN '' ELSE chr(10) || t END) AS abstract_sha256, sha256('T' || doc_id || chr(10) || chr(10) || 'one two three' || CASE WHEN t = '' THEN '' ELSE chr(10) || chr(10) || t END) AS article_sha256,
  CASE doc_id % 4 WHEN 0 THEN 'cc0-1.0' WHEN 1 THEN 'cc-by-4.0' WHEN 2 THEN 'cc-by-nc' ELSE 'unknown' END AS license FROM (SELECT doc_id, lang, {FOLD} AS t FROM documents)""")
def standardized_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations and articles with nested markup around every document's text."""
    clean = F.regexp_replace("text", r"[<>&\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("doc_id").alias("source_index"), standardize.T.squash(clean).alias("t"))
    said = F.element_at(F.array(F.lit("CC0"), F.lit("see creativecommons.org/licenses/by/4.0/"), F.lit("creativecommons.org/licenses/by-nc-nd/4.0"), F.lit("ask us")), (F.col("doc_id") % 4 + 1).cast("int"))
    citation = F.format_string("<PubmedArticle><PMID>%d</PMID><ArticleTitle>Study <b>%d</b> of %s</ArticleTitle><Abstract><AbstractText Label='AIM'>we <i>see</i> it</AbstractText><AbstractText>%s</AbstractText></Abstract></PubmedArticle>", "doc_id", "doc_id", "lang", "t")
    article = F.format_string("<article><article-title>T%d</article-title><permissions><license><p>%s</p></license></permissions><body><p>one <i>two</i> three</p><p>%s</p></body></article>", F.col("doc_id"), said, F.col("t"))
    sides = []
    for name, xml in (("pubmed_abstracts", citation), ("pmc_open_access", article)):
        made = standardize.standardize(docs.select("source_index", xml.alias("xml")), standardize.Source(name, "x"))
        sides.append(made.select(F.col("metadata")["source_index"].cast("long").alias("doc_id"), F.sha2("text", 256).alias("h"), "license"))
    return sides[0].select("doc_id", F.col("h").alias("abstract_sha256")).join(sides[1].select("doc_id", F.col("h").alias("article_sha256"), "license"), "doc_id")


PHASE = "SELECT doc_id, source, tokens, sum(tokens) OVER (PARTITION BY source ORDER BY doc_id) AS total, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM ({rows}) WHERE source IN ('src1', 'src2', 'src3')"
ONE = f"SELECT doc_id, source FROM ({PHASE.format(rows=DOCS)}) WHERE rn = 1 OR total <= 6000"
TWO = PHASE.format(rows=f"SELECT * FROM ({DOCS}) WHERE doc_id NOT IN (SELECT doc_id FROM ({ONE}))")


@query(f"SELECT doc_id, source, 'one' AS phase FROM ({ONE}) UNION ALL SELECT doc_id, source, 'two' FROM ({TWO}) WHERE rn = 1 OR total <= 4000")
def phase_corpora(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two phases with token budgets; the second passes over what the first took."""
    docs, names = _docs(spark, sf_dir), ("src1", "src2", "src3")
    one, _ = builds.phase_rows(docs, builds.Phase(names, dict.fromkeys(names, 6000)), docs.where("false"))
    two, _ = builds.phase_rows(docs, builds.Phase(names, dict.fromkeys(names, 4000)), one)
    return one.select("doc_id", "source", F.lit("one").alias("phase")).union(two.select("doc_id", "source", F.lit("two")))


JUDGED = """SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'validation' WHEN doc_id % 10 = 1 THEN 'test' ELSE 'train' END AS output_split, row_number() OVER (PARTITION BY doc_id % 10 = 0, doc_id % 10 = 1 ORDER BY doc_id) AS rn,
  doc_id % 7 <> 3 AND doc_id % 4 <> 1 AND trim(text) <> '' AS taken FROM documents"""


@query(f"SELECT output_split, 'd-' || output_split AS dataset, 'train' AS source_split, count(*) AS input_documents, count(*) FILTER (taken) AS output_documents, count(*) FILTER (NOT taken) AS excluded_documents FROM ({JUDGED}) WHERE rn <= 600 GROUP BY 1")
def corpus_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The final corpus's report over three inputs with decisions and a limit for each."""
    d = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", d.alias("ord"), "text", F.when(d % 7 == 3, "reject").otherwise("pass").alias("quality_decision"), F.when(d % 4 == 1, "review").otherwise("pass").alias("license_decision"))
    parts = {"validation": d % 10 == 0, "test": d % 10 == 1, "train": d % 10 > 1}
    inputs = [builds.Input(f"d-{s}", "train", s, docs.where(c)) for s, c in parts.items()]
    return builds.corpus_report(builds.judged_inputs(inputs, builds.CorpusBuild("exclude", 600)))


@query("SELECT source, count(*) AS examples, array_to_string(list_sort(list(DISTINCT lang)), ',') AS licenses, count(*) FILTER (doc_id % 6 < 3) AS passed, count(*) FILTER (doc_id % 6 = 3 AND source < 'src2') AS reviewed, count(*) FILTER (doc_id % 6 > 2 AND NOT (doc_id % 6 = 3 AND source < 'src2')) AS invalid, CASE WHEN count(*) FILTER (doc_id % 6 = 3 AND source < 'src2') > 0 THEN 'requires_manual_review' ELSE 'not_assessed_by_dataset_license_gate' END AS release_status FROM documents GROUP BY 1")
def license_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    said = F.when(d % 6 < 3, "pass").when((d % 6 == 3) & (F.col("source") < "src2"), "review")
    out = select.license_summary(table(spark, sf_dir, "documents").withColumn("license_decision", said), license_="lang")
    return out.withColumn("licenses", F.array_join("licenses", ","))


@query("SELECT user_id % 20 AS run, count(*) FILTER (event_id % 3 = 1 AND event_id % 2 = 0) AS correct, count(*) FILTER (event_id % 3 = 1) AS supervised, round_even(count(*) FILTER (event_id % 3 = 1 AND event_id % 2 = 0)::DOUBLE / count(*) FILTER (event_id % 3 = 1), 6) AS accuracy FROM events GROUP BY 1")
def response_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event is an example of two labels, of which the second is supervised for every third."""
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("run"), F.array(F.when(e % 2 == 0, 7).otherwise(8), F.lit(0)).alias("predictions"), F.array(F.lit(-100), F.when(e % 3 == 1, 7).otherwise(-100)).alias("labels"))
    return select.response_accuracy(rows, "run")


CANDIDATES = "SELECT 'run-' || user_id AS checkpoint, round_even(avg(value) / 50, 6) AS loss, round_even(min(value) / 100, 6) AS medical, round_even(max(value) / 100, 6) AS general FROM events GROUP BY user_id"


@query(f"SELECT checkpoint, loss FROM ({CANDIDATES}) WHERE loss < 1.2 AND exp(medical - 0.3) - 1 <= 0.9 AND exp(general - 0.9) - 1 <= 9 ORDER BY loss, checkpoint LIMIT 1")
def candidate_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda c, by: F.bround(c / by, 6)
    runs = table(spark, sf_dir, "events").groupBy(F.concat(F.lit("run-"), "user_id").alias("checkpoint")).agg(at(F.avg("value"), 50).alias("loss"), at(F.min("value"), 100).alias("medical"), at(F.max("value"), 100).alias("general"))
    judged = select.bands(runs, {"loss": 1.2, "medical": 0.3, "general": 0.9}, {"medical": 0.9, "general": 9.0}, {"medical": 2.0, "general": 20.0})
    return select.best_candidate(judged)


@query("SELECT source AS dataset, split, row_number() OVER (ORDER BY CASE split WHEN 'test' THEN 0 WHEN 'train' THEN 2 ELSE 1 END, source, split) AS position FROM (SELECT DISTINCT source, CASE doc_id % 4 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' WHEN 2 THEN 'extra' ELSE 'train' END AS split FROM documents)")
def stage_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id") % 4
    pairs = table(spark, sf_dir, "documents").select(F.col("source").alias("dataset"), F.when(d == 0, "test").when(d == 1, "validation").when(d == 2, "extra").otherwise("train").alias("split")).distinct()
    return select.stage_order(pairs)


@query(f"SELECT a.source, a.l AS \"left\", b.l AS \"right\", round_even(b.l - a.l, 6) AS difference, round_even(exp(b.l - a.l) - 1, 6) AS perplexity_change FROM (SELECT source, round_even(avg(tokens) / 100, 6) AS l FROM ({DOCS}) WHERE doc_id // 40 % 2 = 0 GROUP BY 1) a JOIN (SELECT source, round_even(avg(tokens) / 100, 6) AS l FROM ({DOCS}) WHERE doc_id // 40 % 2 = 1 GROUP BY 1) b USING (source)")
def source_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    sides = [docs.where(F.floor(F.col("doc_id") / 40) % 2 == k).groupBy("source").agg(F.bround(F.avg("tokens") / 100, 6).alias("l")) for k in (0, 1)]
    return select.compared(*sides, "source", "l")


class LongWords:
    """A stand-in model: the share of words above six characters, and of those that begin with a vowel."""

    def score(self, texts: Sequence[str]) -> list[dict[str, float]]:
        out = []
        for t in texts:
            w = t.split(" ")
            out.append({"toxic": sum(len(x) > 6 for x in w) / len(w), "insult": sum(x[:1] in "aeiou" for x in w) / len(w)})
        return out


WINDOWS = f"""SELECT doc_id, i, n, (SELECT max(k) FROM (SELECT unnest(range(0, greatest(1, ceil((n - 50) / 30.0)::INT + 1))) AS k)) + 1 AS c, list_slice(w, i * 30 + 1, i * 30 + 50) AS w
  FROM (SELECT doc_id, w, len(w) AS n, unnest(range(0, greatest(1, ceil((len(w) - 50) / 30.0)::INT + 1))) AS i FROM (SELECT doc_id, string_split({squash_sql('text')}, ' ') AS w FROM documents WHERE {squash_sql('text')} <> ''))"""


@query(f"""SELECT doc_id, count(*) AS chunks_processed, max(round_even(len(list_filter(w, lambda x: length(x) > 6))::DOUBLE / len(w), 6)) AS toxic, max(round_even(len(list_filter(w, lambda x: contains('aeiou', x[1])))::DOUBLE / len(w), 6)) AS insult
  FROM ({WINDOWS}) WHERE c <= 4 OR i IN (0, round_even((c - 1) / 3.0, 0), round_even(2 * (c - 1) / 3.0, 0), c - 1) GROUP BY 1""")
def toxicity_by_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.predict(table(spark, sf_dir, "documents").select("doc_id", "text"), LongWords, 50, 30, 4).where("chunks_processed > 0")
    return out.select("doc_id", F.col("chunks_processed").cast("long").alias("chunks_processed"), F.col("scores")["toxic"].alias("toxic"), F.col("scores")["insult"].alias("insult"))


@query()
def minhash_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = dedup.shingles(table(spark, sf_dir, "documents"), "doc_id")
    return minhash.candidates(minhash.signatures(sets, "doc_id"), "doc_id", 0.7)


@query(f"SELECT split, reason, count(*) AS n FROM (SELECT CASE WHEN h < '{sft._edge(0.5)}' THEN 'validation' ELSE 'train' END AS split, 'kept' AS reason FROM (SELECT sha256('42:src:' || sha256({PLAIN('instruction')} || chr(10) || 'none' || chr(10))) AS h FROM ({CHATS}))) GROUP BY 1, 2")
def sft_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples of an instruction-tuning build by split; every conversation fits and is kept."""
    rows = _chats(spark, sf_dir).select(F.col("conv_id").alias("line"), F.col("conv_id").cast("string").alias("id"), F.lit("src").alias("source"), "text")
    examples, rejected = builds.prepare_instructions(rows, builds.InstructionBuild(public_tokenizers.path("byte_bpe_50k.json"), 0, 1, 2, 100_000, 0.5))
    kept = examples.groupBy("split").agg(F.count("*").alias("n")).select("split", F.lit("kept").alias("reason"), "n")
    return kept.union(rejected.groupBy("reason").agg(F.count("*").alias("n")).select(F.lit("none"), "reason", "n"))
