"""Standardizers, files, shards, the service reader, streams and the stage driver."""

import json
import os
import urllib.error

import pytest
from pyspark.sql import Row, functions as F

from millrace.functions import text as T
from millrace.operators import packing
from millrace.plans import stages
from millrace.sources import entrez, files, shards, standardize as Z
from millrace.streaming import stream


def texts(df, name, **options):
    if "source_index" not in df.columns:
        df = df.withColumn("source_index", F.monotonically_increasing_id())
    return [r.text for r in Z.standardize(df, Z.Source(name, name, **options)).orderBy("id").collect()]


def test_plain_and_titled(spark):
    df = spark.createDataFrame([(0, " a "), (1, None), (2, " "), (3, "b"), (4, "c")], "source_index long, text string")
    out = Z.standardize(df, Z.Source("tinystories", "hub/x", max_documents=2)).orderBy("id").collect()
    assert [r.text for r in out] == ["a", "b"] and out[1].id.startswith("tinystories-train-000000003-") and out[1].metadata["source_index"] == "3"
    df = spark.createDataFrame([("Cat", "cat is an animal"), ("Dog", "An animal"), (None, "No title")], "title string, text string").coalesce(1)
    assert texts(df, "wikipedia") == ["cat is an animal", "Dog\n\nAn animal", "No title"]
    df = spark.createDataFrame([("Cat", "cat x", ""), ("Cat", "Cat x", "WikiDoc"), ("A", "b", "other")], "title string, content string, source string").coalesce(1)
    assert texts(df, "wikidoc") == ["Cat\n\ncat x", "Cat x"]
    for name in ("project_gutenberg_public_domain", "fineweb_edu"):
        assert texts(spark.createDataFrame([("x",)], "text string"), name) == ["x"]
    with pytest.raises(ValueError):
        Z.standardize(df, Z.Source("nowhere", "x"))


def test_wikitext(spark):
    lines = ["before", "", " = First = ", " text ", " text ", " == Part == ", "more", "= = Deep = =", " = = Odd = ", " = Second = ", "end"]
    df = spark.createDataFrame(list(enumerate(lines)), "source_index long, text string")
    assert texts(df, "wikitext103") == ["before", "First\n\ntext\n\nPart\n\nmore\n\nDeep\n\n= = Odd =", "Second\n\nend"]


def test_instruction_sources(spark):
    row = spark.createDataFrame([("ask", "in", "out"), ("ask", "", "out"), ("", "", "out")], "instruction string, input string, output string").coalesce(1)
    whole = ["Instruction:\nask\n\nInput:\nin\n\nResponse:\nout", "Instruction:\nask\n\nResponse:\nout"]
    for name in ("alpaca", "chatdoctor", "medalpaca", "medinstruct", "openmedinstruct"):
        assert texts(row, name) == whole
    for name, kind in (("alpaca", "alpaca_instruction"), ("chatdoctor", "medical_dialogue_sft"), ("medalpaca", "medical_flashcard_sft")):
        df = spark.createDataFrame([(0, " ", "q", "c", "a")], "source_index long, instruction string, prompt string, context string, answer string")
        out = Z.standardize(df, Z.Source(name, name)).collect()[0]
        assert out.text == "Instruction:\nq\n\nInput:\nc\n\nResponse:\na" and out.metadata == {"source_index": "0", "document_type": kind, "task_type": "sft"}
    df = spark.createDataFrame([(0, "q", "yes", 3), (1, "q", None, 4)], "source_index long, question string, `claude-2` string, difficulty int")
    assert [(r.text, r.metadata["difficulty"]) for r in Z.standardize(df, Z.Source("medinstruct", "m")).collect()] == [("Instruction:\nq\n\nResponse:\nyes", "3")]
    df = spark.createDataFrame([("q", "a", "b")], "question string, `text-davinci-003-answer` string, answer string")
    assert texts(df, "medinstruct") == ["Instruction:\nq\n\nResponse:\na"]
    chat = spark.createDataFrame([Row(messages=[Row(role="system", content="s"), Row(role="User", content=" hi "), Row(role="gpt", content="yo"), Row(role="human", content="more")])])
    assert texts(chat, "openmedinstruct") == ["Instruction:\nhi\nmore\n\nResponse:\nyo"]


def test_question_sources(spark):
    df = spark.createDataFrame([("q", "1", "2", "3", "4", 2, "why"), ("q", "1", "2", "3", "4", 4, ""), ("q", "1", "", "3", "4", 0, "")], "question string, opa string, opb string, opc string, opd string, cop int, exp string").coalesce(1)
    assert texts(df, "medmcqa") == ["Instruction:\nq\n\nOptions:\nA. 1\nB. 2\nC. 3\nD. 4\n\nResponse:\nC. 3\n\nExplanation: why"]
    assert texts(df.withColumn("cop", F.col("cop").cast("string")), "medmcqa") == []
    df = spark.createDataFrame([Row(question="q", context=Row(contexts=["a", " b "]), long_answer="l", final_decision="yes")])
    assert texts(df, "pubmedqa") == ["Instruction:\nq\n\nInput:\na\nb\n\nResponse:\nyes\n\nl"]
    assert texts(spark.createDataFrame([("q", "c", "l")], "question string, context string, long_answer string"), "pubmedqa") == ["Instruction:\nq\n\nInput:\nc\n\nResponse:\nl"]


def test_xml_sources(spark):
    def made(name, xml):
        return Z.standardize(spark.createDataFrame([(0, xml), (1, None)], "source_index long, xml string"), Z.Source(name, "p")).collect()

    head = "<PubmedArticle><PMID>7</PMID><ArticleTitle>A <i>big</i> T</ArticleTitle><Journal><Title>J</Title></Journal><Abstract>"
    rest = "<CopyrightInformation>(c) x</CopyrightInformation></Abstract><ArticleId IdType='pubmed'>7</ArticleId><ArticleId IdType='doi'>10.1/x</ArticleId></PubmedArticle>"
    out = made("pubmed_abstracts", head + "<AbstractText Label='AIM'>we <i>see</i> it</AbstractText><AbstractText>plain &amp; short</AbstractText><AbstractText Label='END'> </AbstractText>" + rest)
    assert [r.text for r in out] == ["A big T\n\nAIM: we see it\nplain & short"]
    assert out[0].metadata == {"source_index": "0", "document_type": "biomedical_abstract", "pmid": "7", "title": "A big T", "journal": "J", "doi": "10.1/x", "copyright_information": "(c) x"}
    assert made("pubmed_abstracts", head + rest) == []
    xml = "<article><front><article-id pub-id-type='pmc'>PMC1</article-id><article-id pub-id-type='pmid'>9</article-id><article-title>T</article-title><permissions><license><p>see\n creativecommons.org/licenses/by/4.0 for more</p></license></permissions></front><body><sec><p>one <i>two</i>\n three</p><p> </p><p>four</p></sec></body></article>"
    out = made("pmc_open_access", xml)
    assert [(r.text, r.license) for r in out] == [("T\n\none two three\n\nfour", "cc-by-4.0")]
    assert out[0].metadata == {"source_index": "0", "document_type": "biomedical_full_text_article", "pmcid": "PMC1", "pmid": "9", "title": "T", "license_statement": "see creativecommons.org/licenses/by/4.0 for more"}
    with pytest.raises(Exception, match="ParseError"):
        made("pmc_open_access", "<article>")
    said = {"CC0 here": "cc0-1.0", "under CC BY 3.0": "cc-by-3.0", "http://creativecommons.org/licenses/by-nc-nd/4.0/": "cc-by-nc", "creativecommons.org/licenses/by-sa/3.0": "cc-by-sa", "cc by": "unknown", "": "unknown"}
    df = spark.createDataFrame([(x,) for x in said], "x string").select("x", Z.article_license(F.col("x")).alias("y"))
    assert {r.x: r.y for r in df.collect()} == said


def test_metadata_of_books_and_pages(spark):
    df = spark.createDataFrame([(0, "t", None, {"book_id": "12", "author": "A"})], "source_index long, text string, id string, metadata map<string, string>")
    out = Z.standardize(df, Z.Source("project_gutenberg_public_domain", "g")).collect()[0]
    assert out.metadata == {"source_index": "0", "document_type": "public_domain_book", "book_id": "12", "author": "A", "source_document_id": "12"}
    df = spark.createDataFrame([(0, "t", "u", 0.5)], "source_index long, text string, url string, score double")
    out = Z.standardize(df, Z.Source("fineweb_edu", "f")).collect()[0]
    assert out.metadata == {"source_index": "0", "document_type": "educational_web_document", "url": "u", "educational_score": "0.5"}
    df = spark.createDataFrame([(3_000_000_000, "t")], "source_index long, text string")
    assert Z.standardize(df, Z.Source("tinystories", "f")).collect()[0].id.startswith("tinystories-train-3000000000-")


def test_json_lines(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text('{"id": "1", "text": " a "}\n\n{"id": "2", "text": ""}\n{"id": "3", "text": "b"}\n')
    df = files.read_jsonl(spark, str(tmp_path / "in.jsonl"))
    assert df.count() == 3
    assert [r.text for r in files.read_texts(spark, str(tmp_path / "in.jsonl"), 1).collect()] == ["a"]
    assert files.write_jsonl(df, str(tmp_path / "out")) == 3
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        files.write_jsonl(df, str(tmp_path / "out"))
    (tmp_path / "bad.jsonl").write_text('{"id": "1"\n')
    with pytest.raises(Exception, match=r"not a JSON object in .*bad.jsonl: ..id"):
        files.read_jsonl(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "two").mkdir()
    for name in ("b", "a"):
        (tmp_path / "two" / f"{name}.jsonl").write_text("".join(json.dumps({"text": f"{name}{i}"}) + "\n" for i in range(5)))
    assert [r.text for r in files.read_texts(spark, str(tmp_path / "two"), 7).collect()] == [f"a{i}" for i in range(5)] + ["b0", "b1"]


def test_resumable_append(spark, tmp_path):
    df = spark.createDataFrame([(i, f"{i % 3}", "t") for i in range(6)], "ord long, id string, text string")
    path = str(tmp_path / "sink")
    assert files.append_unseen(df, path, "ord", most=2) == 2
    assert files.append_unseen(df, path, "ord", most=5) == 1
    assert files.append_unseen(df, path, "ord") == 0


def test_corpus_and_manifest(spark, tmp_path):
    df = spark.createDataFrame([(2, "b\nc"), (1, "a"), (3, " ")], "doc_id long, text string")
    files.write_corpus(df, str(tmp_path / "c"), "doc_id")
    before = files.manifest(spark, str(tmp_path / "c"))
    before = spark.createDataFrame(before.collect(), before.schema)
    assert [r.value for r in spark.read.text(str(tmp_path / "c")).collect()] == ["a", "b c"]
    (tmp_path / "c" / "new.bin").write_bytes(b"x")
    assert [r.change for r in files.changed(before, files.manifest(spark, str(tmp_path / "c"))).collect()] == ["added"]


def test_shards(spark, tmp_path):
    df = spark.createDataFrame([(i, list(range(i, i + 5))) for i in range(0, 50, 5)], "doc_id long, ids array<int>")
    records = packing.pack(df, 4, per_shard=3)
    made = shards.write_shards(records, str(tmp_path / "s"), 100).collect()
    assert sorted((r.shard, r.records) for r in made) == [(0, 3), (1, 3), (2, 3), (3, 1)]
    back = shards.read_shards(spark, str(tmp_path / "s"), 5, "uint16")
    assert [r.tokens for r in back.orderBy("record").collect()] == [r.tokens for r in records.orderBy("record").collect()]
    assert shards.at(back, -1).collect()[0].tokens == [45, 46, 47, 48, 49]
    for k in (0, 4, 9, -1, -10):
        assert shards.read_record(f"file://{tmp_path}/s", 5, "uint16", k).tolist() == records.orderBy("record").collect()[k].tokens
    for k in (10, -11):
        with pytest.raises(IndexError):
            shards.read_record(str(tmp_path / "s"), 5, "uint16", k)
    with pytest.raises(ValueError):
        shards.read_shards(spark, str(tmp_path / "s"), 7, "uint16")


def test_service_retries():
    calls, waits = [], []

    def send(url, body):
        calls.append(body)
        if len(calls) < 3:
            raise urllib.error.HTTPError(url, 429, "later", {"Retry-After": "7"} if len(calls) == 1 else None, None)
        return b"ok"

    assert entrez.request("u", {"a": "b"}, send=send, sleep=waits.append) == b"ok" and waits == [7.0, 2.0]
    with pytest.raises(urllib.error.HTTPError):
        entrez.request("u", {}, send=lambda u, b: (_ for _ in ()).throw(urllib.error.HTTPError(u, 404, "no", None, None)), sleep=waits.append)


def test_service_partitions(monkeypatch):
    answers = {"esearch": json.dumps({"esearchresult": {"count": "3", "querykey": "1", "webenv": "w"}}).encode(), "efetch": b"<x/>"}
    monkeypatch.setattr(entrez, "request", lambda url, fields, **k: answers["esearch" if "esearch" in url else "efetch"])
    r = entrez.EntrezReader({"url": "http://x", "db": "d", "term": "t", "start": "2024/02/28", "end": "2024-03-01", "batch": "2"})
    assert [p.day for p in r.partitions()] == ["2024-02-28", "2024-02-29", "2024-03-01"]
    assert list(r.read(r.partitions()[0])) == [("2024-02-28", 0, "<x/>"), ("2024-02-28", 2, "<x/>")]
    answers["esearch"] = answers["esearch"].replace(b'"3"', b'"12000"')
    full = {**r.options, "db": "pubmed", "batch": "5000"}
    with pytest.raises(ValueError, match="12000"):
        list(entrez.EntrezReader(full).read(r.partitions()[0]))
    assert [at for _, at, _ in entrez.EntrezReader({**full, "overflow": "truncate"}).read(r.partitions()[0])] == [0, 5000]
    assert [at for _, at, _ in entrez.EntrezReader({**full, "db": "pmc"}).read(r.partitions()[0])] == [0, 5000, 10000]
    for bad in ({"url": "x"}, {**full, "datetype": "day"}, {**full, "overflow": "drop"}):
        with pytest.raises(ValueError):
            entrez.EntrezReader(bad)
    with pytest.raises(ValueError):
        entrez.days("2024-01-02", "2024-01-01")


def test_streams(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("ts", F.timestamp_seconds(F.col("doc_id") * 60 + 1_700_000_000))
    docs.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    q = stream.write_once(stream.distinct_stream(source, "ts", "365 days"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == docs.select(T.squash(F.col("text"))).distinct().count()
    q = stream.write_once(stream.clean_stream(source), str(tmp_path / "out2"), str(tmp_path / "cp2"))
    q.awaitTermination(120)
    assert 0 < spark.read.parquet(str(tmp_path / "out2")).count() < docs.count()
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.select("ts", "event_type", "value").write.parquet(str(tmp_path / "ev"))
    feed = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "ev"))
    q = stream.windowed_counts(feed, "ts", "event_type").writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("select sum(n) s from counts").collect()[0].s == events.count()


def test_stage_driver(spark, sf, tmp_path):
    out = str(tmp_path / "run")
    first = stages.run(spark, f"{sf}/documents.parquet", out, stop_after="near_dedup")
    n = first.count()
    last = stages.run(spark, f"{sf}/documents.parquet", out, start_at="language")
    assert 0 < last.count() < n and {"quality_decision", "license_decision", "decision"} <= set(last.columns)
    assert stages.chosen("quality", "license") == ["quality", "license"]
    with pytest.raises(ValueError):
        stages.chosen("license", "clean")


def batches(spark, tmp_path, name, schema, parts):
    """A stream that reads one file for each part, in order."""
    folder = tmp_path / name
    folder.mkdir()
    for k, rows in enumerate(parts):
        (folder / f"{k}.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
        os.utime(folder / f"{k}.jsonl", (1_000_000 + k, 1_000_000 + k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def ran(df, tmp_path, name):
    df.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.parquet(str(tmp_path / name)).collect()


def test_late_rows(spark, tmp_path):
    """A row behind the watermark is left out of its window, one within the delay counts; copies within the watermark go."""
    at = lambda m, v=1: {"ts": f"2026-01-01T00:{m:02d}:00.000Z", "by": "a", "value": v, "text": f"t{v}"}
    parts = [[at(1), at(2), at(14)], [at(9, 5), at(35)], [at(36)], [at(3, 7), at(37)], [at(59)], [{**at(59), "ts": "2026-01-01T02:00:00.000Z"}]]
    schema = "ts timestamp, by string, value long, text string"
    rows = ran(stream.windowed_counts(batches(spark, tmp_path, "in", schema, parts), "ts", "by"), tmp_path, "windows")
    assert {(r.window.start.minute, r.n, r.total) for r in rows} == {(0, 3, 7), (10, 1, 1), (30, 3, 3), (50, 1, 1)}
    copies = ran(stream.distinct_stream(batches(spark, tmp_path, "in2", schema, [[at(1, 1), at(2, 1)], [at(3, 1), at(4, 2)], [at(5, 2)]]), "ts"), tmp_path, "distinct")
    assert sorted(r.text for r in copies) == ["t1", "t2"]


def test_budget_over_batches(spark, tmp_path):
    row = lambda i, s, n: {"id": i, "source": s, "tokens": n}
    parts = [[row(1, "a", 4), row(2, "b", 30), row(3, "c", 1)], [row(4, "a", 5), row(5, "b", 1), row(6, "a", 3)], [row(7, "a", 1), row(8, "b", 1)]]
    df = batches(spark, tmp_path, "in", "id long, source string, tokens long", parts)
    rows = ran(stream.budgeted_stream(df, "source", "tokens", {"a": 10, "b": 20}), tmp_path, "out")
    assert sorted((r.source, r.id, r.total) for r in rows) == [("a", 1, 4), ("a", 4, 9), ("b", 2, 30)]
