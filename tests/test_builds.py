"""Builds, ingest, the command line, reports, table functions and small selections."""

import json
import random

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from millrace import cli
from millrace.functions import tables
from millrace.operators import minhash, select, sft, tokenize, toxicity
from millrace.plans import builds
from millrace.sources import ingest, reports, shards

FILE = P.path("byte_bpe_50k.json")


def example(i, source="a", text=None):
    return (i, f"id{i}", source, text if text is not None else f"Instruction:\nask {i}\n\nInput:\ncontext of {i}\n\nResponse:\nanswer {i}")


def records(spark, rows):
    return spark.createDataFrame(rows, "line long, id string, source string, text string")


def test_structured_truncation(spark):
    t = tokenize.load(FILE)
    ids = lambda x: t.encode(x, add_special_tokens=False).ids
    long = "word " * 200
    cases = [("ask", "", "none", "yes no"), ("ask", long, "input", "yes"), ("ask", "some, more. text", "options", "yes " * 60), ("ask", "", "none", long), (long, "", "none", "yes"), ("ask", "", "none", "")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, instruction string, context string, context_type string, response string")
    got = [r.encoded for r in sft.encode_structured(df, FILE, 40, 7, 8, 9).orderBy("i").collect()]
    assert [g.error for g in got] == [None, None, None, None, "instruction_too_long", "empty_response"]
    for (ask, context, kind, answer), g in zip(cases[:4], got):
        n = sum(g.attention_mask)
        assert len(g.input_ids) == len(g.labels) == len(g.attention_mask) == 40 and g.attention_mask == [1] * n + [0] * (40 - n)
        assert g.input_ids[0] == 7 and g.input_ids[n - 1] == 8 and g.input_ids[n:] == [9] * (40 - n)
        p = g.prompt_tokens
        assert g.labels == [-100] * (1 + p) + g.input_ids[1 + p : n] + [-100] * (40 - n) and g.response_tokens == n - 1 - p
    bare = ids("Instruction:\nask\n\nResponse:\n")
    assert got[0].input_ids[1 : 1 + got[0].prompt_tokens] == bare and not got[0].context_truncated and not got[0].response_truncated
    # the longest beginning of the context that leaves room for the whole response
    best = max((len(x) for k in range(len(long)) if len(x := ids(sft.prompt_of("ask", long.strip()[:k].rstrip(), "input"))) <= 38 - len(ids("yes"))), default=0)
    assert got[1].context_truncated and not got[1].response_truncated and got[1].prompt_tokens == best
    assert got[2].context_truncated and got[2].response_truncated and got[2].prompt_tokens == len(bare)
    assert got[3].response_truncated and not got[3].context_truncated and sum(got[3].attention_mask) == 40


def test_instruction_build(spark, tmp_path):
    rows = [example(i, "ab"[i % 2]) for i in range(60)]
    rows += [example(60, "a", rows[0][3].upper().replace("INSTRUCTION", "Instruction").replace("RESPONSE", "Response").replace("INPUT", "Input")), (61, "id1", "a", example(99)[3]), (62, " ", "a", example(98)[3]), example(63, "a", "no template"), example(64, "a", "Instruction:\n" + "x " * 500 + "\n\nResponse:\ny")]
    c = builds.InstructionBuild(FILE, 0, 1, 2, 64, 0.3, 0.2, sources=("a", "b"), least=5)
    made = builds.build_instructions(records(spark, rows), c, str(tmp_path / "set"))
    assert made["rejected"] == {"duplicate_pair": 1, "duplicate_id": 1, "missing_id": 1, "no_instruction_section": 1, "instruction_too_long": 1}
    assert set(made["splits"]) == {"train", "validation", "test"} and sum(r["examples"] for r in made["splits"].values()) == 60
    assert made["overlaps"] == {"id": [], "prompt_group": []}
    assert builds.check_instructions(spark, str(tmp_path / "set")) == []
    train = builds.read_instructions(spark, str(tmp_path / "set"), "train")
    assert train.count() == made["splits"]["train"]["examples"] and dict(train.dtypes)["labels"] == "array<bigint>"
    batch = sft.crop_batches(train.withColumn("batch", F.lit(0))).collect()
    assert len({len(r.input_ids) for r in batch}) == 1 and max(sum(r.attention_mask) for r in batch) == len(batch[0].input_ids) < 64
    with pytest.raises(FileExistsError):
        builds.build_instructions(records(spark, rows), c, str(tmp_path / "set"))
    with pytest.raises(ValueError, match="contract"):
        builds.prepare_instructions(records(spark, rows[:60]), builds.InstructionBuild(FILE, 0, 1, 2, 64, 0.3, sources=("a", "c")))
    with pytest.raises(ValueError, match="below"):
        builds.prepare_instructions(records(spark, rows[:60]), builds.InstructionBuild(FILE, 0, 1, 2, 64, 0.3, least=31))
    with pytest.raises(ValueError, match="empty splits"):
        builds.prepare_instructions(records(spark, rows[:1]), builds.InstructionBuild(FILE, 0, 1, 2, 64, 0.3))
    damaged = next((tmp_path / "set" / "examples").rglob("part-*"))
    damaged.unlink()
    for crc in damaged.parent.glob(".*crc"):
        crc.unlink()
    assert any(x.startswith("missing ") for x in builds.check_instructions(spark, str(tmp_path / "set")))


def test_violations(spark):
    good = dict(split="train", id="1", prompt_group="g", input_ids=[0, 5, 6, 1, 2], attention_mask=[1, 1, 1, 1, 0], labels=[-100, -100, 6, 1, -100])
    bad = {
        "shape": {"labels": [-100, 6]}, "id_outside_vocabulary": {"input_ids": [0, 50, 6, 1, 2]}, "mask_not_binary": {"attention_mask": [1, 1, 2, 0, 0]}, "label_differs": {"labels": [-100, -100, 7, 1, -100]},
        "padding_supervised": {"labels": [-100, -100, 6, 1, 2]}, "nothing_supervised": {"labels": [-100] * 5}, "end_not_supervised": {"labels": [-100, -100, 6, -100, -100]}, "shared_id": {"split": "test", "prompt_group": "h"}, "shared_prompt_group": {"split": "test", "id": "2"},
    }
    schema = "split string, id string, prompt_group string, input_ids array<int>, attention_mask array<int>, labels array<int>"
    order = schema.replace(",", "").split()[::2]
    made = lambda *rows: spark.createDataFrame([tuple(r[n] for n in order) for r in rows], schema)
    assert sft.violations(made(good), 5, 10, 1).collect() == []
    for name, change in bad.items():
        found = {r.violation for r in sft.violations(made({**good, "id": "0", "prompt_group": "f"} if "shared" not in name else good, {**good, **change}), 5, 10, 1).collect()}
        assert name in found, name


def documents(spark, n=40):
    rng = random.Random(2)
    return spark.createDataFrame([(i, i, f"s{i % 3}", " ".join(f"w{rng.randrange(99)}" for _ in range(rng.randrange(5, 60))), 10) for i in range(n)], "doc_id long, ord long, source string, text string, tokens long")


def test_phases(spark, tmp_path):
    docs, folder = documents(spark), str(tmp_path)
    phases = {"one": builds.Phase(("s0", "s1"), {"s0": 50, "s1": 30}), "two": builds.Phase(("s0",), {"s0": 30}, ("one",)), "mixed": builds.Phase(("s1", "s2"))}
    made = builds.build_phases(docs, phases, folder)["phases"]
    one, two = (set(r.doc_id for r in spark.read.parquet(f"{folder}/{p}/train").collect()) for p in ("one", "two"))
    assert one == {0, 3, 6, 9, 12, 1, 4, 7} and two == {15, 18, 21}
    assert made["mixed"]["documents"] == 26 and made["two"]["excluded_phases"] == ["one"]
    position = [r.source for r in spark.read.parquet(f"{folder}/mixed/train").orderBy("position").collect()]
    assert position == ["s1", "s2"] * 13
    with pytest.raises(ValueError, match="unknown"):
        builds.build_phases(docs, phases, folder, ["nine"])
    with pytest.raises(FileNotFoundError):
        builds.build_phases(docs, {"three": builds.Phase(("s0",), {"s0": 9}, ("four",))}, folder, ["three"])
    with pytest.raises(FileNotFoundError):
        builds.phase_rows(docs, builds.Phase(("s9",), {"s9": 9}), docs.where("false"))
    again = builds.build_phases(docs, {"five": builds.Phase(("s2",), {"s2": 10})}, folder, ["five"])["phases"]
    assert set(again) == {"one", "two", "mixed", "five"}
    with pytest.raises(ValueError, match="repeated id"):
        builds.unique_ids(docs.union(docs), "doc_id", "x")


def test_evaluation(spark, tmp_path):
    docs = documents(spark)
    made = builds.build_evaluation(docs, {"validation": {"s0": 25}, "test": {"s0": 10, "s1": 15}}, docs.where("doc_id = 3"), str(tmp_path / "e"))
    held = {s: {json.loads(x.value)["doc_id"] for x in spark.read.text(f"{tmp_path}/e/{s}.jsonl").collect()} for s in ("validation", "test")}
    assert held == {"validation": {0, 6, 9}, "test": {12, 1, 4}} and made["splits"]["test"]["sources"]["s1"]["tokens"] == 20
    with pytest.raises(ValueError, match="exhausted"):
        builds.build_evaluation(docs, {"x": {"s0": 1000}}, docs.where("false"), str(tmp_path / "f"))
    with pytest.raises(ValueError, match="positive"):
        builds.build_evaluation(docs, {"x": {"s0": 0}}, docs.where("false"), str(tmp_path / "g"))


def test_corpus(spark, tmp_path):
    docs = documents(spark).withColumns({"quality_decision": F.when(F.col("doc_id") % 4 == 0, "reject").otherwise("pass"), "license_decision": F.when(F.col("doc_id") % 5 == 0, "review").otherwise("pass")})
    inputs = [builds.Input("a", "train", "train", docs.where("doc_id < 30")), builds.Input("b", "train", "test", docs.where("doc_id >= 30"))]
    made = builds.build_corpus(inputs, builds.CorpusBuild("exclude", 20), str(tmp_path / "c"))
    want = {s: [i for i in ids if i % 4 and i % 5] for s, ids in (("train", range(20)), ("test", range(30, 40)))}
    assert made["documents"] == {"train": len(want["train"]), "validation": 0, "test": len(want["test"])}
    assert len(spark.read.text(f"{tmp_path}/c/tokenizer_corpus").collect()) == len(want["train"])
    assert {(r["output_split"], r["reason"]): r["count"] for r in made["exclusion_reasons"]} == {("train", "quality_not_accepted"): 5, ("train", "license_review_excluded"): 4, ("test", "quality_not_accepted"): 2, ("test", "license_review_excluded"): 2}
    assert reports.verify(spark, f"{tmp_path}/c/tokenizer_corpus", made["artifacts"]["tokenizer_corpus"]) == []
    with pytest.raises(ValueError, match="twice"):
        builds.check_inputs([inputs[0], inputs[0]])
    with pytest.raises(ValueError):
        builds.check_inputs([])
    for bad in (dict(review_policy="maybe"), dict(most_per_input=0), dict(tokenizer_split="x")):
        with pytest.raises(ValueError):
            builds.CorpusBuild(**bad)


def test_tokenized(spark, tmp_path):
    docs = documents(spark).union(spark.createDataFrame([(90, 90, "s", " ", 1)], "doc_id long, ord long, source string, text string, tokens long"))
    made = builds.build_tokens({"train": docs}, builds.TokenBuild(FILE, 50256, 16, 10), str(tmp_path / "t"))
    stream = [x for r in docs.orderBy("doc_id").collect() if r.text.strip() for x in [*tokenize.load(FILE).encode(r.text.strip(), add_special_tokens=False).ids, 50256]]
    s = made["splits"]["train"]
    assert (s["documents"], s["empty_documents"], s["tokens"], s["records"], s["tail"]) == (40, 1, len(stream), len(stream) // 17, len(stream) % 17)
    back = shards.read_shards(spark, str(tmp_path / "t" / "train"), 17, made["dtype"])
    assert [x for r in back.orderBy("record").collect() for x in r.tokens] == stream[: len(stream) // 17 * 17]
    with pytest.raises(ValueError, match="too few"):
        builds.build_tokens({"train": docs}, builds.TokenBuild(FILE, 50256, 100_000), str(tmp_path / "u"))
    names = ("pad_token", "unknown_token", "beginning_of_sequence_token", "end_of_sequence_token")
    assert builds.check_tokenizer(FILE, dict(zip(names, ["!", '"', "#", "<|endoftext|>"]))) == []
    assert len(builds.check_tokenizer(FILE, {"pad_token": "no such token", "unknown_token": "!", "beginning_of_sequence_token": "!"}, 100)) == 4


def test_ingest(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "train.jsonl").write_text("".join(json.dumps({"instruction": f"ask {i}", "output": f"say {i}"}) + "\n" for i in range(9)))
    one = {"source_type": "files", "path": f"{tmp_path}/raw/{{split}}.jsonl", "source_name": "alpaca", "license": "x", "language": "en", "splits": {"train": "train"}, "output_directory": f"{tmp_path}/out", "max_documents": {"train": 4}}
    config = {"project": {"corpora_config": f"{tmp_path}/corpora.json"}, "datasets": {"alpaca": one}}
    (tmp_path / "corpora.json").write_text(json.dumps({"download_plan": {"alpaca": {"max_documents": {"train": 4}}}}))
    (tmp_path / "data.json").write_text(json.dumps(config))
    assert ingest.ingest(spark, ingest.load_config(f"{tmp_path}/data.json"), "alpaca") == {"train": 4}
    got = spark.read.json(f"{tmp_path}/out/train.jsonl").orderBy("id").collect()
    assert [r.text for r in got] == [f"Instruction:\nask {i}\n\nResponse:\nsay {i}" for i in range(4)] and got[2].id.startswith("alpaca-train-000000002-")
    assert reports.read_json(spark, f"{tmp_path}/out/metadata.json")["split_document_counts"] == {"train": 4}
    with pytest.raises(ValueError, match="differ"):
        ingest.check_plan({**config, "datasets": {"alpaca": {**one, "max_documents": 5}}}, "alpaca")
    with pytest.raises(KeyError):
        ingest.checked(config, "wikipedia")
    with pytest.raises(ValueError, match="lacks license"):
        ingest.checked({"datasets": {"alpaca": {k: v for k, v in one.items() if k != "license"}}}, "alpaca")
    for bad, kind in ((0, ValueError), (-3, ValueError), ("5", TypeError), (True, TypeError)):
        with pytest.raises(kind):
            ingest.limit(bad)
    sets = {"datasets": {"b": {"splits": {"train": "x", "test": "y"}}, "alpaca": {"splits": {"train": "x", "odd": "z"}}}}
    assert ingest.splits_in_order(sets) == [("b", "test"), ("alpaca", "odd"), ("alpaca", "train"), ("b", "train")]
    assert ingest.stage_inputs(sets, "in", True)[0] == {"dataset": "b", "split": "test", "input_path": "in/b/test.jsonl", "profile": "pretraining"}
    xml = spark.createDataFrame([("<set><PubmedArticle><PMID>1</PMID></PubmedArticle><PubmedArticle><PMID>2</PMID></PubmedArticle></set>",)], "xml string")
    assert [r.xml for r in ingest.records(xml, "PubmedArticle").collect()] == ["<PubmedArticle><PMID>1</PMID></PubmedArticle>", "<PubmedArticle><PMID>2</PMID></PubmedArticle>"]


def test_numbering_follows_files_and_rows(spark, tmp_path):
    df = spark.range(0, 50, 1, 7).selectExpr("id as v")
    assert [r.v for r in ingest.numbered(df).orderBy("source_index").collect()] == list(range(50))
    assert sorted(r.source_index for r in ingest.numbered(df).collect()) == list(range(50))


def test_reports(spark, tmp_path):
    reports.write_text(spark, f"{tmp_path}/x.md", reports.markdown("T", {"a": [{"k": 1, "v": "p|q\nr"}], "b": []}))
    text = reports.read_text(spark, f"{tmp_path}/x.md")
    assert "| k | v |" in text and "| 1 | p\\|q r |" in text and "No rows." in text
    with pytest.raises(FileExistsError):
        reports.write_text(spark, f"{tmp_path}/x.md", "again")


def test_command_line(spark, tmp_path, capsys):
    docs = documents(spark).select("doc_id", "source", "text")
    docs.write.parquet(f"{tmp_path}/in.parquet")
    cli.main(["statistics", "--input", f"{tmp_path}/in.parquet"])
    assert '"documents": 40' in capsys.readouterr().out
    cli.main(["dedup", "--input", f"{tmp_path}/in.parquet", "--output", f"{tmp_path}/dedup"])
    assert spark.read.parquet(f"{tmp_path}/dedup/kept").count() == 40
    (tmp_path / "phases.json").write_text(json.dumps({"corpora": {"p": {"target_tokens": 40, "sources": {"s0": {"tokens": 40}}}}}))
    cli.main(["phases", "--input", f"{tmp_path}/in.parquet", "--config", f"{tmp_path}/phases.json", "--output", f"{tmp_path}/phases"])
    cli.main(["tokens", "--tokenizer", FILE, "--output", f"{tmp_path}/tokens", "--split", f"train={tmp_path}/in.parquet", "--width", "8", "--eos", "50256"])
    records(spark, [example(i) for i in range(30)]).drop("line").coalesce(1).write.json(f"{tmp_path}/sft.jsonl")
    (tmp_path / "sft.json").write_text(json.dumps({"build": {"tokenizer": FILE, "bos": 0, "eos": 1, "pad": 2, "length": 64, "validation": 0.4}}))
    cli.main(["sft-prepare", "--input", f"{tmp_path}/sft.jsonl", "--config", f"{tmp_path}/sft.json", "--output", f"{tmp_path}/sft"])
    with pytest.raises(SystemExit) as e:
        cli.main(["sft-check", "--input", f"{tmp_path}/sft"])
    assert e.value.code is False or e.value.code == 0
    cli.main(["sft-audit", "--input", f"{tmp_path}/sft", "--output", f"{tmp_path}/audit.md"])
    assert "requires" in (tmp_path / "audit.md").read_text() or "not_assessed" in (tmp_path / "audit.md").read_text()
    with pytest.raises(SystemExit):
        cli.main(["nothing"])


def test_table_functions(spark):
    tables.register(spark)
    got = spark.sql("select d.k, c.at, c.chunk from values (1, 'a b c d e'), (2, ' '), (3, 'x') as d(k, t), lateral text_chunks(d.t, 3, 2) c order by 1, 2").collect()
    assert [(r.k, r.at, r.chunk) for r in got] == [(1, 0, "a b c"), (1, 1, "c d e"), (3, 0, "x")]
    assert [r.xml for r in spark.sql("select * from xml_records('<s><a>1</a> <a x=\"2\"/></s>', 'a')").collect()] == ["<a>1</a>", '<a x="2" />']


def test_minhash(spark):
    rng = random.Random(1)
    sets = [[f"s{x}" for x in rng.sample(range(1000), 200)]]
    sets += [sets[0][:190] + [f"t{k}" for k in range(10)], [f"u{k}" for k in range(200)], []]
    df = spark.createDataFrame(list(enumerate(sets)), "k long, s array<string>").select("k", minhash.signature(F.col("s")).alias("signature"))
    rows = {r.k: r.signature for r in df.collect()}
    assert rows[3] is None and len(rows[0]) == 128
    same = sum(a == b for a, b in zip(rows[0], rows[1])) / 128
    assert abs(same - 190 / 210) < 0.15 and not any(a == b for a, b in zip(rows[0], rows[2]))
    assert [(r.a, r.b) for r in minhash.candidates(df, "k", 0.7).collect()] == [(0, 1)]
    assert minhash.bands_for(0.9)[1] > minhash.bands_for(0.5)[1]


class Count:
    def score(self, texts):
        return [{"toxic": t.count("bad") / 10} for t in texts]


def test_toxicity_of_chunks(spark):
    rows = [(0, "good " * 90 + "bad bad bad " + "good " * 50), (1, " "), (2, None), (3, "bad")]
    got = {r.i: r for r in toxicity.predict(spark.createDataFrame(rows, "i int, text string"), Count, 20, 10, 50).collect()}
    assert got[0].scores == {"toxic": 0.3} and got[0].chunks_processed == 14 and got[1].scores == got[2].scores == {} and got[3].scores == {"toxic": 0.1}
    few = toxicity.predict(spark.createDataFrame(rows, "i int, text string"), Count, 20, 10, 2).orderBy("i").first()
    assert few.chunks_processed == 2 and few.scores == {"toxic": 0.0}
    assert toxicity.snake_labels({1: "Identity Hate", 0: " Toxic-ish!"}) == ["toxic_ish", "identity_hate"]


def test_selection_errors(spark):
    one = spark.createDataFrame([("p", "c1"), ("q", "c2")], "profile string, checkpoint string")
    tested = spark.createDataFrame([("p", "c1", 1.0), ("q", "c2", 2.0)], "profile string, checkpoint string, loss double")
    assert [(r.profile, r.checkpoint, r.loss) for r in select.matched(one, tested).orderBy("profile").collect()] == [("p", "c1", 1.0), ("q", "c2", 2.0)]
    with pytest.raises(Exception, match="not tested: q"):
        select.matched(one, tested.where("profile = 'p'")).collect()
    with pytest.raises(Exception, match="another checkpoint"):
        select.matched(one, tested.withColumn("checkpoint", F.lit("c1"))).collect()
    assert [r.asDict() for r in select.aliases(spark.createDataFrame([("best", "c"), ("last", "c")], "pointer string, checkpoint string")).collect()] == [{"checkpoint": "c", "pointers": ["best", "last"]}]
    with pytest.raises(Exception, match="no candidate"):
        select.best_candidate(spark.createDataFrame([("c", 1.0, False)], "checkpoint string, loss double, preferred boolean")).collect()
    with pytest.raises(Exception, match="no supervised"):
        select.response_accuracy(spark.createDataFrame([([1], [-100])], "predictions array<int>, labels array<int>")).collect()
    with pytest.raises(Exception, match="one run only"):
        select.compared(one.selectExpr("profile as source", "1.0D as l"), one.where("profile = 'p'").selectExpr("profile as source", "1.0D as l"), "source", "l").collect()
    deep = spark.createDataFrame([({"a": {"b": "x"}},)], "m map<string, map<string, string>>")
    assert deep.select(select.nested(F.col("m"), "a", "b"), select.nested(F.col("m"), "z", "b")).first() == ("x", None)


def test_tokenizer_comparison(spark):
    df = spark.createDataFrame([("the cat the", "x"), ("dog", "y"), (None, "y")], "text string, source string")
    t = tokenize.load(FILE)
    ids = [i for x in ("the cat the", "dog") for i in t.encode(x, add_special_tokens=False).ids]
    use = tokenize.vocabulary_use(df, FILE).first()
    assert (use.vocabulary, use.used) == (t.get_vocab_size(), len(set(ids)))
    top = tokenize.common_tokens(df, FILE, 3).collect()
    assert [(r.token_id, r.n) for r in top] == sorted(((i, ids.count(i)) for i in set(ids)), key=lambda x: (-x[1], x[0]))[:3] and top[0].token == t.id_to_token(top[0].token_id)
    m = {r.source: r for r in tokenize.metrics(df, FILE, "source").collect()}
    assert m["all"].tokens == len(ids) and m["all"].unknown_rate == 0 and m["all"].round_trip_rate == 1
    better = tokenize.compare({"tokens_per_word": 2.0, "characters_per_token": 3.0, "single_character_rate": 0.5}, {"tokens_per_word": 1.0, "characters_per_token": 4.0, "single_character_rate": 0.6})
    assert better == {"change_percent": {"tokens_per_word": -50.0, "characters_per_token": 33.333333, "single_character_rate": 20.0}, "recommended": "other"}
    assert tokenize.compare({"tokens_per_word": 1.0}, {"tokens_per_word": 2.0})["recommended"] == "baseline"
