"""Order, greedy removal, policies, budgets, splits and packing on small cases."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from millrace.plans import assembly_queries
from millrace.operators import assemble, dedup, language, licensing, packing, sft, stats, toxicity


def test_first_by_priority_stays(spark):
    a = spark.createDataFrame([(1, "same  text"), (2, "only here")], "id long, text string")
    b = spark.createDataFrame([(0, "same text "), (3, None), (4, " "), (5, "new")], "id long, text string")
    rows = {(r.origin, r.id): r.outcome for r in dedup.mark_exact(dedup.prioritized([("eval", a), ("train", b)]), ["priority", "id"]).collect()}
    assert rows == {("eval", 1): "kept", ("eval", 2): "kept", ("train", 0): "duplicate", ("train", 3): "invalid_text_type", ("train", 4): "empty_canonical_text", ("train", 5): "kept"}
    with pytest.raises(ValueError):
        dedup.prioritized([("x", a), ("x", b)])
    with pytest.raises(ValueError):
        dedup.content_hash(F.col("text"), "crc")


def brute_pairs(sets, t):
    ids = sorted(sets)
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])}


def mixed_texts(seed):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(50)}" for _ in range(40)] for _ in range(5)]
    rows = []
    for i in range(60):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            w[rng.randrange(40)] = f"x{rng.randrange(9)}"
        rows.append((i, " ".join(w)))
    return rows, {i: frozenset(tuple(x.split()[k : k + 5]) for k in range(36)) for i, x in rows}


@pytest.mark.parametrize("t", [0.3, 0.5, 0.7, 0.9])
def test_similar_classes_and_greedy_are_exact(spark, t, monkeypatch):
    """Links between classes, members, and the greedy rule, against all pairs of documents."""
    rows, sets = mixed_texts(7)
    members, reps = dedup.classes_of(dedup.shingles(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id"), "doc_id")
    first = {i: min(j for j in sets if sets[j] == sets[i]) for i in sets}
    assert {r.k: r.rep for r in members.collect()} == first
    links = dedup.similar_classes(reps, t)
    got = links.collect()
    pairs = brute_pairs(sets, t)
    assert sorted((r.a, r.b) for r in got) == sorted((a, b) for a, b in pairs if first[a] == a and first[b] == b)
    kept, gone = [], {}
    for k in sorted(sets):
        near = [(-round(len(sets[a] & sets[k]) / len(sets[a] | sets[k]), 6), a) for a in kept if (a, k) in pairs]
        if near:
            gone[k] = min(near)[1]
        else:
            kept.append(k)
    for task in (dedup.TASK, 3):
        monkeypatch.setattr(dedup, "TASK", task)
        assert {r.k: r.kept_by for r in dedup.greedy_removed(members, links).collect()} == gone


def test_greedy_is_not_components(spark):
    chain = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.9), (3, 4, 0.8)], "a long, b long, jaccard double")
    members = spark.createDataFrame([(k, k) for k in range(1, 5)] + [(9, 2)], "k long, rep long")
    assert {(r.k, r.kept_by) for r in dedup.greedy_removed(members, chain).collect()} == {(2, 1), (4, 3), (9, 1)}
    assert {(r.k, r.root) for r in dedup.clusters(chain).collect()} == {(k, 1) for k in (1, 2, 3, 4)}


def test_instruction_deduplication_against_a_loop(spark):
    rng = random.Random(12)
    rows = [(i, rng.choice(["", "a", "b", "c", "d", "e"]), f"p{rng.randrange(5)}", f"r{rng.randrange(3)}") for i in range(200)]
    want, ids, pairs = {}, set(), set()
    for i, key, prompt, answer in rows:
        reason = "missing_id" if not key else "duplicate_id" if key in ids else "duplicate_pair" if (prompt, answer) in pairs else None
        want[i] = reason
        if reason is None:
            ids.add(key)
            pairs.add((prompt, answer))
    df = spark.createDataFrame(rows, "ord long, id string, prompt_group string, response string")
    assert {r.ord: r.rejection for r in sft.deduplicate(df, "ord").collect()} == want


def test_packed_records_against_a_loop(spark):
    rng = random.Random(5)
    docs = [(i * 3, [rng.randrange(100) for _ in range(rng.choice([0, 1, 3, 7, 40]))]) for i in range(50)]
    stream = [x for _, ids in docs for x in ids]
    for width in (1, 4, 30):
        got = {r.record: r.tokens for r in packing.pack(spark.createDataFrame(docs, "doc_id long, ids array<int>"), width).collect()}
        assert got == {k: stream[k * (width + 1) : (k + 1) * (width + 1)] for k in range(len(stream) // (width + 1))}


def test_running_total_of_uneven_orders(spark):
    rng = random.Random(8)
    at = sorted({*range(0, 300), *(rng.randrange(10**12) for _ in range(200)), 10**15})
    rows = [(f"g{rng.randrange(3)}", k, rng.randrange(9)) for k in at]
    total, n, want = {}, {}, {}
    for g, k, v in rows:
        total[g], n[g] = total.get(g, 0) + v, n.get(g, 0) + 1
        want[k] = total[g], n[g]
    df = spark.createDataFrame(rows, "g string, k long, v long").repartition(5)
    assert {r.k: (r.total, r.total_n) for r in assemble.running_total(df, "g", "k", "v").collect()} == want


def test_language_outcomes(spark):
    rows = [("en", 0.9, "x" * 50, "expected_language_high_confidence"), ("en", 0.5, "x" * 50, "expected_language_low_confidence_kept"), ("fr", 0.9, "x" * 50, "unexpected_language"), ("fr", 0.1, "x" * 50, "expected_language_in_top_k"), ("fr", 0.9, "short", "too_short_for_reliable_detection"), ("fr", 0.9, " ", "empty_text"), ("fr", 0.9, None, "invalid_text_type")]
    p = language.LanguagePolicy(keep_low_confidence=True, keep_in_top_k=True)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, l string, c double, text string, want string")
    df = df.withColumn("predictions", F.array(F.struct(F.col("l").alias("language"), F.col("c").alias("confidence")), F.struct(F.lit("en").alias("language"), (1 - F.col("c")).alias("confidence"))))
    assert all(r.language_reason == r.want for r in language.decide(df, p).collect())
    none = df.withColumn("predictions", F.expr(f"cast(array() as {language.PREDICTIONS})")).where("i = 0")
    assert language.decide(none, p).collect()[0].language_reason == "no_prediction"
    with pytest.raises(ValueError):
        language.LanguagePolicy(minimum_confidence=2)


def test_language_detector_plug_in(spark):
    class Fake:
        def predict(self, text, top_k):
            return [("en" if "the" in text else "fr", 0.95)][:top_k]

    df = spark.createDataFrame([("the " * 20,), ("le " * 20,)], "text string")
    out = df.select(language.predictor(Fake, 1)(F.col("text")).alias("p")).collect()
    assert [r.p[0].language for r in out] == ["en", "fr"]


def test_license_rules(spark):
    p = licensing.LicensePolicy({"a": licensing.License(("A and B",)), "b": licensing.License((), requires_review=True), "c": licensing.License((), allowed=False)}, {"one": licensing.DatasetPolicy(("a", "b"), True), "any": licensing.DatasetPolicy(("a", "b"))})
    rows = [("one", "a, b", "review"), ("any", "A and B", "pass"), ("any", "a+c", "reject"), ("any", None, "reject"), ("none", "a", "reject"), ("one", "a", "review"), ("any", "zzz", "reject")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, dataset string, license string, want string")
    out = licensing.obligations(licensing.decide(licensing.normalize(df, p), p), p).orderBy("i").collect()
    assert [r.license_decision for r in out] == [r[2] for r in rows]
    assert out[3].license_reasons == ["missing_declared_license", "expected_license_missing"] and not out[3].commercial_use
    with pytest.raises(ValueError):
        licensing.LicensePolicy({"a": licensing.License(("x",)), "b": licensing.License(("X",))}, {})


def test_toxicity_branches(spark):
    df = spark.createDataFrame([(0, 0.1, False), (1, 0.8, False), (2, 0.99, True), (3, 0.99, False)], "i long, s double, m boolean")
    df = df.select("i", F.create_map(F.lit("toxic"), "s", F.lit("threat"), "s").alias("scores"), F.col("m").alias("medical_context"), F.lit(False).alias("educational_context"))
    out = toxicity.decide(df, toxicity.ToxicityPolicy(auto_reject=True)).orderBy("i").collect()
    assert [r.decision for r in out] == ["pass", "review", "review", "reject"]
    assert [r.risk for r in out] == ["low", "elevated", "high", "high"] and out[3].maximum_label == "toxic"
    assert out[2].reasons == ["high_score_with_protected_context", "medical_context_detected", "severe_label_threshold_exceeded"]
    c = toxicity.chunks(F.lit("a b c d e f g"), 3, 2)
    assert spark.range(1).select(c.alias("c")).collect()[0].c == ["a b c", "c d e", "e f g"]


def test_budget_and_evaluation_splits(spark):
    df = spark.createDataFrame([(i, "s", "abcd", 1) for i in range(8)], "doc_id long, source string, text string, tokens long")
    targets = spark.createDataFrame([("s", 2)], "source string, target long")
    taken, report = assemble.token_budget(df, targets, df.where("doc_id = 1"))
    assert sorted(r.doc_id for r in taken.collect()) == [0, 2]
    assert report.collect()[0].asDict() == {"source": "s", "target": 2, "documents": 2, "tokens": 2, "excluded_documents": 1, "exhausted": False}
    parts = assemble.evaluation_splits(df.where("doc_id > 1"), {"validation": 2, "test": 2}).collect()
    assert {(r.doc_id, r.split) for r in parts} == {(2, "validation"), (3, "validation"), (4, "test"), (5, "test")}


def test_running_totals_over_many_ranges(spark):
    rng = random.Random(1)
    rows = [(g, i * 37, rng.randrange(100)) for g in "ab" for i in range(900)]
    df = spark.createDataFrame(rows, "g string, o long, v long").repartition(5)
    want, sums = {}, {}
    for g, o, v in rows:
        s, n = sums.get(g, (0, 0))
        sums[g] = want[g, o] = (s + v, n + 1)
    assert {(r.g, r.o): (r.total, r.total_n) for r in assemble.running_total(df, "g", "o", "v").collect()} == want
    assert assemble.running_total(df.where("false"), "g", "o", "v").collect() == []


def test_packing_case(spark):
    df = spark.createDataFrame([(1, [1, 2, 3, 4, 5]), (2, [6, 7, 8]), (3, [9, 10, 11, 12, 13])], "doc_id long, ids array<int>")
    records = packing.pack(df, 4, per_shard=2)
    assert [(r.record, r.shard, r.tokens) for r in records.orderBy("record").collect()] == [(0, 0, [1, 2, 3, 4, 5]), (1, 0, [6, 7, 8, 9, 10])]
    v = packing.training_view(records).orderBy("record").collect()[0]
    assert (v.input_ids, v.labels, v.attention_mask) == ([1, 2, 3, 4], [2, 3, 4, 5], [1, 1, 1, 1])
    s = packing.statistics(df, 4).collect()[0]
    assert (s.records, s.tail, s.smallest, s.largest) == (2, 3, 1, 13)
    assert packing.token_type(16000) == "uint16" and packing.token_type(100000) == "uint32"
    with pytest.raises(ValueError):
        packing.token_type(100000, "uint16")
    with pytest.raises(Exception, match="outside"):
        packing.checked(df, 10).collect()


def test_sft_parse(spark):
    texts = ["Instruction:\nDo it.\n\nInput:\nthis\n\nResponse:\nDone.", "instruction: A\n\nOPTIONS: x\n\nResponse: one\n\nResponse:\ntwo", "Instruction:\nB\n\nResponse: ok", "no header", "Instruction:\nC", "Instruction:\n \n\nResponse: x"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    a, b, c, d, e, f = sft.parse(df).orderBy("i").collect()
    assert (a.instruction, a.context, a.context_type, a.response) == ("Do it.", "this", "input", "Done.") and a.prompt == "Instruction:\nDo it.\n\nInput:\nthis\n\nResponse:\n"
    assert (b.context_type, b.response) == ("options", "two") and b.context.startswith("x")
    assert (c.context_type, c.context, c.response, c.prompt) == ("none", "", "ok", "Instruction:\nB\n\nResponse:\n")
    assert [x.parse_error for x in (a, b, c, d, e, f)] == [None, None, None, "no_instruction_section", "no_response_section", "empty_instruction_or_response"]


def test_sft_dedup_follows_the_loop(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["", "a", "b", "c", "d"]), f"ask {rng.randrange(4)}", f"say {rng.randrange(3)}") for i in range(60)]
    ids, pairs, want = set(), set(), {}
    for i, key, ask, say in rows:
        if not key:
            want[i] = "missing_id"
        elif key in ids:
            want[i] = "duplicate_id"
        elif (ask, say) in pairs:
            want[i] = "duplicate_pair"
        else:
            ids.add(key)
            pairs.add((ask, say))
            want[i] = None
    df = spark.createDataFrame(rows, "ord long, id string, instruction string, response string").withColumns({"context": F.lit(""), "context_type": F.lit("none")})
    assert {r.ord: r.rejection for r in sft.deduplicate(sft.prompt_group(df), "ord").collect()} == want


def test_sft_split_is_exact_and_leak_free(spark):
    df = spark.createDataFrame([(i, f"s{i % 3}", hashlib.sha256(str(i // 2).encode()).hexdigest()) for i in range(400)], "i long, source string, prompt_group string")
    rows = sft.split_groups(df, 0.1, 0.1).collect()
    least = {}
    for r in rows:
        least[r.prompt_group] = min(r.source, least.get(r.prompt_group, r.source))
    for r in rows:
        x = int(hashlib.sha256(f"42:{least[r.prompt_group]}:{r.prompt_group}".encode()).hexdigest(), 16) / 2**256
        assert r.split == ("test" if x < 0.1 else "validation" if x < 0.2 else "train")
    assert sft.overlaps(spark.createDataFrame(rows), "prompt_group").count() == 0
    with pytest.raises(ValueError):
        sft.split_groups(df, 0.6, 0.5)


def test_masked_example(spark):
    e = spark.range(1).select(sft.masked_example(F.array(F.lit(5), F.lit(6)), F.array(*map(F.lit, (7, 8, 9))), 1, 2, 0, 6).alias("e")).collect()[0].e
    assert (e.input_ids, e.labels, e.attention_mask) == ([1, 5, 6, 7, 8, 2], [-100, -100, -100, 7, 8, 2], [1] * 6)
    e = spark.range(1).select(sft.masked_example(F.array(F.lit(5)), F.array(F.lit(7)), 1, 2, 0, 6).alias("e")).collect()[0].e
    assert (e.input_ids, e.labels, e.attention_mask) == ([1, 5, 7, 2, 0, 0], [-100, -100, 7, 2, -100, -100], [1, 1, 1, 1, 0, 0])


def test_statistics_and_comparison(spark):
    df = spark.createDataFrame([("a", 1.0, 2), ("a", 3.0, 2), ("b", 1.0, 1)], "s string, nll double, n long")
    out = {r.s: r for r in stats.weighted_loss(df, "s", "nll", "n").collect()}
    assert out["a"].loss == 1.0 and out["b"].perplexity == 2.7183
    left, right = spark.createDataFrame([("a", 1.0)], "s string, v double"), spark.createDataFrame([("a", 1.5), ("b", 2.0)], "s string, v double")
    assert {(r.s, r.left, r.right, r.difference) for r in stats.compare_sources(left, right, "s", "v").collect()} == {("a", 1.0, 1.5, 0.5), ("b", None, 2.0, None)}
    names = spark.createDataFrame([(" x ",), ("",), (None,)], "n string").select(stats.named(F.col("n")).alias("n"))
    assert [r.n for r in names.collect()] == ["x", "missing", "missing"]


def test_id_set_hash_and_epochs(spark):
    df = spark.createDataFrame([("b",), ("a",), ("a",)], "id string")
    assert assemble.id_set_hash(df, "id").collect()[0].ids_sha256 == hashlib.sha256(b"a\nb\n").hexdigest()
    assert assemble.id_set_hash(df.where("false"), "id").collect()[0].ids_sha256 == hashlib.sha256(b"").hexdigest()
    ids = spark.range(103).withColumnRenamed("id", "doc_id")
    whole = {(r.doc_id, r.batch, r.place) for r in assemble.epoch_order(ids, "doc_id", 1, 2, 10).collect()}
    later = {(r.doc_id, r.batch, r.place) for r in assemble.epoch_order(ids, "doc_id", 1, 2, 10, cursor=4).collect()}
    assert len(whole) == 103 and later == {x for x in whole if x[1] >= 4}
    assert {x[1] for x in whole} == set(range(11)) and assemble.epoch_order(ids, "doc_id", 1, 2, 10, drop_last=True).count() == 100


def test_pairs_of_prompts_with_one_opening(spark, tmp_path):
    rows = [(c, turn, role, text) for c, end in ((1, "red"), (3, "blue")) for turn, (role, text) in enumerate([("user", "Please answer " * 8 + end), ("assistant", "Yes.")])]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["ord"]: r["rejection"] for r in assembly_queries.sft_dedup_pairs(spark, str(tmp_path)).collect()}
    assert got == {1: None, 3: None, 1000001: "duplicate_id", 1000003: "duplicate_id"}


def test_licence_lists(spark):
    p = licensing.LicensePolicy({"cc-by-4.0": licensing.License(("CC BY 4.0",)), "gfdl": licensing.License()}, {"d": licensing.DatasetPolicy(("cc-by-4.0", "gfdl"))})
    rows = [(0, ["CC BY 4.0", "gfdl and odd"]), (1, []), (2, None), (3, [None, " "])]
    got = licensing.decide(licensing.normalize(spark.createDataFrame(rows, "i int, license array<string>").withColumn("dataset", F.lit("d")), p), p).orderBy("i").collect()
    assert [(r.declared, r.unknown_ids) for r in got] == [(["cc-by-4.0", "gfdl"], ["odd"]), ([], []), ([], []), ([], [])]
    assert ["missing_declared_license" in r.license_reasons for r in got] == [False, True, True, True]
    number = licensing.normalize(spark.createDataFrame([(7,)], "license int"), p).first()
    assert (number.declared, number.unknown_ids) == ([], ["7"])
