"""The pipeline's stages, each against plain Python on its own input."""

import random

import corpus_pipeline
import pytest

from millrace.llm import pii, quality
from tests.llm import test_near, test_pack, test_suffix


@pytest.fixture(scope="module")
def stages(spark, sf):
    """The input of each stage and the last result, collected."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        rows = docs.collect()
        docs = spark.createDataFrame(rows, docs.schema)
        out.append(rows)
    return out


def test_quality(spark, stages):
    docs = spark.createDataFrame(stages[0])
    verdicts = {r.doc_id: r.kept for r in quality.judge(docs).collect()}
    assert sorted(r.doc_id for r in stages[1]) == sorted(i for i, k in verdicts.items() if k)
    assert set(stages[1]) <= set(stages[0]) and 0 < len(stages[1]) < len(stages[0])


def test_near_duplicates(stages, monkeypatch):
    def brute80(rows):
        sets = {i: test_near.shingles(t) for i, t in rows}
        ids, up = sorted(sets), {i: i for i in sets}

        def root(i):
            while up[i] != i:
                i = up[i]
            return i

        for x in range(len(ids)):
            for y in range(x):
                a, b = sets[ids[x]], sets[ids[y]]
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    r, s = root(ids[x]), root(ids[y])
                    up[max(r, s)] = min(r, s)
        return {i for i in ids if root(i) == i}

    assert {r.doc_id for r in stages[2]} == brute80([(r.doc_id, r.text) for r in stages[1]])
    assert set(stages[2]) <= set(stages[1])


def test_repeats(stages):
    gone = test_suffix.brute([(r.doc_id, r.text) for r in stages[2]])
    before = {r.doc_id: r for r in stages[2]}
    assert len(stages[3]) == len(before)
    for r in stages[3]:
        old = before[r.doc_id]
        words = test_suffix.WORD.findall(old.text.encode())
        assert test_suffix.WORD.findall(r.text.encode()) == [w for k, w in enumerate(words) if k not in gone.get(r.doc_id, ())]
        assert (r.lang, r.source, r.n_chars) == (old.lang, old.source, len(r.text))


def test_personal_data(stages):
    before = {r.doc_id: r for r in stages[3]}
    assert len(stages[4]) == len(before)
    for r in stages[4]:
        assert not pii.base_spans(r.text) or r.text != before[r.doc_id].text
        if not pii.base_spans(before[r.doc_id].text) and not pii.proposals(before[r.doc_id].text, []):
            assert r == before[r.doc_id]


def test_packed(stages):
    test_pack.holds(stages[5], {r.doc_id: r.text for r in stages[4]})


def test_near_dedup_with_repeated_and_missing_ids(spark):
    from millrace.llm import near

    t = "one two three four five six seven"
    rows = [(None, t), (None, t), (1, t), (1, t), (2, t), (3, None), (4, ""), (5, "other words are here and here again"), (5, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as _n")
    got = sorted(((r.doc_id, r.text) for r in near.keep_first(df).collect()), key=str)
    assert got == sorted([(None, t), (None, t), (1, t), (3, None), (4, ""), (5, "other words are here and here again")], key=str)


def test_run(spark, sf, stages):
    rows = corpus_pipeline.run(spark, sf).collect()
    assert sum(r.length for r in rows) == sum(r.length for r in stages[5])


def words(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def test_edges_of_the_whole_run(spark, tmp_path):
    """Null and repeated ids, null and very long texts, long white space, repeated rows, clashing columns."""
    base = [(i, words(80 + i, i), "en", "s") for i in range(40)]
    odd = [(None, words(90, 100), None, None), (None, words(95, 101), "en", "s"), (3, base[3][1], "en", "s"), (3, words(99, 102), "en", "s"), (50, None, "en", "s"), (51, "", "en", "s"), (52, base[5][1], "en", "s")]
    odd += [(53, words(60, 103) + "\n" * 500_000 + words(60, 104), "en", "s"), (54, words(150_000, 105), "en", "s"), (55, base[7][1] + " " + words(60, 106), "en", "s"), (56, "mail a@b.co " + words(70, 107), "en", "s")]
    rows = [(*r, len(r[1] or ""), 1, "x", 2) for r in base + odd]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words int, spans string, place int")
    held, names = docs, docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        held = stage(spark, held, "")
        assert held.columns == names
        held = spark.createDataFrame(held.collect(), held.schema)
    got = held.collect()
    ids = sorted((r.doc_id for r in got if r.doc_id is not None))
    assert {50, 51, 52}.isdisjoint(ids) and {53, 54, 55, 56} <= set(ids) and len(ids) == len(set(ids)) and sum(r.doc_id is None for r in got) == 2
    by = {r.doc_id: r for r in got}
    assert base[7][1] not in by[55].text and "[EMAIL]" in by[56].text and all(r.n_chars == len(r.text) for r in got)
    packed = corpus_pipeline.STAGES[-1][1](spark, held, "").collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in got}
    for name in ("documents", "empty"):
        (docs if name == "documents" else docs.where("false")).write.parquet(f"{tmp_path}/{name}/documents.parquet")
    assert sum(r.length for r in corpus_pipeline.run(spark, f"{tmp_path}/documents").collect()) == sum(r.length for r in packed)
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").collect() == []
