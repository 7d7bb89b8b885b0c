"""The class model against plain Python, its sum over the vocabulary, and held-out perplexity."""

import math
import re
import tracemalloc
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import lm
from millrace.llm.store import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows):
    """Base columns of each row."""
    made = []
    for i, t in rows:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        made.append((i, zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0, [*words, None]))
    c = Counter(w for _, held, ws in made if not held for w in ws)
    n, v = sum(c.values()), len(c)
    return {i: (held, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for i, held, ws in made}


@pytest.mark.parametrize("head", [1 << 18, 300])
def test_base_columns(spark, sf, monkeypatch, head):
    monkeypatch.setattr(lm, "HEAD", head)
    df = spark.read.parquet(f"{sf}/documents.parquet")
    want = plain([(r.doc_id, r.text) for r in df.collect()])
    rows = {r.doc_id: r for r in lm.score(df).collect()}
    assert set(rows) == set(want)
    for i, (held, n, known, total, base) in want.items():
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)


def test_head_and_join_agree(spark, sf, monkeypatch):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    whole = {r.doc_id: r.score for r in lm.score(df).collect()}
    monkeypatch.setattr(lm, "HEAD", 2000)
    part = {r.doc_id: r.score for r in lm.score(df).collect()}
    assert all(part[i] == pytest.approx(whole[i], rel=1e-9) for i in whole)


def learnt(docs, spark):
    """(class, count) of every training token, by fingerprint, and the model."""
    model, tail = lm.train_model(docs, Scratch(spark, "test"))
    held = {p: (c, n) for p, c, n in zip(model.head.tolist(), model.head_class.tolist(), model.head_n.tolist())}
    held |= {int(np.int64(r["print"]).view(np.uint64)): (r["class"], r["n"]) for r in tail.collect()}
    return model, held


@pytest.mark.parametrize("head", [1 << 18, 300])
def test_score_against_plain_python(spark, sf, monkeypatch, head):
    """The class bigram computed anew from the learnt classes: transitions, emissions, unseen words."""
    monkeypatch.setattr(lm, "HEAD", head)
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    strange = spark.createDataFrame([(90_000 + i, "unseen%d words the" % i) for i in range(30)], "doc_id long, text string").where("crc32(cast(cast(doc_id as string) as binary)) % 10 = 0")
    df = df.union(strange)
    model, held = learnt(lm.split(df), spark)
    rows = {}
    for r in df.collect():
        p, shape, _ = lm.tokens(pa.array([r.text]))
        seen = [held.get(x, (int(model.shape_class[s]), 0)) for x, s in zip(p.tolist(), shape.tolist())]
        rows[r.doc_id] = zlib.crc32(str(r.doc_id).encode()) % 10 == 0, seen
    moves, mass, kinds = Counter(), Counter(), Counter()
    for out, seen in rows.values():
        if not out:
            moves.update(zip([model.end_class, *(c for c, _ in seen[:-1])], (c for c, _ in seen)))
    for c, n in held.values():
        mass[c] += n
        kinds[c] += 1
    k, begins = len(model.mass), Counter()
    for (a, _), n in moves.items():
        begins[a] += n
    for r in lm.score(df).collect():
        _, seen = rows[r.doc_id]
        before, want = model.end_class, 0.0
        for c, n in seen:
            want += math.log10((moves[before, c] + lm.TRANSITION) / (begins[before] + lm.TRANSITION * k))
            want += math.log10((n + lm.EMISSION) / (mass[c] + lm.EMISSION * (kinds[c] + 1)))
            before = c
        assert r.score == pytest.approx(want, rel=1e-9)
        assert r.perplexity == pytest.approx(10 ** (-want / len(seen)), rel=1e-9)


def test_it_beats_the_base(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    held = lm.score(df).where("held_out").selectExpr("sum(score) s", "sum(base_score) b").collect()[0]
    assert held.s > held.b


def test_exchange_finds_planted_classes():
    rng = np.random.default_rng(3)
    size, k = 40, 4
    of = np.arange(size) % k
    follow = np.full((k, k), 1.0)
    follow[np.arange(k), (np.arange(k) + 1) % k] = 60
    pairs = rng.poisson(follow[of][:, of]).astype(float)
    got = lm.exchange(pairs, k)
    assert len({(a, b) for a, b in zip(of, got)}) == k


def test_contexts_of_a_task_stay_small():
    """Two tasks share an executor: one holds at most 150 MB of arrays however many contexts it meets, and loses none of them."""
    rng = np.random.default_rng(5)
    vocabulary = np.array([f"{'Wé9'[i % 3]}{i}" for i in range(400_000)], object)
    ids = np.where(rng.random(1_600_000) < 0.4, rng.integers(0, 50, 1_600_000), rng.integers(0, 400_000, 1_600_000)).reshape(-1, 800)
    texts = pa.array([" ".join(x) for x in vocabulary[ids]])
    prints, shape, _ = lm.tokens(pa.array(vocabulary))
    prints, shape = prints[::2], shape[::2]  # without the ends
    named = np.sort(np.append(prints[:50], lm.END))
    of = np.arange(lm.SYMBOLS + lm.SHAPES) * 7 % lm.CLASSES
    broadcast = SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x))
    train = SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=broadcast), mapInArrow=lambda run, schema: run)
    train.select = lambda column: train
    run = lm.count_contexts(train, named, np.arange(51), of)
    got, shapes = Counter(), {}
    tracemalloc.start()
    try:
        made = list(run(iter([pa.record_batch([texts], ["text"])])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    for batch in made:
        for p, s, cells, ns in zip(*(batch.column(x).to_pylist() for x in ("print", "shape", "cells", "ns"))):
            shapes[p] = s
            for cell, n in zip(cells, ns):
                got[p, cell] += n
    signed = prints.view(np.int64).tolist()
    symbol = {p: i for i, p in enumerate(named.view(np.int64).tolist())}
    classes = [int(of[symbol.get(p, lm.SYMBOLS + s)]) for p, s in zip(signed, shape.tolist())]
    end, want = int(of[symbol[int(lm.END.view(np.int64))]]), Counter()
    for text in ids.tolist():
        c = [end, *(classes[i] for i in text), end]
        for at, i in enumerate(text):
            if i >= 50:
                want[signed[i], c[at]] += 1
                want[signed[i], lm.CLASSES + c[at + 2]] += 1
    assert got == want
    assert shapes == {signed[i]: int(shape[i]) for i in np.unique(ids[ids >= 50]).tolist()}
    assert peak < 150e6


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score(empty).collect() == []
    df = spark.createDataFrame([(None, "A b"), (1, None), (1, None), (2, "a a  B\n"), (3, ""), (4, "w " * 3000)], "doc_id long, text string").selectExpr("*", "1 as n", "2 as row")
    rows = lm.score(df).collect()
    want = plain([(r.doc_id, r.text) for r in df.collect()])
    assert len(rows) == 6
    for r in rows:
        held, n, known, total, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total) and r.base_score == pytest.approx(base)
    only_held = spark.createDataFrame([(None, "a")], "doc_id long, text string")
    r = lm.score(only_held).collect()[0]
    assert (r.n_tokens, r.n_known, r.train_tokens) == (2, 0, 0) and math.isfinite(r.score)
