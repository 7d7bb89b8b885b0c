"""Repeated passages against every run in plain Python."""

import random
import re
from collections import defaultdict

import numpy as np

from millrace.llm import suffix

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(rows, least=50):
    """For each document the words that lie in a run with an earlier copy."""
    first, words = {}, {}
    for i, t in sorted(rows):
        words[i] = WORD.findall((t or "").encode())
        for a in range(len(words[i]) - least + 1):
            first.setdefault(tuple(words[i][a : a + least]), (i, a))
    out = defaultdict(set)
    for i, w in words.items():
        for a in range(len(w) - least + 1):
            if first[tuple(w[a : a + least])] != (i, a):
                out[i].update(range(a, a + least))
    return dict(out)


def got(rows, df):
    texts, out = dict(rows), defaultdict(set)
    for r in df.collect():
        span = set(range(r.start_word, r.end_word))
        assert not span & out[r.doc_id]
        out[r.doc_id] |= span
        piece = texts[r.doc_id].encode()[r.start_byte : r.end_byte]
        assert WORD.findall(piece) == WORD.findall(texts[r.doc_id].encode())[r.start_word : r.end_word]
        assert r.copy_of and all(x <= r.doc_id for x in r.copy_of)
    return dict(out)


def made(seed):
    rng = random.Random(seed)
    words = [f"é{i}" for i in range(400)]
    passages = [[rng.choice(words) for _ in range(n)] for n in (49, 50, 51, 70, 200)]
    rows = []
    for i in range(60):
        w = [rng.choice(words) for _ in range(rng.randrange(150))]
        for _ in range(rng.choice([0, 1, 2])):
            p = rng.choice(passages)
            p = p[rng.randrange(10) :] if rng.random() < 0.4 else p
            at = rng.randrange(len(w) + 1)
            w[at:at] = p
        rows.append((i * 13 % 61, " \n".join(w)))
    rows += [(100 + i, rows[0][1]) for i in range(5)] + [(200, "w " * 400), (201, None), (202, ""), (203, "few words")]
    return rows


def test_against_every_run(spark):
    for seed in (1, 2, 3):
        rows = made(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as place", "2 as g").repartition(3)
        assert got(rows, suffix.repeated_spans(df)) == brute(rows)
        assert got(rows, suffix.repeated_spans(df, group=2)) == brute(rows)  # nearly all groups by fingerprints


def test_comparison_of_surroundings():
    """Sorting and comparing neighbours against every pair of runs."""
    rng = random.Random(5)
    for _ in range(200):
        least, gram = 12, 4
        segments, offsets = [], []
        for _ in range(rng.randrange(1, 12)):
            o, r = rng.randrange(least - gram + 1), rng.randrange(gram, least + 1)
            if o + r < least:
                r = least - o
            segments.append(np.array([rng.choice([1, 1, 1, 2]) for _ in range(o)] + [7] * gram + [rng.choice([3, 3, 3, 4]) for _ in range(r - gram)], np.uint64))
            offsets.append(o)
        keys = np.array([[rng.randrange(5), 100 * i] for i in range(len(segments))])
        runs = defaultdict(list)
        for i, s in enumerate(segments):
            for a in range(max(0, offsets[i] + gram - least), min(offsets[i], len(s) - least) + 1):
                runs[a - offsets[i], tuple(s[a : a + least])].append((keys[i, 0], keys[i, 1] + a, i, a))
        want = {(i, a, min(v)[2]) for v in runs.values() for d, w, i, a in v if (d, w) != min(v)[:2]}
        found = {x for part in suffix.compare(segments, np.array(offsets), keys, least, gram) for x in zip(*(p.tolist() for p in part))}
        assert found == want


def test_whole_documents_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert got(rows, suffix.repeated_spans(df)) == brute(rows)


def test_removal(spark):
    rows = made(4)
    df = spark.createDataFrame([(i, t, len(t or ""), "en") for i, t in rows], "doc_id long, text string, n_chars long, lang string")
    out = suffix.remove_repeats(df)
    assert out.columns == df.columns
    gone, back = brute(rows), {r.doc_id: r for r in out.collect()}
    assert len(back) == len(rows)
    for i, t in rows:
        if i not in gone:
            assert back[i].text == t
            continue
        w = WORD.findall(t.encode())
        assert WORD.findall(back[i].text.encode()) == [x for k, x in enumerate(w) if k not in gone[i]]
        assert back[i].n_chars == len(back[i].text)


def test_clashing_names(spark):
    rows = made(6)
    df = spark.createDataFrame([(i, t, "a", b"b", 3, "d") for i, t in rows], "doc_id long, text string, spans string, raw binary, cut int, _spans string")
    out = suffix.remove_repeats(df)
    assert out.columns == df.columns and {(r.spans, bytes(r.raw), r.cut, r._spans) for r in out.collect()} == {("a", b"b", 3, "d")}


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffix.repeated_spans(empty).collect() == [] and suffix.remove_repeats(empty).collect() == []
    t = " ".join(map(str, range(60)))
    df = spark.createDataFrame([(None, t), (None, t), (1, t), (1, t), (2, None)], "doc_id long, text string")
    assert suffix.repeated_spans(df).collect() == []
    assert suffix.remove_repeats(df).count() == 5
