"""Quality statistics against plain Python, and the robust distances on planted outliers."""

import random
import re
from collections import Counter

import numpy as np

from millrace.llm import quality
from millrace.llm.store import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count, at = Counter(tri), set()
    for i, k in enumerate(tri):
        if count[k] > 1:
            at |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(at)


def stats(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words


def test_whole_documents_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in df.collect()}
    rows = quality.judge(df).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert stats(r) == brute(texts[r.doc_id])
        n, rep = r.n_words, r.n_repeat_words
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n)
        assert not (r.base_failed and r.kept)


def test_odd_texts(spark):
    rng = random.Random(8)
    texts = [None, "", " \n\t\x0b\x0c\r ", "if", "\x0coff\x0b", "a b c a b c", "x\n\nx\nx ", "é ü 🎉\n🎉 <|>", "a " * 5000, " ".join(rng.choice("abcdefgh") for _ in range(3000)), " x y", "one\ntwo\none\n \n \n"]
    df = spark.createDataFrame([(i, t, None, None, 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n int")
    got = {r.doc_id: stats(r) for r in quality.judge(df).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_outliers_go_and_clean_rows_stay(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghijklmno") for _ in range(rng.randrange(2, 9))) for _ in range(4000)]
    rows = []
    for i in range(700):
        w = [rng.choice(words) for _ in range(rng.randrange(60, 300))]
        if i % 10 == 0:
            w = [x + "###$$$" for x in w]
        rows.append((i, " ".join(w), "en", f"s{i % 2}"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.kept for r in quality.judge(df).collect()}
    assert all(got[i] == (i % 10 != 0) for i in got)
    kept = quality.filter_documents(df)
    assert kept.columns == df.columns and kept.count() == 630


def test_cholesky_distance(spark):
    rng = np.random.default_rng(2)
    d = len(quality.FEATURES)
    a = rng.normal(size=(d, d))
    cov, mean, x = a @ a.T, rng.normal(size=d), rng.normal(size=(20, d))
    names = ["grp", *(f"m_{i}" for i in range(d)), *(f"c_{i}_{j}" for i in range(d) for j in range(i + 1))]
    moments = spark.createDataFrame([("a", *map(float, mean), *(float(cov[i, j]) for i in range(d) for j in range(i + 1)))], names)
    rows = spark.createDataFrame([("a", *map(float, v)) for v in x], ["grp", *quality.FEATURES])
    got = [r.d for r in rows.join(quality._factor(moments), "grp").select(quality._distance().alias("d")).collect()]
    floor = np.diag([quality.FLOOR[f] ** 2 for f in quality.FEATURES])
    want = [(v - mean) @ np.linalg.inv(cov + floor) @ (v - mean) for v in x]
    assert np.allclose(sorted(got), sorted(want), rtol=1e-9)


def concentrated(x, at, rounds=60):
    """Regularised concentration steps from the rows `at`, on distances rounded as the operator rounds them."""
    floor, last = np.diag([quality.FLOOR[f] ** 2 for f in quality.FEATURES]), np.inf
    for _ in range(rounds):
        mean, cov = x[at].mean(axis=0), np.cov(x[at].T, bias=True) + floor
        det = np.linalg.slogdet(cov)[1] / 2
        if det > last - 1e-6:
            break
        last, v = det, x - mean
        far = np.round(np.log1p(np.einsum("ij,jk,ik->i", v, np.linalg.inv(cov), v)), 3)
        at = far <= np.sort(far)[int(np.ceil(quality.CORE * len(x))) - 1]
    return last


def test_least_determinant(spark):
    """One group against many random starts in numpy: as in any such search the least found need not be the least there is."""
    rng = np.random.default_rng(11)
    d = len(quality.FEATURES)
    x = np.vstack([rng.normal(size=(300, d)) @ rng.normal(size=(d, d)), rng.normal(size=(60, d)) * 0.5 + 6, rng.normal(size=(40, d)) * 3 - 5])
    rows = spark.createDataFrame([(False, "en", "s", *map(float, v)) for v in x], ["base_failed", "lang", "source", *quality.FEATURES])
    fit = {r.grp: r for r in quality.estimates(rows, Scratch(spark, "test")).collect()}
    assert len(fit) == 3 and {r.n for r in fit.values()} == {400}
    got = sum(np.log(fit["a"][f"l_{i}_{i}"]) for i in range(d))
    others = [concentrated(x, rng.choice(400, d + 1, replace=False)) for _ in range(200)]
    assert got <= np.median(others) + 0.02
    # no step makes it smaller
    low = np.array([[fit["a"][f"l_{i}_{j}"] if j <= i else 0.0 for j in range(d)] for i in range(d)])
    z = np.linalg.solve(low, (x - [fit["a"][f"m_{i}"] for i in range(d)]).T)
    far = np.round(np.log1p((z * z).sum(axis=0)), 3)
    assert concentrated(x, far <= np.sort(far)[int(quality.CORE * 400) - 1]) >= got - 0.02


def test_distance_and_cut(spark):
    """The deviates of a group from its estimate, in plain Python."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(500)]
    rows = [(i, " ".join(rng.choice(words) + ("#" if rng.random() < 0.02 * (i % 5) else "") for _ in range(rng.randrange(60, 200))), "en", "s") for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    vectors = quality.vectors(quality.statistics(df))
    fit = {r.grp: r for r in quality.estimates(vectors, Scratch(spark, "test")).collect()}["s\x01en\x01s"]
    d = len(quality.FEATURES)
    low = np.array([[fit[f"l_{i}_{j}"] if j <= i else 0.0 for j in range(d)] for i in range(d)])
    want = {}
    for r in vectors.collect():
        z = np.linalg.solve(low, [r[f] - fit[f"m_{i}"] for i, f in enumerate(quality.FEATURES)])
        want[r.doc_id] = (np.cbrt(z @ z) - fit.centre) / fit.spread
    roots = sorted(want.values())
    assert abs(roots[59]) < 0.02 and abs(roots[89] - quality.QUARTILE) < 0.05
    for r in quality.judge(df).collect():
        assert abs(r.distance - want[r.doc_id]) < 2e-3 and (r.base_failed or r.kept == (want[r.doc_id] <= quality.CUT))


def test_quantiles(spark):
    rng = random.Random(7)
    rows = [(f"g{rng.randrange(3)}", rng.choice([0.0, rng.random()])) for _ in range(500)]
    df = spark.createDataFrame(rows, "grp string, v double")
    got = {r.grp: (r.v_a, r.v_b, r.n) for r in quality._quantiles(df, ["grp"], {"v": quality.F.col("v")}, {"v:a": 0.5, "v:b": 0.75}).collect()}
    for g, (a, b, n) in got.items():
        v = sorted(round(x, 3) for k, x in rows if k == g)
        assert n == len(v) and abs(a - v[-(-n // 2) - 1]) < 1e-9 and abs(b - v[-(-3 * n // 4) - 1]) < 1e-9


def test_filter_with_clashing_names(spark):
    text = " ".join(f"word{i}" for i in range(80))
    df = spark.createDataFrame([(None, text, None, None, 1, "a", 2.0), (None, text, None, None, 1, "a", 2.0), (3, None, "en", "s", 1, "b", 0.0)], "doc_id long, text string, lang string, source string, n_words int, grp string, distance double")
    kept = quality.filter_documents(df)
    assert kept.columns == df.columns and sorted(map(tuple, kept.collect()), key=str) == sorted(map(tuple, df.where("text is not null").collect()), key=str)
    assert quality.filter_documents(df.where("false")).count() == 0


def test_edges(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert quality.judge(df).collect() == []
    twice = spark.createDataFrame([(None, None, None, None), (1, "w", "en", "s"), (1, "w", "en", "s")], df.schema)
    rows = quality.judge(twice).collect()
    assert len(rows) == 3 and not any(r.kept for r in rows)
    assert quality.filter_documents(twice).count() == 0
