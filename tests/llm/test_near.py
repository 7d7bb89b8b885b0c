"""Near-dedup against all pairs in plain Python."""

import random
import re

from millrace.llm import near

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    sets = {}
    for i, t in rows:
        sets[i] = shingles(t)
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for x in range(len(ids)):
        for y in range(x):
            a, b = sets[ids[x]], sets[ids[y]]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                r, s = root(ids[x]), root(ids[y])
                up[max(r, s)] = min(r, s)
    return {i: (len(sets[i]), root(i)) for i in sets}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def made(seed, n=120):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(3000)}" for _ in range(rng.choice([3, 8, 60, 200]))] for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i * 7 % 1000, " ".join(w)))
    return rows


def test_against_all_pairs(spark):
    rows = made(1) + [(2001, None), (2002, ""), (2003, " \t\n"), (2004, "one two"), (2005, "ONE  two\n"), (2006, "w " * 30000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'x' as class_id", "1 as key")
    assert got(near.near_duplicates(df)) == brute(rows)


def test_blocks_of_a_large_family(spark):
    rows = made(2)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(near.near_duplicates(df, family=7)) == brute(rows)


def test_whole_documents_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert got(near.near_duplicates(df)) == brute(rows)


def test_edges_of_a_family(spark):
    """About one edge for each near copy, and the components of all buckets."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(600):
        w = list(words)
        for _ in range(rng.randrange(1, 6)):
            w[rng.randrange(400)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    dealt = near.sketch(df).select(near.F.col("doc_id").alias("rep"), near.F.explode("keys").alias("key"))
    edges = [(r.a, r.b) for r in near.stars(dealt).collect()]
    assert len(edges) < 2 * len(rows)
    assert near.near_duplicates(df, family=50).where("kept").count() == len({c for _, c in brute(rows).values()})
    buckets = {}
    for r in dealt.collect():
        buckets.setdefault(r.key, []).append(r.rep)
    up = list(range(600))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    def parts(pairs):
        up[:] = range(600)
        for a, b in pairs:
            up[max(root(a), root(b))] = min(root(a), root(b))
        return [root(i) for i in range(600)]

    assert parts(edges) == parts((b[0], x) for b in buckets.values() for x in b[1:])


def test_bands_keep_the_escape_probability():
    for percent in (60, 80, 85, 90):
        count, rows = near.bands(percent)
        assert (1 - (percent / 100) ** rows) ** count <= near.ESCAPE


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near.near_duplicates(empty).collect() == []
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "A B C D E F"), (3, None)], "doc_id long, text string")
    rows = sorted(near.near_duplicates(df).collect(), key=str)
    assert len(rows) == 5
    assert {(r.doc_id, r.component_id, r.kept) for r in rows} == {(None, None, True), (1, 1, True), (2, 1, False), (3, 3, True)}


def test_estimate_is_close():
    import numpy as np

    rng = np.random.default_rng(5)
    for share in (0.2, 0.6, 0.9):
        a = rng.integers(0, 2**63, 4000).astype(np.uint64)
        b = np.concatenate([a[: int(4000 * share)], rng.integers(0, 2**63, 4000 - int(4000 * share)).astype(np.uint64)])
        ra, rb = near.registers(a), near.registers(b)
        up, down = int((ra > rb).sum()), int((ra < rb).sum())
        true = int(4000 * share) / (8000 - int(4000 * share))
        assert abs(near.estimate(up, down, 4000, 4000, len(ra)) - true) < 0.12
        assert (near.registers(np.concatenate([a, b])) == np.maximum(ra, rb)).all()
