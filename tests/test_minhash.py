"""Signatures of whole tables: one hash for each shingle, permuted."""

import random

import pytest

from millrace.operators import minhash


def test_signatures_are_least_permuted_hashes(spark):
    rng = random.Random(2)
    sets = [[f"s{x}" for x in rng.sample(range(1000), 200)]]
    sets += [sets[0][:190] + [f"t{k}" for k in range(10)], [f"u{k}" for k in range(70_000)], [], ["one"], None]
    df = spark.createDataFrame(list(enumerate(sets)), "k long, shingles array<string>").coalesce(1)
    rows = {r.k: r.signature for r in minhash.signatures(df, "k").collect()}
    assert sorted(rows) == [0, 1, 2, 4] and all(len(s) == 128 for s in rows.values())
    hashes = {r.k: [h % 2**64 for h in r.h] for r in df.selectExpr("k", "transform(shingles, s -> xxhash64(s)) AS h").collect() if r.h}
    made = minhash._constants(128, 1)
    for k in (0, 1, 4):
        assert [x % 2**64 for x in rows[k]] == [min((h ^ m) * f % 2**64 for h in hashes[k]) for m, f in made]
    assert [rows[2][i] % 2**64 for i in (0, 127)] == [min((h ^ m) * f % 2**64 for h in hashes[2]) for m, f in (made[0], made[127])]
    same = sum(a == b for a, b in zip(rows[0], rows[1], strict=True)) / 128
    assert same == pytest.approx(190 / 210, abs=0.15)
    assert [(r.a, r.b) for r in minhash.candidates(minhash.signatures(df, "k"), "k", 0.7).collect()] == [(0, 1)]
