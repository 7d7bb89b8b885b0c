"""The registered queries: contract columns, and the same rows as their DuckDB twins."""

import base64
import glob
import hashlib
import os
from collections import defaultdict

import duckdb
import public_tokenizers as P
import pytest
import tiktoken

from millrace.llm import lm, quality, queries
from tests.llm import test_pack, test_suffix

COLUMNS = {
    "op1_": "vec_id n_links component_id kept", "op2_": "doc_id held_out n_tokens n_known train_tokens base_score score", "op4_": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op5_": "doc_id start length ids_crc32 doc_tokens sequence_id offset", "op7_": "page_id payload_bytes payload_digest record_type refers_to", "op8_": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op9_": "doc_id n_shingles component_id kept", "op10_": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_twins(spark, sf, name):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = queries.queries()[name](spark, sf)
    columns = sorted(df.columns)
    cursor = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted(tuple(str(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert sorted(tuple(str(r[c]) for c in columns) for r in df.collect()) == want


def test_contract_columns(spark, sf):
    registered = queries.queries()
    assert [sum(n.startswith(f"op{k}_") for n in registered) for k in range(1, 11)] == [1] * 10 and "pipeline" in registered
    for prefix, wanted in COLUMNS.items():
        if prefix in ("op5_", "op8_"):
            df = registered[next(n for n in registered if n.startswith(prefix))](spark, sf)
            assert set(wanted.split()) <= set(df.columns)


def rows(spark, sf, prefix):
    registered = queries.queries()
    return registered[next(n for n in registered if n.startswith(prefix))](spark, sf).collect()


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def test_encoding_equals_the_library(spark, sf, texts):
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = rows(spark, sf, "op4_")
    assert {r.doc_id for r in got} == set(texts)
    for r in got:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_packing_and_passages(spark, sf, texts):
    test_pack.holds(rows(spark, sf, "op5_"), texts)
    found = defaultdict(set)
    for r in rows(spark, sf, "op3_"):
        found[r.doc_id] |= set(range(r.start_word, r.end_word))
        assert r.copy_of
    assert found == test_suffix.brute(texts.items())


def test_trained_columns_follow_their_operators(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id: (r.kept, r.distance) for r in quality.judge(docs.repartition(3)).collect()}
    assert {r.doc_id: (r.kept, r.distance) for r in rows(spark, sf, "op10_")} == want
    want = {r.doc_id: r.score for r in lm.score(docs.repartition(3)).collect()}
    assert {r.doc_id: r.score for r in rows(spark, sf, "op2_")} == pytest.approx(want, rel=1e-9)
