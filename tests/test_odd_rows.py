"""Queries on documents that are blank, missing or beyond ASCII, against their SQL."""

import os
import shutil
from collections import Counter

import duckdb
import pytest

from millrace.plans import catalogue

TEXTS = ["", "", " ", "\t\n", "\xa0　", "\tx \n", "ﬁnance Ａ is", "finance A is", "á b", "\xe1 b", "x" * 39, "\t" + "z" * 38 + "\t", "one two\x85three\x1cfour", None, None]


@pytest.fixture(scope="module")
def odd(sf, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    con = duckdb.connect()
    for name in ("benchmark", "labels"):
        shutil.copy(f"{sf}/{name}.parquet", folder)
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    con.execute(f"CREATE TABLE documents AS SELECT * FROM '{sf}/documents.parquet' ORDER BY doc_id LIMIT 20")
    for k, t in enumerate(TEXTS):
        con.execute("INSERT INTO documents (doc_id, text, lang, source, n_chars) VALUES (?, ?, ?, ?, ?)", [100_000 + k, t, ("en", "fr")[k % 2], f"src{k % 3}", len(t or "")])
    con.execute(f"COPY documents TO '{os.path.join(folder, 'documents.parquet')}' (FORMAT parquet)")
    return con, folder


def same(spark, odd, name):
    con, folder = odd
    df = catalogue.queries()[name](spark, folder)
    cursor = con.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert Counter(tuple(str(r[c]) for c in names) for r in df.collect()) == Counter(tuple(map(str, r)) for r in cursor.fetchall())


@pytest.mark.parametrize("name", ["distinct_documents_by_source", "global_dedup_priority"])
def test_blank_texts_are_compared_with_all_others(spark, odd, name):
    same(spark, odd, name)


def test_blank_texts_are_short(spark, odd):
    same(spark, odd, "language_decision")


@pytest.mark.parametrize("name", ["packed_records", "packing_stats", "word_sentence_counts"])
def test_a_blank_text_is_one_empty_word(spark, odd, name):
    if name == "word_sentence_counts":  # its SQL has nulls for a missing text
        con, folder = odd
        want = {k: 1 for k in range(100_000, 100_005)}
        assert {r.doc_id: r.space_words for r in catalogue.queries()[name](spark, folder).collect() if r.doc_id in want} == want
    else:
        same(spark, odd, name)
