"""The training-data operators do the whole job: cases that a cut or a cap would change."""

import time

import numpy as np
import pyarrow as pa

from millrace.llm import license, lm, pii, words as W
from millrace.llm.store import Scratch


def test_long_secret_is_one_span(spark):
    value = "aB3." * 1500  # longer than any bound on a token
    text = f"config token = {value} and more"
    start = text.index("token")
    assert [x[:3] for x in pii.proposals(text, pii.base_spans(text)) if x[0] == 7] == [(7, start, text.index(" and more"))]
    docs = spark.createDataFrame([(i, f"note {i} password = {value}x{i} end") for i in range(8)], "doc_id long, text string")
    left = [r["text"] for r in pii.redact(docs).orderBy("doc_id").collect()]
    assert left == [f"note {i} [SECRET] end" for i in range(8)]


def test_long_secret_takes_linear_time():
    text = "1 token = " + "a" * 400_000
    began = time.monotonic()
    assert [x[1:3] for x in pii.proposals(text, []) if x[0] == 7] == [(2, len(text))]
    assert time.monotonic() - began < 20


def test_rare_words_get_classes_from_their_contexts(spark):
    # more frequent words than symbols, in two kinds that alternate; the rare words are of one shape
    a, b = ([f"{x}{i}" for i in range(600)] for x in ("ka", "9z"))
    rare = {f"q{i:03d}w": int(i > 0) for i in range(40)}  # the first has other neighbours than the rest
    texts = [" ".join(w for i in range(600) for w in (a[(i * 7 + r) % 600], b[(i * 11 + r) % 600])) for r in range(12)]
    texts += [f"{b[0]} {w} {b[1]} {b[0]} {w} {b[1]}" if kind else f"{a[0]} {w} {a[1]} {a[0]} {w} {a[1]}" for w, kind in rare.items()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("held_out", lm.F.lit(False))
    model, _ = lm.train_model(docs, Scratch(spark, "test"))
    prints = W.Words(pa.array([" ".join(rare)])).prints
    of = model.head_class[np.searchsorted(model.head, prints)]
    kinds = np.array(list(rare.values()))
    assert set(of[kinds == 0]).isdisjoint(of[kinds == 1])


def test_words_beyond_the_head_keep_their_classes(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    whole = {r["doc_id"]: r for r in lm.score(docs).collect()}
    monkeypatch.setattr(lm, "HEAD", 1000)
    for r in lm.score(docs).collect():
        for c in ("n_tokens", "n_known", "base_score", "score"):
            assert abs(r[c] - whole[r["doc_id"]][c]) < 1e-6 * (1 + abs(r[c]))


def test_wrapped_notices(spark):
    texts = {
        "gpl-3": "Some prose stands here.\nThis work is licensed under the GNU General Public License,\nversion 3.\nMore prose stands there.",
        "gpl-2": "This work is licensed under the GNU General Public License,\nversion 2.",
        "proprietary": "No part of this publication may be reproduced without the prior\nwritten permission of the publisher.",
        "cc0": "The author has dedicated the work to the public\ndomain by waiving all rights under\nCC0 1.0 Universal",
        "lgpl": "under the terms of the GNU Lesser\nGeneral Public License as published by the\nFree Software Foundation",
        "apache-2.0,mit": "SPDX-License-Identifier: MIT\nThe river was high.\nSPDX-License-Identifier: Apache-2.0",
        "": "The river was high.\nThe boats stayed away.",
    }
    docs = spark.createDataFrame(list(enumerate(texts.values())), "doc_id long, text string")
    got = [r["families"] for r in license.scan(docs).orderBy("doc_id").collect()]
    assert got == list(texts)
