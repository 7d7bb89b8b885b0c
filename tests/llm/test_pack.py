"""Packing: every id in one piece, no padding, and the tokenizer library's own ids."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from millrace.llm import pack

FILE = P.path("byte_bpe_50k.json")


def holds(rows, texts):
    """Check the rows against the ids of texts (one per doc_id)."""
    t = Tokenizer.from_file(FILE)
    want = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4") for i, x in texts.items()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(want)
    for i, ids in want.items():
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    steps = defaultdict(int)
    for held in sequences.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == held[0].tier <= 2048 and at & (at - 1) == 0
        steps[held[0].step_id] += at
    assert max(steps.values(), default=0) <= pack.STEP_TOKENS
    return sequences


def test_whole_documents_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    rows = pack.pack(df, FILE).collect()
    sequences = holds(rows, {r.doc_id: r.text for r in df.collect()})
    long = sum(1 for v in sequences.values() if v[0].tier >= 256)
    assert long > 0.8 * len(sequences)


def test_edges(spark):
    texts = {1: None, 2: "", 3: "a", 4: "word " * 5000, 5: "<|endoftext|> x  y\n", 6: "a <|endoftext|> b"}
    df = spark.createDataFrame([(i, t, 9) for i, t in texts.items()], "doc_id long, text string, start int")
    holds(pack.pack(df, FILE).collect(), texts)
    assert pack.pack(df.where("false"), FILE).collect() == []
    twice = spark.createDataFrame([(None, "a b"), (7, "c"), (7, "c")], "doc_id long, text string").coalesce(1)
    assert sorted(str(r.doc_id) for r in pack.pack(twice, FILE).collect() if r.start == 0) == ["7", "7", "None"]


def test_same_ids_as_the_tokenizers_library():
    own, t, rng = pack.encoding(FILE), Tokenizer.from_file(FILE), random.Random(5)
    texts = [own.decode([i]) for i in range(own.n_vocab)]
    texts += ["".join(rng.choice(["a", "the", " ", "  ", "\n", "\t", "'s", "é", "漢", "🎉", "1", "!!", "<|endoftext|>", "\x85", "\x1c", "x" * 150, "\n" * 1500, " " * 1001, "\u2003" * 1200]) for _ in range(rng.randrange(40))) for _ in range(3000)]
    want = t.encode_batch_fast(texts, add_special_tokens=False)
    assert all(pack.encode(own, x).tolist() == w.ids for x, w in zip(texts, want, strict=True))


def test_very_long_white_space(spark):
    own, t = pack.encoding(FILE), Tokenizer.from_file(FILE)
    million = 1_000_000
    texts = ["\n" * 2 * million, " " * 2 * million, "a" + " \n\t" * 700_000 + "b", " " * million + "b" + "\n" * million + " c", "x \x1c" + "\u3000" * million, "a" * million + "1" * million + "#" * million]
    for x in texts:
        assert pack.encode(own, x).tolist() == t.encode(x, add_special_tokens=False).ids
    held = {i: x for i, x in enumerate(texts[2:5])}
    holds(pack.pack(spark.createDataFrame(list(held.items()), "doc_id long, text string"), FILE).collect(), held)


def test_other_tokenizer_files_are_refused():
    with pytest.raises(ValueError):
        pack.encoding(P.path("word_bpe_49k.json"))


def test_packer_fills_every_window():
    rng = random.Random(4)
    for _ in range(30):
        made, total = [], 0
        p = pack.Packer(lambda size, held: made.append((size, sum(len(x.ids) for x in held))))
        for i in range(rng.randrange(60)):
            n = rng.choice([1, 5, 200, 256, 700, 1024, 2047, 2048, 9000])
            total += n
            p.add(i, np.zeros(n, "<u4"))
            if rng.random() < 0.2:
                p.fill()
        p.finish()
        assert all(a == b for a, b in made) and sum(b for _, b in made) == total
