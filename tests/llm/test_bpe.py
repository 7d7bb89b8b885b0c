"""The rank queue against the tiktoken library."""

import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from millrace.llm import bpe

FILE = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(FILE, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(coder, texts):
    return [memoryview(x).cast("I").tolist() for x in coder.encode(texts)]


ODD = ["", " ", "  a", "a  b", "a \n b\n", "\n", "x\r\n\ty ", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "don't we'll", "ß é 漢字 🎉🎉", "a\x1cb \x1c c", "1 22 333 ,,, <|endoftext|>", "a b  c", " x y"]


def test_odd_texts(library):
    c = bpe.Coder(FILE, P.PATTERN)
    assert ids(c, ODD) == [library.encode_ordinary(t) for t in ODD]
    assert ids(c, ODD[::-1]) == [library.encode_ordinary(t) for t in ODD[::-1]]


def test_random_texts_and_long_pre_tokens(library):
    rng, c = random.Random(3), bpe.Coder(FILE, P.PATTERN)
    texts = ["".join(rng.choice("abcdeth  \n.,é1") for _ in range(rng.randrange(200))) for _ in range(300)]
    texts += ["".join(rng.choice("abnt") for _ in range(20000)), "ab" * 20000, "=" * 5000]
    got = ids(c, texts)
    assert got == [library.encode_ordinary(t) for t in texts]
    assert [c.decode(x).decode() for x in got] == texts


def test_cache_limit_changes_nothing(library):
    c = bpe.Coder(FILE, P.PATTERN)
    c.chunks = bpe.ChunkCache(c.chunks.encode_many, 16)
    texts = ["one two three four five six", "six five four", "one  two"] * 3
    assert ids(c, texts) == [library.encode_ordinary(t) for t in texts]


def test_whole_documents_table(spark, sf, library):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in bpe.round_trip(df, FILE, P.PATTERN).collect()}
    assert len(rows) == df.count()
    for d in df.collect():
        want = library.encode_ordinary(d.text)
        r = rows[d.doc_id]
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(d.text.encode()).hexdigest()


def test_edges(spark):
    nothing = hashlib.sha256(b"").hexdigest()
    df = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "a b", 3), (1, "a b", 4)], "doc_id long, text string, ids int")
    rows = bpe.round_trip(df, FILE, P.PATTERN).collect()
    assert [(r.doc_id, r.n_tokens, r.ids_sha256 == nothing) for r in rows if not r.n_tokens] == [(None, 0, True), (1, 0, True)]
    assert len(rows) == 4
    back = bpe.decode(bpe.encode(df, FILE, P.PATTERN), FILE, P.PATTERN).collect()
    assert [r.text for r in back] == ["", "", "a b", "a b"]
    assert bpe.round_trip(df.where("false"), FILE, P.PATTERN).collect() == []
