"""What Python workers are sent is bounded, and what they need not see stays in the JVM."""

import time
import unicodedata

import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

from millrace import session
from millrace.functions import arrow as A
from millrace.operators import sft, tokenize, toxicity


def test_arrow_batches_are_bounded_by_bytes(spark):
    session.ship(spark)
    df = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("x"), 10_000).alias("t"))
    sizes = df.mapInArrow(lambda it: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in it), "n long").collect()
    assert len(sizes) > 1 and max(r.n for r in sizes) < 1.2 * session.BATCH


def test_plain_letters_stay_in_the_jvm(spark):
    letters = [chr(i) for low, high in A.BLOCKS for i in range(low, high + 1)]
    seen = spark.createDataFrame(list(enumerate(letters)), "i int, t string").select(
        "i", "t", A._changed_by("NFKC")(F.col("t")).alias("c"), A._folded_apart()(F.col("t")).alias("f"), A.casefold(F.col("t")).alias("folded")
    ).collect()
    assert all(r.c or unicodedata.normalize("NFKC", r.t) == r.t for r in seen) and all(r.folded == r.t.casefold() for r in seen)
    assert not any(r.c or r.f for r in seen if r.t in "äöüßéèêçñÄÖÜÉжя漢か한")
    marks = spark.createDataFrame([("é",), ("ΑΣ",), ("하",), ("が",)], "t string")
    assert all(r.c for r in marks.where("t <> 'ΑΣ'").select(A._changed_by("NFC")(F.col("t")).alias("c")).collect())
    assert {r.x for r in marks.select(A.casefold(A.normalize(F.col("t"), "NFC")).alias("x")).collect()} == {"\xe9", "ασ", "하", "が"}


def test_texts_are_encoded_by_pieces(spark):
    texts = ["a b" * 1000, "", "ä" * 5000, "x", "yy"] * 3
    made = list(tokenize.pieces(texts, 4000))
    assert [t for p in made for t in p] == texts and len(made) == 4 and list(tokenize.pieces([])) == []
    df = spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "doc_id int, source string, text string")
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = tokenize.load(path)
    (row,) = tokenize.metrics(df, path, "source").where("source = 's'").collect()
    assert row.tokens == sum(len(t.encode(x, add_special_tokens=False).ids) for x in texts) and row.round_trip_rate == 1.0
    assert [len(r.i) for r in df.select("doc_id", tokenize.encode(F.col("text"), path).alias("i")).orderBy("doc_id").collect()] == [len(t.encode(x, add_special_tokens=False).ids) for x in texts]


def test_padding_is_made_last(spark):
    rows = [(i, "ask " * n, "", "none", "say " * n) for i, n in enumerate((1, 5, 400))] + [(3, "ask", "", "none", "")]
    df = spark.createDataFrame(rows, "i int, instruction string, context string, context_type string, response string")
    path = public_tokenizers.path("byte_bpe_50k.json")
    short = {r.i: r.unpadded for r in sft.encode_unpadded(df, path, 100_000, 7, 8).collect()}
    assert all(len(r.ids) == r.prompt_tokens + r.response_tokens + 1 < 2000 for k, r in short.items() if k < 3)
    for r in sft.encode_structured(df, path, 3000, 7, 8, 9).collect():
        e, n, p = r.encoded, len(short[r.i].ids), short[r.i].prompt_tokens
        if r.i == 3:
            assert (e.input_ids, e.attention_mask, e.labels, e.error) == ([], [], [], "empty_response")
            continue
        assert e.input_ids == short[r.i].ids + [9] * (3000 - n) and e.attention_mask == [1] * n + [0] * (3000 - n)
        assert e.labels == [-100] * (p + 1) + short[r.i].ids[p + 1 :] + [-100] * (3000 - n)


class Shares:
    def score(self, texts):
        return [{"n": float(len(t.split(" "))), "first": float(t.split(" ")[0])} for t in texts]


def test_a_long_text_is_cut_into_words_once(spark):
    df = spark.createDataFrame([(0, " ".join(map(str, range(30_000)))), (1, "5 6"), (2, " "), (3, None), (4, " ".join(map(str, range(51))))], "i int, text string")
    began = time.time()
    got = {r.i: (r.chunks_processed, dict(r.scores)) for r in toxicity.predict(df, Shares, 50, 30, 4).collect()}
    assert time.time() - began < 20  # each of 1,000 windows split the whole text
    assert got[0] == (4, {"n": 50.0, "first": 29970.0})  # windows begin at 0, 9990, 19980 and 29970, the last with 30 words
    assert got[1] == (1, {"n": 2.0, "first": 5.0}) and got[2][0] == got[3][0] == 0 and got[4] == (2, {"n": 50.0, "first": 30.0})
