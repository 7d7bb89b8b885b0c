"""Repeated passages by a sparse suffix array.

Of a document's suffixes only those at minimiser positions are kept: of the GRAM-word windows inside each run of
`least` words, the leftmost one with the smallest fingerprint. Two equal runs choose the same place, so every
repeated run is seen at a kept suffix, and about one suffix in twenty is kept. The runs that chose a suffix reach from
its `low` word, at most `least` - GRAM words to the left, to at most `least` words to the right: its surroundings.

1. one Arrow pass lists the kept suffixes: fingerprints of the first GRAM words and of the surroundings, id, place;
2. they are range-partitioned and sorted by their beginnings (ids and places break ties, so a frequent passage is spread
   over tasks) and neighbours are compared; the ends of partitions are compared with each other as well. A suffix that
   begins like no other is gone;
3. suffixes whose whole surroundings agree are one class, so copies are not multiplied: all but the first are copies
   of it. Where several classes begin alike, the first of each is compared word by word: suffixes are sorted by the
   words to their right, and again by those to their left, and the common prefixes of neighbours in both orders give
   the intervals of suffixes that agree in r words to the right and in l to the left. A run of r + l = `least` words
   around the place is a copy if another one of both its intervals is earlier; neighbouring runs extend it to the left
   and the right. Such suffixes are dealt by their beginnings to tasks of about GROUP;
4. where more than GROUP classes begin alike, so that one task must not hold them, runs are grouped by fingerprints;
5. copies are merged to maximal spans.

The result is exact up to collisions of 64-bit fingerprints: a word lies in a span if and only if it lies in a run of
`least` words that occurs at an earlier (doc_id, place).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import words as W
from .arrow import slices
from .store import Scratch

LEAST, GRAM, GROUP = 50, 8, 4_000


class Rolling:
    """Fingerprints of any runs of a text's words."""

    def __init__(self, prints: np.ndarray):
        power, self.inverse = W._tables(len(prints))
        self.sums = np.zeros(len(prints) + 1, np.uint64)
        np.cumsum(W.mix(prints) * power[: len(prints)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return W.mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def minimisers(prints: np.ndarray, least: int = LEAST, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, fingerprint of its gram, first and last run that chose it) of a text; a run is named by its first word."""
    if len(prints) < least:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none, none
    g = W.grams(prints, gram)
    width = least - gram + 1
    chosen = np.lib.stride_tricks.sliding_window_view(g, width).argmin(axis=1) + np.arange(len(g) - width + 1)
    place, first = np.unique(chosen, return_index=True)
    return place, g[place], first, np.append(first[1:], len(chosen)) - 1


def _suffixes(docs: DataFrame, least: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            w = W.Words(batch.column("text"), lower=False)
            ids = batch.column("doc_id").to_numpy()
            parts: list[list[np.ndarray]] = [[], [], [], []]
            for i in range(len(w)):
                prints = w.prints[w.first[i] : w.first[i + 1]]
                place, g, low, _ = minimisers(prints, least)
                if len(place):
                    starts = np.arange(len(prints) - least + 1)
                    runs = W.mix(Rolling(prints).of(starts, starts + least) + (starts - np.repeat(place, np.diff(np.append(low, len(starts))))).astype(np.uint64))
                    whole = W.mix(np.add.reduceat(runs, low))  # of all runs and where they lie about the place
                    for part, x in zip(parts, (g.view(np.int64), whole.view(np.int64), np.full(len(place), ids[i]), place.astype(np.int32)), strict=True):
                        part.append(x)
            if parts[0]:
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in parts], ["g", "whole", "doc_id", "place"])

    return docs.mapInArrow(run, "g long, whole long, doc_id long, place int")


def _neighbours(suffixes: DataFrame, scratch: Scratch) -> DataFrame:
    """Those of (g, whole, doc_id, place) that share g with another one, by sorting and comparing neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = None, True  # the last row so far, not yet judged

        def out(columns: list[np.ndarray], kind: np.ndarray) -> pa.RecordBatch:
            use = kind > 0
            return pa.record_batch([*(pa.array(c[use]) for c in columns), pa.array(kind[use])], ["g", "whole", "doc_id", "place", "kind"])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_numpy() for c in ("g", "whole", "doc_id", "place")]
            if held is not None:
                columns = [np.append(a, b) for a, b in zip(held[0], columns, strict=True)]
            g = columns[0]
            like = g[1:] == g[:-1]
            kind = np.zeros(len(g), np.int8)
            kind[1:] |= like
            kind[:-1] |= like
            if held is not None and held[1]:
                kind[0] = 1
            if first:  # 2: a row at an end of the partition, alone so far; 3: one that has a neighbour
                kind[0] = 2 + kind[0] if len(g) > 1 else 0
            n = len(g) - 1
            if n:
                yield out([c[:n] for c in columns], kind[:n])
                first = False
            held = ([c[n:] for c in columns], bool(n and like[-1]) or bool(held is not None and not n and held[1]))
        if held is not None:
            yield out(held[0], np.array([3 if held[1] else 2], np.int8))

    names = ["g", "whole", "doc_id", "place"]
    spread = suffixes.repartitionByRange(*map(F.col, names)).sortWithinPartitions(*names)
    judged = scratch.save(spread.mapInArrow(run, "g long, whole long, doc_id long, place int, kind byte"), "judged")
    scratch.drop(suffixes)
    ends = judged.where("kind >= 2")  # at most two of each partition
    across = ends.groupBy("g").count().where("count > 1").select("g")
    return judged.where("kind in (1, 3)").select(names).union(ends.where("kind = 2").join(across, "g", "left_semi").select(names))


def _read(docs: DataFrame, marked: DataFrame, least: int) -> DataFrame:
    """(doc_id, start_word, end_word, start_byte, end_byte, copy_of, print, bucket, place, words, bytes) of marked(doc_id, place, copy_of, bucket, hot).

    A suffix with a copy_of gives the span of all its runs, a hot one each of its runs with its fingerprint, any other
    one its surroundings: fingerprints of the words, and where they begin and end.
    """
    by_doc = marked.groupBy("doc_id").agg(F.collect_list(F.struct("place", "copy_of", "bucket", "hot")).alias("places"))
    texts = docs.hint("merge").join(by_doc, "doc_id").select("doc_id", "text", "places")
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int32()) for c in ("start_word", "end_word", "start_byte", "end_byte")), ("copy_of", pa.int64()), ("print", pa.int64()), ("bucket", pa.int64()), ("place", pa.int32()), ("words", pa.binary()), ("bytes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            w = W.Words(batch.column("text"), lower=False)
            ids, lists = batch.column("doc_id").to_pylist(), batch.column("places")
            wanted, ends_at = lists.flatten(), np.cumsum(lists.value_lengths().to_numpy())
            places, copies, hot = wanted.field("place").to_numpy(), wanted.field("copy_of"), wanted.field("hot").to_numpy(zero_copy_only=False)
            own, copy_of, buckets = copies.is_null().to_numpy(zero_copy_only=False), copies.fill_null(0).to_numpy(), wanted.field("bucket").to_numpy()
            rows: list[tuple] = []
            for i in range(len(w)):
                words = slice(w.first[i], w.first[i + 1])
                prints, begins, finishes = w.prints[words], (w.starts[words] - w.offsets[i]).astype(np.int32), (w.ends[words] - w.offsets[i]).astype(np.int32)
                place, _, low, high = minimisers(prints, least)
                at = slice(ends_at[i - 1] if i else 0, ends_at[i])
                where = np.searchsorted(place, places[at])
                there = where < len(place)
                there[there] = place[where[there]] == places[at][there]  # all, unless ids are repeated
                rolling = Rolling(prints) if hot[at].any() else None
                for k, j in zip(where[there].tolist(), (np.flatnonzero(there) + at.start).tolist(), strict=True):
                    a, e = int(low[k]), int(high[k]) + least
                    if own[j] and hot[j]:
                        start = np.arange(a, e - least + 1)
                        keys = rolling.of(start, start + least).view(np.int64)
                        rows += [(ids[i], x, x + least, int(begins[x]), int(finishes[x + least - 1]), None, key, None, None, None, None) for x, key in zip(start.tolist(), keys.tolist(), strict=True)]
                        continue
                    span = ids[i], a, e, int(begins[a]), int(finishes[e - 1])
                    if own[j]:
                        rows.append((*span, None, None, int(buckets[j]), int(place[k]), prints[a:e].tobytes(), np.stack([begins[a:e], finishes[a:e]]).tobytes()))
                    else:
                        rows.append((*span, int(copy_of[j]), None, None, None, None, None))
            for k in range(0, len(rows), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 20_000], strict=True), schema.types, strict=True)], schema=schema)

    return texts.mapInArrow(run, "doc_id long, start_word int, end_word int, start_byte int, end_byte int, copy_of long, print long, bucket long, place int, words binary, bytes binary")


def _ordered(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted order of rows of words, and how many words each has in common with the one before it (the first: -1)."""
    order = np.lexsort(words.T[::-1])
    sorted_words = words[order]
    differ = sorted_words[1:] != sorted_words[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), words.shape[1])
    return order, np.concatenate([[-1], common])


def compare(segments: list[np.ndarray], offsets: np.ndarray, keys: np.ndarray, least: int = LEAST, gram: int = GRAM) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(segment, first word of the run in it, first segment with the run) of each run with an earlier equal one.

    segments: surroundings of suffixes as words; offsets: where the suffix begins in each; keys: two columns, the
    document and the word that the segment begins with, by which equal runs are ordered.
    """
    n, most = len(segments), least - gram
    right, left = np.zeros((n, least), np.uint64), np.zeros((n, most), np.uint64)
    for i, (s, o) in enumerate(zip(segments, offsets.tolist(), strict=True)):
        right[i, : len(s) - o] = s[o:]
        left[i, :o] = s[:o][::-1]
    to_right = np.array([len(s) for s in segments]) - offsets
    (by_right, prefix), (by_left, suffix) = _ordered(right), _ordered(left)
    r_class, l_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for l in range(most + 1):
        r = least - l
        use = np.flatnonzero((to_right >= r) & (offsets >= l))
        if len(use) < 2:
            continue
        r_class[by_right], l_class[by_left] = np.cumsum(prefix < r), np.cumsum(suffix < l)
        pair = r_class[use] * (n + 1) + l_class[use]
        start = offsets[use] - l
        order = np.lexsort((keys[use, 1] + start, keys[use, 0], pair))
        new = np.concatenate([[True], pair[order][1:] != pair[order][:-1]])
        first = order[np.flatnonzero(new)][np.cumsum(new) - 1]
        doc, word = keys[use, 0], keys[use, 1] + start
        later = (doc[order] != doc[first]) | (word[order] != word[first])
        yield use[order[later]], start[order[later]], use[first[later]]


def _compared(pdf: pd.DataFrame, least: int) -> pd.DataFrame:
    """Runs of one bucket's suffixes that are copies: doc_id, start_word, end_word, start_byte, end_byte, copy_of."""
    segments = [np.frombuffer(b, np.uint64) for b in pdf["words"]]
    places = [np.frombuffer(b, np.int32).reshape(2, -1) for b in pdf["bytes"]]
    doc, low = pdf["doc_id"].to_numpy(), pdf["start_word"].to_numpy().astype(np.int64)
    found = list(compare(segments, pdf["place"].to_numpy().astype(np.int64) - low, np.stack([doc, low], axis=1), least))
    k, start, first = (np.concatenate([x[i] for x in found]) if found else np.zeros(0, np.int64) for i in range(3))
    begins = [int(places[i][0, s]) for i, s in zip(k.tolist(), start.tolist(), strict=True)]
    finishes = [int(places[i][1, s + least - 1]) for i, s in zip(k.tolist(), start.tolist(), strict=True)]
    return pd.DataFrame({"doc_id": doc[k], "start_word": (low[k] + start).astype(np.int32), "end_word": (low[k] + start + least).astype(np.int32), "start_byte": np.array(begins, np.int32), "end_byte": np.array(finishes, np.int32), "copy_of": doc[first]})


def repeated_spans(docs: DataFrame, least: int = LEAST, group: int = GROUP) -> DataFrame:
    """One row per maximal span with earlier copies: doc_id, start_word, end_word, start_byte, end_byte, copy_of.

    Ends are exclusive; bytes are those of the UTF-8 text; copy_of lists documents with an earlier copy of a part of
    the span. Words are runs of non-space bytes, case counts. A null text and a text below `least` words have none.
    Rows without an id are left out. Rows with one id are taken as one document: a place of it counts once. An empty
    table gives an empty result; further columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "suffix")
    docs = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    found = _neighbours(scratch.save(_suffixes(docs, least), "suffixes"), scratch)
    classes = found.groupBy("g", "whole").agg(F.min(F.struct("doc_id", "place")).alias("rep"), F.count("*").alias("n"))
    classes = scratch.save(classes, "classes")
    alike = scratch.save(classes.groupBy("g").count().where("count > 1"), "alike")
    total = alike.where(F.col("count") <= group).agg(F.sum("count")).first()[0] or 0
    bucket = F.pmod(F.xxhash64("g"), F.lit(max(1, -(-total // group))))
    alike = alike.select("g", F.lit(True).alias("several"), bucket.alias("bucket"), (F.col("count") > group).alias("hot"))
    classes = classes.hint("merge").join(alike, "g", "left").where("n > 1 or several")
    known = found.hint("merge").join(classes, ["g", "whole"]).withColumn("own", F.struct("doc_id", "place") == F.col("rep"))
    copies = F.when(~F.col("own"), F.col("rep.doc_id")).alias("copy_of")
    marked = known.where("not own or several").select("doc_id", "place", copies, F.coalesce("bucket", F.lit(0)).alias("bucket"), F.coalesce("hot", F.lit(False)).alias("hot")).distinct()
    parts = scratch.save(_read(docs, marked, least), "parts")
    names = ["doc_id", "start_word", "end_word", "start_byte", "end_byte"]
    near = parts.where("words is not null").select(*names, "place", "words", "bytes", "bucket")
    schema = "doc_id long, start_word int, end_word int, start_byte int, end_byte int, copy_of long"
    compared = near.groupBy("bucket").applyInPandas(lambda pdf: _compared(pdf, least), schema)
    each = parts.where("print is not null").select(*names, "print")
    first = each.groupBy("print").agg(F.min(F.struct("doc_id", "start_word")).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = each.hint("merge").join(first, "print").where(F.struct("doc_id", "start_word") != F.col("first"))
    spans = parts.where("copy_of is not null").select(*names, "copy_of").union(compared).union(later.select(*names, F.col("first.doc_id").alias("copy_of")))
    order = Window.partitionBy("doc_id").orderBy("start_word", "end_word")
    before = F.max("end_word").over(order.rowsBetween(Window.unboundedPreceding, -1))
    parts = spans.withColumn("new", F.coalesce(F.col("start_word") > before, F.lit(True)).cast("int"))
    parts = parts.withColumn("span", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return parts.groupBy("doc_id", "span").agg(
        F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"), F.min("start_byte").alias("start_byte"),
        F.max("end_byte").alias("end_byte"), F.sort_array(F.collect_set("copy_of")).alias("copy_of"),
    ).drop("span")


def remove_repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs with every later copy of a passage cut out of its text (the first copy stays); n_chars follows if it is there.

    Texts without a span come back unchanged, and so do rows without an id or text. Rows with one id are taken as one
    document. Further columns are carried along, whatever their names; an empty table gives an empty result.
    """
    spans = repeated_spans(docs, least).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start_byte", "end_byte"))).alias("spans"))
    whole = docs.select("doc_id", F.struct(*docs.columns).alias("row"))
    joined = whole.hint("merge").join(spans, "doc_id", "left").withColumn("raw", F.encode("row.text", "UTF-8"))
    # the pieces between the spans, in order; spans never cut a character, as they begin and end with words
    before, after = "if(i = 0, 0, get(spans, i - 1).end_byte)", "if(i = size(spans), octet_length(raw), get(spans, i).start_byte)"
    kept = F.expr(f"transform(sequence(0, size(spans)), i -> decode(substring(raw, {before} + 1, {after} - {before}), 'UTF-8'))")
    out = joined.withColumn("cut", F.when(F.col("spans").isNotNull(), F.array_join(kept, "")))
    new = {"text": F.coalesce("cut", "row.text")}
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        new["n_chars"] = F.when(F.col("cut").isNull(), F.col("row.n_chars")).otherwise(F.length("cut").cast(kind))
    return out.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))
