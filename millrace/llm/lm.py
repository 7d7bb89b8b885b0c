"""Brown class-based bigram language model.

Training, over all training documents:
1. every distinct token is counted (a table as large as the vocabulary, which stays distributed);
2. the most frequent SYMBOLS words are symbols of their own and every other word is the symbol of its shape (length,
   kinds of its first and last byte), so the counts of symbol pairs are a table of bounded size. Exchange clustering
   moves symbols between CLASSES classes while that raises the likelihood of the pair counts;
3. the classes of the symbols are the seed of an exchange sweep over all other words: every one is counted with the
   classes of its left and right neighbours, in a table that grows with the vocabulary and stays distributed, and goes
   to the class that makes these counts likeliest. Only a word that training has not seen has the class of its shape;
4. P(w | previous) = P(class | previous class) * P(w | class), both smoothed by additive constants; each class keeps one
   unseen word's mass, so the model is a distribution over an open vocabulary. Transitions are counted anew with the
   classes of all words.

Words of a head of at most HEAD entries (a bounded broadcast) get their classes and counts where the text is read; those
of all other words come from the distributed table by a join. A text's classes are kept as a byte a token.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import words as W
from .arrow import slices
from .store import Scratch

SYMBOLS, SHAPES, CLASSES, HEAD = 896, 128, 64, 1 << 18
CONTEXT_SLICE = 1 << 20  # bytes of text at a time where contexts are counted
UNIGRAM, EMISSION, TRANSITION = 0.1, 0.1, 0.5
END = np.uint64(0x5EED0E4D0C0FFEE1)  # the fingerprint of the end token

_FIRST = np.full(256, 3, np.int64)  # kinds of bytes: letter, beyond ASCII, digit, other
_FIRST[65:91] = _FIRST[97:123] = 0
_FIRST[128:] = 1
_FIRST[48:58] = 2


def shapes(w: W.Words) -> np.ndarray:
    """The shape of each word, below SHAPES: length in steps of two bytes, kinds of its first and last byte."""
    if not len(w.starts):
        return np.zeros(0, np.int64)
    return (np.minimum(w.ends - w.starts - 1, 15) // 2) * 16 + _FIRST[w.data[w.starts]] * 4 + _FIRST[w.data[w.ends - 1]]


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints and shapes of the tokens of all texts, each text's end token included, and n + 1 offsets."""
    w = W.Words(column)
    where = w.first[1:]
    return np.insert(w.prints, where, END), np.insert(shapes(w), where, 0), w.first + np.arange(len(w.first))


def split(docs: DataFrame) -> DataFrame:
    """Adds held_out: crc32 of doc_id as text (null: empty) leaves remainder 0 by 10."""
    return docs.select("doc_id", "text", (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0).alias("held_out"))


def count_words(train: DataFrame) -> DataFrame:
    """(print, shape, n) of every distinct token of train(text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            p, s, n = (np.concatenate(x) for x in zip(*held, strict=True))
            u, first, inverse = np.unique(p, return_index=True, return_inverse=True)
            return u, s[first], np.bincount(inverse, n, len(u)).astype(np.int64)

        def out() -> pa.RecordBatch:
            p, s, n = held[0]
            return pa.record_batch([pa.array(p.view(np.int64)), pa.array(s.astype(np.int32)), pa.array(n)], ["print", "shape", "n"])

        for batch in slices(batches, "text"):
            p, s, _ = tokens(batch.column("text"))
            u, first, n = np.unique(p, return_index=True, return_counts=True)
            held.append((u, s[first], n))
            size += len(u)
            if size > 1_500_000:
                held[:] = [merged()]
                size = len(held[0][0])
                if size > 1_000_000:
                    yield out()
                    held.clear()
                    size = 0
        if held:
            held[:] = [merged()]
            yield out()

    partial = train.select("text").mapInArrow(run, "print long, shape int, n long")
    return partial.groupBy("print").agg(F.min("shape").alias("shape"), F.sum("n").alias("n"))


def exchange(pairs: np.ndarray, classes: int = CLASSES, sweeps: int = 12) -> np.ndarray:
    """The class of each symbol: exchange clustering of a square matrix of pair counts, most frequent symbols first."""
    size = len(pairs)
    both = pairs.sum(axis=0) + pairs.sum(axis=1)
    order = np.argsort(-both, kind="stable")
    k = min(classes, size)
    of = np.zeros(size, np.int64)
    of[order] = np.arange(size) % k
    member = np.zeros((size, k))
    member[np.arange(size), of] = 1
    table = member.T @ pairs @ member  # counts of class pairs
    after, before = pairs @ member, (member.T @ pairs).T  # of each symbol with following and preceding classes

    def f(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1e-300))

    for _ in range(sweeps):
        moved = 0
        for s in order:
            if not both[s]:
                continue
            old, own = of[s], pairs[s, s]
            r, q = after[s].copy(), before[s].copy()
            r[old] -= own
            q[old] -= own
            table[old] -= r
            table[:, old] -= q
            table[old, old] -= own
            here, left, right = f(table), table.sum(axis=1), table.sum(axis=0)
            rows, columns, diagonal = f(table + r) - here, f(table + q[:, None]) - here, np.diag(table)
            gain = rows.sum(axis=1) - np.diag(rows) + columns.sum(axis=0) - np.diag(columns) + f(diagonal + r + q + own) - np.diag(here)
            gain -= f(left + r.sum() + own) - f(left) + f(right + q.sum() + own) - f(right)
            new = int(np.argmax(gain)) if gain.max() > gain[old] + 1e-9 else int(old)
            table[new] += r
            table[:, new] += q
            table[new, new] += own
            if new != old:
                of[s] = new
                moved += 1
                after[:, old] -= pairs[:, s]
                after[:, new] += pairs[:, s]
                before[:, old] -= pairs[s]
                before[:, new] += pairs[s]
        if not moved:
            break
    return of


@dataclass
class Model:
    """What scoring needs besides the distributed counts; all of it is bounded."""

    total: int  # training tokens
    distinct: int
    head: np.ndarray  # sorted fingerprints
    head_n: np.ndarray
    head_class: np.ndarray
    shape_class: np.ndarray  # of unseen words
    mass: np.ndarray  # log10 of each class's emission denominator
    end_class: int

    def lookup(self, prints: np.ndarray, shape: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(class, count, in the head) of tokens; words outside the head have the class of their shape for now."""
        if not len(self.head):
            return self.shape_class[shape], np.zeros(len(prints), np.int64), np.zeros(len(prints), bool)
        at = np.minimum(np.searchsorted(self.head, prints), len(self.head) - 1)
        known = self.head[at] == prints
        return np.where(known, self.head_class[at], self.shape_class[shape]), np.where(known, self.head_n[at], 0), known


def count_pairs(train: DataFrame, named: np.ndarray, index: np.ndarray) -> np.ndarray:
    """The matrix of pair counts of symbols; named: sorted fingerprints of the frequent words, index: their symbols."""
    size = SYMBOLS + SHAPES
    shared = train.sparkSession.sparkContext.broadcast((named, index))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, symbol = shared.value
        total = np.zeros(size * size, np.int64)
        for batch in slices(batches, "text"):
            p, s, offsets = tokens(batch.column("text"))
            at = np.minimum(np.searchsorted(known, p), len(known) - 1)
            now = np.where(known[at] == p, symbol[at], SYMBOLS + s)
            before = np.empty_like(now)
            before[1:] = now[:-1]
            before[offsets[:-1]] = now[-1]  # a text begins after an end
            total += np.bincount(before * size + now, minlength=size * size)
        cells = np.flatnonzero(total)
        yield pa.record_batch([pa.array(cells.astype(np.int32)), pa.array(total[cells])], ["cell", "n"])

    cells = train.select("text").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    pairs = np.zeros(size * size)
    pairs[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    return pairs.reshape(size, size)


def count_contexts(train: DataFrame, named: np.ndarray, index: np.ndarray, of: np.ndarray) -> DataFrame:
    """(print, shape, cells, ns): for every word without a symbol of its own, partial counts of left (cell: the class) and right (CLASSES more) classes.

    A task holds words and cells in narrow types and reads small slices, as tasks share an executor's memory.
    """
    shared = train.sparkSession.sparkContext.broadcast((named, index, of))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, symbol, of = shared.value
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            p, s, cell, n = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((cell, p))
            p, cell = p[order], cell[order]
            first = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (cell[1:] != cell[:-1])])) if len(p) else np.zeros(0, np.int64)
            n = np.add.reduceat(n[order], first) if len(p) else n
            return p[first], s[order[first]], cell[first], n

        def out() -> Iterator[pa.RecordBatch]:
            p, s, cell, n = held[0]
            first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]])) if len(p) else np.zeros(0, np.int64)
            ends = np.append(first[1:], len(p))
            for i in range(0, len(first), 50_000):
                f, e = first[i : i + 50_000], ends[i : i + 50_000]
                offsets = pa.array(np.append(f, e[-1]) - f[0], pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x[f[0] : e[-1]], t)) for x, t in ((cell, pa.int16()), (n, pa.int64()))]
                yield pa.record_batch([pa.array(p[f].view(np.int64)), pa.array(s[f].astype(np.int32)), *lists], ["print", "shape", "cells", "ns"])

        for batch in slices(batches, "text", CONTEXT_SLICE):
            p, s, offsets = tokens(batch.column("text"))
            at = np.minimum(np.searchsorted(known, p), len(known) - 1)
            own = known[at] == p
            c = of[np.where(own, symbol[at], SYMBOLS + s)]
            before, after = np.empty_like(c), np.empty_like(c)
            before[1:], after[:-1] = c[:-1], c[1:]
            before[offsets[:-1]] = c[-1]  # a text begins after an end
            after[offsets[1:] - 1] = c[offsets[:-1]]  # an end stands before its own text
            rare = np.flatnonzero(~own)
            sides = np.concatenate([before[rare], CLASSES + after[rare]]).astype(np.uint8)
            held.append((np.tile(p[rare], 2), np.tile(s[rare].astype(np.uint8), 2), sides, np.ones(2 * len(rare), np.int64)))
            size += 2 * len(rare)
            if size > 1_500_000:
                held[:] = [merged()]
                size = len(held[0][0])
                if size > 1_000_000:
                    yield from out()
                    held.clear()
                    size = 0
        if held:
            held[:] = [merged()]
            yield from out()

    return train.select("text").mapInArrow(run, "print long, shape int, cells array<short>, ns array<long>")


def best_classes(contexts: np.ndarray, old: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The class of each word that makes its counts of left and right classes (one row of 2 * k) likeliest, in a table of class pairs that holds them under old."""
    k = len(table)
    left, right = contexts[:, :k], contexts[:, k:]
    into, out = table.sum(axis=0), table.sum(axis=1)
    to = np.log(table + TRANSITION)
    gain = left @ to + right @ to.T - left.sum(axis=1, keepdims=True) * np.log(into + TRANSITION * k) - right.sum(axis=1, keepdims=True) * np.log(out + TRANSITION * k)
    # its own counts don't speak for the class that a word is in
    n, m, rows = left.sum(axis=1), right.sum(axis=1), np.arange(len(old))
    own = (left * np.log(np.maximum(table.T[old] - left, 0) + TRANSITION)).sum(axis=1) + (right * np.log(np.maximum(table[old] - right, 0) + TRANSITION)).sum(axis=1)
    own -= n * np.log(np.maximum(into[old] - n, 0) + TRANSITION * k) + m * np.log(np.maximum(out[old] - m, 0) + TRANSITION * k)
    gain[rows, old] = own
    best = gain.argmax(axis=1)
    return np.where(gain[rows, best] > own + 1e-9, best, old)


def assign(contexts: DataFrame, table: np.ndarray, shape_class: np.ndarray) -> DataFrame:
    """(print, class, n) of every word of contexts: one exchange sweep over them all, a task for some of the words at a time."""
    k, sides = len(table), 2 * CLASSES
    columns = np.concatenate([np.arange(k), CLASSES + np.arange(k)])

    def made(p: np.ndarray, s: np.ndarray, cell: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
        ends = np.append(first[1:], len(p))
        for i in range(0, len(first), 4096):
            f, e = first[i : i + 4096], ends[i : i + 4096]
            word = np.repeat(np.arange(len(f)), e - f)
            dense = np.bincount(word * sides + cell[f[0] : e[-1]], n[f[0] : e[-1]], len(f) * sides).reshape(len(f), sides)[:, columns]
            c = best_classes(dense, shape_class[s[f]], table)
            yield pa.record_batch([pa.array(p[f]), pa.array(c.astype(np.int32)), pa.array(dense[:, :k].sum(axis=1).astype(np.int64))], ["print", "class", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, ...] | None = None  # the last word so far, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            lengths = batch.column("cells").value_lengths().to_numpy()
            new = [np.repeat(batch.column(x).to_numpy(), lengths) for x in ("print", "shape")] + [batch.column(x).flatten().to_numpy().astype(np.int64) for x in ("cells", "ns")]
            p, s, cell, n = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            last = int(np.searchsorted(p, p[-1]))
            if last:
                yield from made(p[:last], s[:last], cell[:last], n[:last])
            sums = np.bincount(cell[last:], n[last:], sides)
            cells = np.flatnonzero(sums)
            held = (np.full(len(cells), p[-1]), np.full(len(cells), s[last:].min()), cells, sums[cells].astype(np.int64))
        if held is not None:
            yield from made(*held)

    sorted_words = contexts.repartition("print").sortWithinPartitions("print")
    return sorted_words.mapInArrow(run, "print long, class int, n long")


def train_model(docs: DataFrame, scratch: Scratch) -> tuple[Model, DataFrame]:
    """The model of the rows of split() that aren't held out, and the table (print, shape, n) of all training tokens."""
    train = docs.where("not held_out")
    counts = scratch.save(count_words(train), "counts")
    levels = counts.groupBy("n").agg(F.count("*").alias("words")).toArrow().sort_by([("n", "descending")])  # as many rows as different counts
    n, words = (levels.column(c).to_numpy() for c in ("n", "words"))
    within = np.cumsum(words) <= HEAD
    least = int(n[within][-1]) if within.any() else int(n.max(initial=0)) + 1
    most = counts.orderBy(F.desc("n"), "print").limit(SYMBOLS).toArrow()
    prints, named_n = most.column("print").to_numpy().view(np.uint64), most.column("n").to_numpy()
    order = np.argsort(prints)
    named, symbol = prints[order], np.arange(len(prints))[order]
    size = SYMBOLS + SHAPES
    pairs = count_pairs(train, named, symbol) if len(named) else np.zeros((size, size))
    of = exchange(pairs)
    k = int(of.max(initial=0)) + 1
    member = np.zeros((size, k))
    member[np.arange(size), of] = 1
    shape_class = of[SYMBOLS:]
    lexicon = docs.sparkSession.createDataFrame([(int(p), int(c), int(x)) for p, c, x in zip(prints.view(np.int64), of[: len(prints)], named_n, strict=True)], "print long, class int, n long")
    if len(named):
        lexicon = lexicon.union(assign(count_contexts(train, named, symbol, of), member.T @ pairs @ member, shape_class))
    lexicon = scratch.save(lexicon, "lexicon")
    head = lexicon.where(F.col("n") >= least).toArrow()
    prints, head_n, head_class = head.column("print").to_numpy().view(np.uint64), head.column("n").to_numpy(), head.column("class").to_numpy()
    order = np.argsort(prints)
    prints, head_n, head_class = prints[order], head_n[order], head_class[order].astype(np.int64)
    held, kinds = np.zeros(k), np.zeros(k)  # tokens and distinct words of each class
    for r in lexicon.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect():
        held[r["class"]], kinds[r["class"]] = r["n"], r["words"]
    end = lexicon.where(F.col("print") == int(END.view(np.int64))).collect()
    model = Model(int((n * words).sum()), int(words.sum()), prints, head_n, head_class, shape_class, np.log10(held + EMISSION * (kinds + 1)), int(end[0]["class"]) if end else int(shape_class[0]))
    return model, lexicon.where(F.col("n") < least)


def transitions(coded: DataFrame, k: int, end: int) -> np.ndarray:
    """log10 P(class | previous class), from the classes of all training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k, np.int64)
        for batch in batches:
            for code in batch.column("codes").to_pylist():
                c = np.frombuffer(code, np.uint8).astype(np.int64)
                total += np.bincount(np.append(end, c[:-1]) * k + c, minlength=k * k)
        cells = np.flatnonzero(total)
        yield pa.record_batch([pa.array(cells.astype(np.int32)), pa.array(total[cells])], ["cell", "n"])

    cells = coded.where("not held_out").select("codes").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(k * k)
    table[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    table = table.reshape(k, k)
    return np.log10((table + TRANSITION) / (table.sum(axis=1, keepdims=True) + TRANSITION * k))


def score(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    score is the class model's log10 probability of the whole text with its end. A null text is empty: one token, the
    end. Rows are scored one by one, so repeated rows and ids give equal rows; a null id counts as the empty string and
    is held out; with no training rows every token is unknown; an empty table gives an empty result; further columns
    are ignored.
    """
    scratch = Scratch(docs.sparkSession, "lm")
    docs = split(docs)
    model, tail = train_model(docs, scratch)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    floor = float(np.log10(model.total + UNIGRAM * (model.distinct + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, row = shared.value, TaskContext.get().partitionId() << 32
        for batch in slices(batches, "text"):
            p, s, offsets = tokens(batch.column("text"))
            c, n, known = m.lookup(p, s)
            base, value = np.log10(n + UNIGRAM) - floor, np.log10(n + EMISSION)  # words outside the head count as unseen for now
            start = offsets[:-1]
            rare = np.flatnonzero(~known)
            held = np.searchsorted(rare, offsets).astype(np.int32)
            codes = c.astype(np.uint8)
            yield pa.record_batch(
                [
                    pa.array(np.arange(row, row + batch.num_rows)), batch.column("doc_id"), batch.column("held_out"), pa.array(np.diff(offsets)),
                    pa.array(np.add.reduceat(known, start, dtype=np.int64)), pa.array(np.add.reduceat(base, start)), pa.array(np.add.reduceat(value, start)),
                    pa.array([codes[i:j].tobytes() for i, j in zip(start.tolist(), offsets[1:].tolist(), strict=True)], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(held), pa.array(p[rare].view(np.int64))),
                    pa.ListArray.from_arrays(pa.array(held), pa.array((rare - np.repeat(start, np.diff(held))).astype(np.int32))),
                ],
                ["row", "doc_id", "held_out", "n_tokens", "known", "base", "value", "codes", "rare", "places"],
            )
            row += batch.num_rows

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column("codes").to_pylist()
            found = batch.column("found")
            lengths = found.value_lengths().fill_null(0).to_numpy()
            flat = found.flatten()
            at, c = (flat.field(i).to_numpy() for i in range(2))
            begins = np.cumsum(lengths) - lengths
            for i in np.flatnonzero(lengths).tolist():
                j = int(begins[i])
                x = np.frombuffer(codes[i], np.uint8).copy()
                x[at[j : j + lengths[i]]] = c[j : j + lengths[i]]
                codes[i] = x.tobytes()
            yield pa.record_batch([*(batch.column(x) for x in fixed), pa.array(codes, pa.binary())], [*fixed, "codes"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, moves = shared.value, steps.value
        for batch in batches:
            value = batch.column("value").to_numpy().copy()
            for i, code in enumerate(batch.column("codes").to_pylist()):
                c = np.frombuffer(code, np.uint8)
                value[i] += (moves[np.append(np.uint8(m.end_class), c[:-1]), c] - m.mass[c]).sum()
            yield pa.record_batch([*(batch.column(x) for x in fixed[:-1]), pa.array(value)], fixed)

    fixed = ["doc_id", "held_out", "n_tokens", "n_known", "base", "value"]
    columns = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, value double"
    rows = scratch.save(docs.mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, value double, codes binary, rare array<long>, places array<int>"), "rows")
    rare = rows.select("row", F.explode(F.arrays_zip("places", "rare")).alias("x")).select("row", F.col("x.places").alias("at"), F.col("x.rare").alias("print"))
    added = rare.hint("merge").join(tail, "print").groupBy("row").agg(
        F.count("*").alias("k"), F.sum(F.log10(F.col("n") + UNIGRAM) - math.log10(UNIGRAM)).alias("b"), F.sum(F.log10(F.col("n") + EMISSION) - math.log10(EMISSION)).alias("v"),
        F.collect_list(F.struct("at", F.col("class").alias("c"))).alias("found"),
    )
    zero = F.lit(0.0)
    joined = rows.drop("rare", "places").hint("merge").join(added, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("k", F.lit(0))).alias("n_known"), (F.col("base") + F.coalesce("b", zero)).alias("base"),
        (F.col("value") + F.coalesce("v", zero)).alias("value"), "codes", "found",
    )
    coded = scratch.save(joined.mapInArrow(place, f"{columns}, codes binary"), "coded")
    scratch.drop(rows)
    steps = docs.sparkSession.sparkContext.broadcast(transitions(coded, len(model.mass), model.end_class))
    out = coded.mapInArrow(walk, columns)
    return out.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"),
        F.col("value").alias("score"), F.pow(F.lit(10.0), -F.col("value") / F.col("n_tokens")).alias("perplexity"),
    )
