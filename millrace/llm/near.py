"""MinHash near-dedup with SetSketch registers.

A document's set holds the fingerprints of its distinct five-word shingles. Register i of a SetSketch is the minimum
over the set of exponentially distributed hash values, put on an exponential scale and truncated:
K = clip(floor(1 - log_b(min x)), 0, q + 1). Registers of a union are the maxima of the registers, so sketches merge.

1. one Arrow pass gives each document its set size, a 128-bit signature of its set and its band keys;
2. documents with one and the same set are one class, represented by the smallest id;
3. representatives that share a band key are candidates. A representative is linked to the smallest of its buckets'
   smallest members, and that one to the other smallest members: about one edge for each representative, with the same
   components as all pairs of all buckets. Two documents that share any bucket are within one candidate family;
4. a family is compared on full sets: the joint likelihood of two sketches and their set sizes gives an estimate, and
   pairs whose estimate is too far below the threshold are left; the others are confirmed on the full sets. Pairs that
   are known to be connected are not compared, and a task returns one row for each document, never pairs;
5. a family above the bound of a task is compared in two passes. First every representative is compared with those
   that have the same smallest bucket member, and with that member, in groups of bounded size. In a family of near
   copies this connects nearly all. Only the members of buckets that still hold several components go through the
   second pass, by pairs of blocks, so every candidate pair is either connected or compared;
6. the links of all tasks are joined by connected components.

bands(percent) gives so many bands that a pair at the threshold shares no bucket with probability below ESCAPE.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import words as W
from .arrow import slices
from .graph import components
from .store import Scratch

ESCAPE = 7e-7
BASE, RATE, LIMIT = 1.001, 20.0, (1 << 16) - 2
FAMILY, SHINGLES = 1000, 4_000_000  # documents and shingles of one task; a document above that has a task of its own
DEVIATIONS = 6.2  # an estimate so many standard deviations below the threshold ends a comparison: a chance below 1e-9


def bands(percent: int) -> tuple[int, int]:
    """(bands, registers of each): a pair at the threshold shares no band with probability below ESCAPE."""
    rows = 6 if percent >= 85 else 5
    return math.ceil(math.log(ESCAPE) / math.log1p(-((percent / 100) ** rows))), rows


REGISTERS = 180  # the two thresholds in use, 85 and 80, have 30 bands of 6 and 36 of 5
_MULTIPLY = W.constants(4096, 101)
_BAND = W.constants(6, 103)


def registers(shingles: np.ndarray, count: int = REGISTERS, block: int = 4096) -> np.ndarray:
    """SetSketch registers of one set of fingerprints (not empty), merged over blocks by the maximum."""
    low = np.full(count, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), block):
        np.minimum(low, (shingles[None, i : i + block] * _MULTIPLY[:count, None]).min(axis=1), out=low)
    x = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**64) / RATE  # the minimum of exponentials is that of the smallest hash
    return np.clip(np.floor(1 - np.log(x) / math.log(BASE)), 0, LIMIT + 1).astype(np.uint16)


def band_keys(regs: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band; the band's number is part of it."""
    r = regs.reshape(-1, rows).astype(np.uint64)
    return W.mix((W.mix(r + _BAND[:rows]) * _BAND[:rows]).sum(axis=1, dtype=np.uint64) + np.arange(1, len(r) + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def estimate(up: np.ndarray, down: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, m: int) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity from the counts of larger and smaller registers and the set sizes.

    With u and v the shares of the two sizes, a register is larger with probability u - v J, smaller with v - u J and
    equal with J (the limit of a base near 1). The derivative of the log-likelihood is a quadratic in J.
    """
    u = n_a / (n_a + n_b)
    v = 1 - u
    same = m - up - down
    half = same * (u * u + v * v) + up * v * v + down * u * u
    root = np.sqrt(np.maximum(half * half - 4 * (u * v) ** 2 * m * same, 0))
    return np.clip((half - root) / (2 * u * v * m), 0, np.minimum(u / v, v / u))


def deviation(t: float, n_a: np.ndarray, n_b: np.ndarray, m: int) -> np.ndarray:
    """The standard deviation of estimate() at the similarity t, from the Fisher information of m registers."""
    u = n_a / (n_a + n_b)
    v = 1 - u
    return 1 / np.sqrt(m * (v * v / np.maximum(u - v * t, 1e-3) + u * u / np.maximum(v - u * t, 1e-3) + 1 / t))


def sketch(docs: DataFrame, percent: int = 85, shingle: int = 5) -> DataFrame:
    """(doc_id, n_shingles, sig_a, sig_b, keys) of every document; keys is empty for an empty set."""
    count, rows = bands(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            w = W.Words(batch.column("text"))
            sizes, a, b, keys = [], [], [], []
            for i in range(len(w)):
                s = W.shingle_set(w.prints[w.first[i] : w.first[i + 1]], shingle)
                sizes.append(len(s))
                a.append(int(W.mix(s).sum(dtype=np.uint64).view(np.int64)))
                b.append(int((W.mix(s ^ np.uint64(0x5851F42D4C957F2D))).sum(dtype=np.uint64).view(np.int64)))
                keys.append(band_keys(registers(s, count * rows), rows).view(np.int64) if len(s) else np.zeros(0, np.int64))
            lengths = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            numbers = [pa.array(x, pa.int64()) for x in (sizes, a, b)]
            lists = pa.ListArray.from_arrays(pa.array(lengths), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
            yield pa.record_batch([batch.column("doc_id"), *numbers, lists], ["doc_id", "n_shingles", "sig_a", "sig_b", "keys"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, sig_a long, sig_b long, keys array<long>")


def link_family(sets: list[np.ndarray], percent: int, side: np.ndarray | None = None, known: np.ndarray | None = None) -> list[int]:
    """For each set the smallest index of its component, linking pairs with 100 * |a & b| >= percent * |a | b|.

    side: 0 or 1 for each set if only pairs of two blocks are to be compared (pairs within a block are another task's).
    known: labels of components found before; sets with one label aren't compared.
    """
    n, t = len(sets), percent / 100
    if n < 2:
        return list(range(n))
    regs = np.stack([registers(s) for s in sets])
    sizes, m = np.array([len(s) for s in sets]), regs.shape[1]
    order = np.argsort(sizes, kind="stable")
    sorted_sizes, sorted_regs = sizes[order], regs[order]
    labels = np.arange(n)  # the root of each set, for whole rows at once
    if known is not None:
        _, first, back = np.unique(known, return_index=True, return_inverse=True)
        labels = first[back]
    for k in range(n):
        i = order[k]
        j0 = int(np.searchsorted(sorted_sizes, sizes[i] * t - 1e-9))
        rest = np.arange(j0, k)
        rest = rest[labels[order[rest]] != labels[i]]
        if side is not None:
            rest = rest[side[order[rest]] != side[i]]
        if not len(rest):
            continue
        up = (sorted_regs[rest] < sorted_regs[k]).sum(axis=1)
        down = (sorted_regs[rest] > sorted_regs[k]).sum(axis=1)
        likely = estimate(up, down, sizes[i], sorted_sizes[rest], m)
        near = np.flatnonzero(likely >= t - DEVIATIONS * deviation(t, sizes[i], sorted_sizes[rest], m))
        for x in near[np.argsort(-likely[near], kind="stable")]:
            j = order[rest[x]]
            if labels[i] == labels[j]:
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                lo, hi = sorted((labels[i], labels[j]))
                labels[labels == hi] = lo
    return labels.tolist()


def stars(dealt: DataFrame) -> DataFrame:
    """Edges (a, b) with the components of all pairs that share a key, from dealt(rep, key), and hub: b's smallest bucket member.

    Each rep is joined to its hub, the smallest of its buckets' smallest members, and the hub to the other ones of
    these. In a large family of near copies there are few different ones, so edges are about as many as reps.
    """
    buckets = dealt.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high")
    lows = dealt.join(buckets, "key").groupBy("rep").agg(F.collect_set("low").alias("lows"))
    edges = lows.select(F.array_min("lows").alias("a"), F.explode(F.array_append("lows", F.col("rep"))).alias("b"), "rep")
    return edges.where("a <> b").groupBy("a", "b").agg(F.max(F.col("rep") == F.col("b")).alias("hub"))


def near_duplicates(docs: DataFrame, percent: int = 85, shingle: int = 5, family: int = FAMILY) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id, kept) for every row of docs(doc_id, text).

    class_id is the smallest id with the very same set, component_id the smallest id reachable by links, kept says
    that it is the row's own. Null or wordless texts have an empty set and are linked with nothing; a text of one to
    four words has one shingle, the whole sequence. Rows with one id are one node and share a component; rows without
    an id come back with a null component and are kept. An empty table gives an empty result; extra columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    made = scratch.save(sketch(docs, percent, shingle), "sketches")
    full = made.where("n_shingles > 0 and doc_id is not null")
    by = ["n_shingles", "sig_a", "sig_b"]
    classes = scratch.save(full.groupBy(*by).agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys")), "classes")
    weights = classes.groupBy("rep").agg(F.max("n_shingles").alias("weight"))
    texts = docs.select("doc_id", "text").where("doc_id is not null").hint("merge")

    def blocks(members: DataFrame, by: str) -> DataFrame:
        """members(doc_id, by, ..) with weights and the number of tasks' blocks that their group is dealt to."""
        weighed = members.join(weights.withColumnRenamed("rep", "doc_id"), "doc_id")
        sizes = weighed.groupBy(by).agg(F.count("*").alias("n"), F.sum("weight").alias("heavy"))
        return members.join(sizes.select(by, F.ceil(F.greatest(F.col("n") / family, F.col("heavy") / SHINGLES)).cast("int").alias("blocks")), by)

    def compared(members: DataFrame) -> DataFrame:
        """Links (a, b) of members(doc_id, root, i, j, block, label): one task for each (root, i, j)."""

        def link(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("doc_id", kind="stable").reset_index(drop=True)
            sets: list[np.ndarray] = []
            for at in range(0, len(pdf), 500):
                w = W.Words(pa.array(pdf["text"].iloc[at : at + 500], pa.large_string()))
                sets += [W.shingle_set(w.prints[w.first[k] : w.first[k + 1]], shingle) for k in range(len(w))]
            use = [k for k, s in enumerate(sets) if len(s)]
            two = pdf["i"].iloc[0] != pdf["j"].iloc[0]
            ids = pdf["doc_id"].to_numpy()[use]
            side = (pdf["block"] == pdf["i"]).to_numpy()[use] if two else None
            roots = link_family([sets[k] for k in use], percent, side, pdf["label"].to_numpy()[use])
            return pd.DataFrame({"a": ids[roots], "b": ids})

        # a merge join whatever the sizes: AQE can split its hot keys, and the plan is the same on any input
        return texts.join(members, "doc_id").groupBy("root", "i", "j").applyInPandas(link, "a long, b long").where("a <> b")

    dealt = classes.select("rep", F.explode("keys").alias("key"))
    edges = scratch.save(stars(dealt), "stars")
    families = scratch.save(blocks(components(edges, scratch).withColumnRenamed("node", "doc_id"), "root"), "families")
    one = [F.lit(0).alias(c) for c in ("i", "j", "block")]
    small = families.where("blocks = 1").select("doc_id", "root", *one, F.col("doc_id").alias("label"))
    # large families, first pass: each document with the others of its hub; every group holds the hub itself
    large = families.where("blocks > 1").select("doc_id")
    hubs = blocks(edges.where("hub").select(F.col("b").alias("doc_id"), F.col("a").alias("root")).join(large, "doc_id"), "root")
    hubs = hubs.select("doc_id", "root", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int").alias("i"))
    hubs = hubs.union(hubs.select(F.col("root").alias("doc_id"), "root", "i").distinct())
    hubs = hubs.select("doc_id", F.concat_ws(".", F.lit("h"), "root").alias("root"), "i", F.col("i").alias("j"), F.col("i").alias("block"), F.col("doc_id").alias("label"))
    small = small.withColumn("root", F.col("root").cast("string"))
    first = scratch.save(compared(small.union(hubs)), "links")
    if large.limit(1).count():
        # second pass: what shares a bucket and isn't connected yet
        label = components(first, scratch).select(F.col("node").alias("rep"), F.col("root").alias("label"))
        labels = large.withColumnRenamed("doc_id", "rep").join(label, "rep", "left").select("rep", F.coalesce("label", "rep").alias("label"))
        labels = scratch.save(labels, "labels")
        mixed = dealt.join(labels, "rep")
        mixed = mixed.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
        left = components(scratch.save(stars(dealt.join(large.withColumnRenamed("doc_id", "rep"), "rep").join(mixed, "key", "left_semi")), "left"), scratch)
        rest = blocks(left.withColumnRenamed("node", "doc_id"), "root").withColumn("block", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int"))
        rest = rest.join(labels.withColumnRenamed("rep", "doc_id"), "doc_id").select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        rest = rest.select("doc_id", F.col("root").cast("string").alias("root"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "label")
        first = first.union(scratch.save(compared(rest), "links"))
    ids = full.groupBy("doc_id").agg(F.min(F.struct(*by)).alias("one"), F.count_distinct(*by).alias("sets"))  # ids with two texts
    twice = ids.where("sets > 1").select("doc_id").join(full, "doc_id").join(classes.select(*by, "rep"), by).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    roots = components(first.union(twice), scratch)
    reps = classes.select(*by, "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(*by, "rep", F.coalesce("root", "rep").alias("root"))
    out = made.select("doc_id", *by).join(reps, by, "left")
    whole = F.when(F.col("doc_id").isNull() | (F.col("n_shingles") == 0), F.col("doc_id")).otherwise(F.coalesce("root", "doc_id"))
    return out.select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("class_id"), whole.alias("component_id"), F.coalesce(whole == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs without the rows whose component has a smaller id; the default threshold is a similarity of 0.8.

    Rows without an id stay, and so do those with a null or wordless text. Rows with one id are one node, of which one
    row stays, that with the longest text.
    """
    gone = near_duplicates(docs, percent).where("not kept").select("doc_id").distinct()
    left = docs.hint("merge").join(gone, "doc_id", "left_anti").select(*docs.columns)
    ids = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    if not ids.limit(1).count():
        return left
    first = Window.partitionBy("doc_id").orderBy(F.coalesce(F.length("text"), F.lit(-1)).desc(), F.xxhash64(*docs.columns))
    one = left.where("doc_id is not null").select(F.struct(*docs.columns).alias("_row"), F.row_number().over(first).alias("_n")).where("_n = 1")
    return one.select("_row.*").union(left.where("doc_id is null"))
