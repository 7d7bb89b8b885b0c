"""MinHash signatures and banded candidates of shingle sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types

from ..scratch import Scratch
from ..session import ship

RUN = 1 << 16  # hashes that are permuted at a time



def signature(shingles: Column, permutations: int = 128, seed: int = 1) -> Column:
    """The smallest hash of a set under each of so many seeded hash functions; null for an empty set.

    A column expression: every shingle is hashed as often as there are functions. signatures() takes a table.
    """
    seeds = F.sequence(F.lit(seed), F.lit(seed + permutations - 1))
    made = F.transform(seeds, lambda i: F.array_min(F.transform(shingles, lambda s: F.xxhash64(i, s))))
    return F.when(F.size(shingles) > 0, made)


def _constants(permutations: int, seed: int) -> list[tuple[int, int]]:
    """A mask and an odd factor for each permutation, by splitmix64."""
    state, out = seed, []
    for _ in range(2 * permutations):
        state = (state + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
        z = ((state ^ state >> 30) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
        z = ((z ^ z >> 27) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
        out.append(z ^ z >> 31)
    return list(zip(out[::2], (x | 1 for x in out[1::2]), strict=True))


def _minima(held: np.ndarray, starts: np.ndarray, made: list[tuple[int, int]]) -> np.ndarray:
    """The least value of each run of hashes under each permutation, (hash ^ mask) * factor."""
    out, x = np.empty((len(starts), len(made)), np.uint64), np.empty_like(held)
    for i, (mask, factor) in enumerate(made):
        np.bitwise_xor(held, np.uint64(mask), out=x)
        np.multiply(x, np.uint64(factor), out=x)
        out[:, i] = np.minimum.reduceat(x, starts)
    return out


def _signer(made: list[tuple[int, int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            at = 0
            while at < batch.num_rows:  # whole rows, about RUN hashes of them
                begin = int(ends[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(ends, begin + RUN, "right")))
                starts = np.concatenate(([begin], ends[at : to - 1])) - begin
                values = _minima(flat[begin : int(ends[to - 1])], starts, made).view(np.int64).reshape(-1)
                offsets = np.arange(to - at + 1, dtype=np.int32) * len(made)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.ListArray.from_arrays(offsets, values)], [batch.schema.names[0], "signature"])
                at = to

    return run


def signatures(sets: DataFrame, key: str, permutations: int = 128, seed: int = 1) -> DataFrame:
    """(key, signature) of sets(key, shingles): each shingle is hashed once, and its hash is permuted; empty sets are left out."""
    ship(sets.sparkSession)
    hashed = sets.where(F.size("shingles") > 0).select(key, F.transform("shingles", lambda s: F.xxhash64(s)).alias("_h"))
    schema = types.StructType([hashed.schema[key], types.StructField("signature", types.ArrayType(types.LongType()))])
    return hashed.mapInArrow(_signer(_constants(permutations, seed)), schema)


def similarity(a: Column, b: Column) -> Column:
    """The share of equal places of two signatures, which estimates the Jaccard similarity."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.size(a)


def bands_for(threshold: float, permutations: int = 128) -> tuple[int, int]:
    """(bands, rows) within so many permutations whose even odds of a shared band lie nearest to the threshold."""
    choices = [(permutations // rows, rows) for rows in range(1, permutations + 1)]
    return min(choices, key=lambda x: abs((1 - 0.5 ** (1 / x[0])) ** (1 / x[1]) - threshold))


def candidates(signed: DataFrame, key: str, threshold: float, permutations: int = 128) -> DataFrame:
    """(a, b) of signed(key, signature): each row with the smallest one of every band that it shares.

    Rows that share any band are connected through its smallest row, so there are no pairs within a band; components of
    these edges, or comparison within them, give all similar rows. The bands are saved, so rows are signed once.
    """
    bands, rows = bands_for(threshold, permutations)
    cut = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.slice("signature", i * rows + 1, rows)))
    dealt = signed.where("signature is not null").select(F.col(key).alias("b"), F.explode(cut).alias("band"))
    dealt = Scratch(signed.sparkSession, "minhash").save(dealt, "bands")
    lows = dealt.groupBy("band").agg(F.min("b").alias("a"), F.count("*").alias("n")).where("n > 1").select("band", "a")
    return dealt.join(lows, "band").where("a <> b").select("a", "b").distinct()
