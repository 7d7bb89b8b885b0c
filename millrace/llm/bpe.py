"""Byte-level BPE with a hierarchical-bitmap rank queue.

Each pre-token is merged on a linked list of byte positions. Every merge rank has a bucket with the positions whose
pair has that rank, and a two-level bitmap marks the buckets that hold something: find-first-set on the upper level
and then on the lower one gives the next rank. Entries whose pair has changed since are skipped when they come up.
Pushing and popping cost a few integer operations whatever the length, so very long pre-tokens stay near linear.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ..session import ship
from .arrow import slices

CACHE = 600 << 20  # bytes of all caches of a worker process
LEAF = 8  # bits of a rank that its leaf of the bitmap holds
_BIT = [1 << i for i in range(1 << LEAF)]


class Recent:
    """A cache of so many bytes in two generations: when the young one holds half of them it becomes the old one, and the old one goes."""

    __slots__ = ("held", "most", "old", "young")
    ENTRY = 200  # bytes of an entry besides its texts: two objects and a place in the table

    def __init__(self, most: int):
        self.most, self.held, self.young, self.old = most // 2, 0, {}, {}

    def get(self, key: str) -> bytes | bool | None:
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key: str, value: bytes | bool) -> None:
        if self.held >= self.most:
            self.old, self.young, self.held = self.young, {}, 0
        self.young[key] = value
        self.held += self.ENTRY + 2 * len(key) + (len(value) if value else 0)


class Coder:
    """Encoder and decoder for one rank file; encode_piece works on the bytes of one pre-token."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.vocabulary = {r: t for t, r in self.ranks.items()}
        self.decimal = {r: str(r) for r in self.vocabulary}
        self.pattern = regex.compile(pattern)
        self.seen = Recent(CACHE // 4)
        self.chunks = ChunkCache(lambda pieces: [b"".join(map(self.pre_token, self.pattern.findall(p))) for p in pieces])

    def encode_piece(self, piece: bytes) -> list[int]:
        """Merge one pre-token. The queue's operations are written out here, as calls would cost most of the time."""
        ranks = self.ranks
        get = ranks.get
        if (whole := get(piece)) is not None:
            return [whole]
        n = len(piece)
        after = list(range(1, n + 2))  # of each part, where the next one starts; n ends the list
        before = list(range(-1, n))
        pair = [get(piece[i : i + 2], -1) for i in range(n - 1)]  # the rank of a part with its right neighbour, -1 if
        pair += (-1, -1)  # there is none or the part is gone
        buckets: dict[int, list[int]] = {}  # of each rank, a heap of positions
        leaves: dict[int, int] = {}
        top = 0
        for i, r in enumerate(pair):
            if r >= 0:
                if r in buckets:
                    buckets[r].append(i)
                else:
                    buckets[r] = [i]
                    leaf = r >> LEAF
                    leaves[leaf] = leaves.get(leaf, 0) | _BIT[r & 255]
                    top |= 1 << leaf
        while top:
            leaf = (top & -top).bit_length() - 1
            bits = leaves[leaf]
            low = bits & -bits
            rank = (leaf << LEAF) + low.bit_length() - 1
            held = buckets[rank]
            if len(held) > 1:
                i = heappop(held)
            else:
                i = held[0]
                del buckets[rank]
                leaves[leaf] = bits ^ low
                if bits == low:
                    top ^= 1 << leaf
            if pair[i] != rank:
                continue  # stale
            j = after[i]
            k = after[i] = after[j]
            pair[j] = -1
            if k < n:
                before[k] = i
                r = pair[i] = get(piece[i : after[k]], -1)
            else:
                r = pair[i] = -1
            while True:
                if r >= 0:
                    if r in buckets:
                        heappush(buckets[r], i)
                    else:
                        buckets[r] = [i]
                        leaf = r >> LEAF
                        leaves[leaf] = leaves.get(leaf, 0) | _BIT[r & 255]
                        top |= 1 << leaf
                h = before[i] if k >= 0 else -1
                if h < 0:
                    break
                i, r, k = h, get(piece[h:k], -1), -1  # then the same for the left neighbour
                if r == pair[i]:
                    break
                pair[i] = r
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def pre_token(self, piece: str) -> bytes:
        """The ids of a pre-token as native unsigned 32-bit integers; short ones are remembered."""
        found = self.seen.get(piece)
        if found is None:
            found = array("I", self.encode_piece(piece.encode())).tobytes()
            if len(piece) <= 32:
                self.seen.put(piece, found)
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.chunks.encode(texts)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids))


class ChunkCache:
    """Encodes texts by the pieces between single spaces and remembers the ids of the pieces.

    The pre-token pattern never matches across the place before a space that stands between two other non-space
    characters, so such pieces, with their leading space, can be encoded apart. A text with a piece that is empty or
    begins or ends with white space is encoded as a whole. encode_many gives the ids of strings as bytes.
    """

    def __init__(self, encode_many: Callable[[list[str]], list[bytes]], most: int = CACHE // 2):
        self.encode_many = encode_many
        self.first, self.later = Recent(most // 8), Recent(most)

    def _learn(self, known: Recent, pieces: set[str], lead: str) -> dict[str, bytes | bool]:
        fresh = {p: v for p in pieces if (v := known.get(p)) is not None}
        pieces = pieces - fresh.keys()
        odd = {p for p in pieces if not p or p[0].isspace() or p[-1].isspace()}
        plain = sorted(pieces - odd)
        fresh.update(dict.fromkeys(odd, False))
        fresh.update(zip(plain, self.encode_many([lead + p for p in plain]), strict=True))
        for p in pieces:
            if len(p) <= 64:
                known.put(p, fresh[p])
        return fresh

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [t.split(" ") for t in texts]
        fresh = self._learn(self.first, {c[0] for c in cut}, "")
        parts, missing, lacking, get = [], set(), [], self.later.young.get
        for k, c in enumerate(cut):
            rest = list(map(get, c))
            rest[0] = fresh[c[0]]
            if None in rest:
                lacking.append(k)
                missing.update(p for p, v in zip(c, rest, strict=True) if v is None)
            parts.append(rest)
        if missing:
            fresh = self._learn(self.later, missing, " ")
            for k in lacking:
                parts[k] = [fresh[p] if v is None else v for p, v in zip(cut[k], parts[k], strict=True)]
        out = []
        for k, t in enumerate(texts):
            try:
                out.append(b"".join(parts[k]))
            except TypeError:  # a piece that can't be encoded apart
                out.append(self.encode_many([t])[0] if t else b"")
        return out


_coders: dict[tuple[str, str], Coder] = {}


def coder(path: str, pattern: str) -> Coder:
    """One coder for each worker process and rank file."""
    if (path, pattern) not in _coders:
        _coders[path, pattern] = Coder(path, pattern)
    return _coders[path, pattern]


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode every text, then decode its ids.

    A null text is empty: no tokens, and both digests are that of the empty string. Rows are independent of each
    other, so repeated rows and ids, null ids and empty tables need no care; further columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        for batch in slices(batches, "text", 1 << 20):
            texts = batch.column("text").fill_null("").to_pylist()
            counts, encoded, decoded = [], [], []
            for raw in c.encode(texts):
                ids = memoryview(raw).cast("I").tolist()
                counts.append(len(ids))
                encoded.append(hashlib.sha256(",".join(map(c.decimal.__getitem__, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.record_batch([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    ship(docs.sparkSession)
    return docs.selectExpr("doc_id", f"`{text}` as text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        for batch in slices(batches, "text", 1 << 20):
            ids = [memoryview(raw).cast("I").tolist() for raw in c.encode(batch.column("text").fill_null("").to_pylist())]
            yield pa.record_batch([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    ship(docs.sparkSession)
    return docs.selectExpr("doc_id", f"`{text}` as text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); bytes that aren't UTF-8 become the replacement character."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        for batch in batches:
            texts = [None if ids is None else c.decode(ids).decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    ship(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
