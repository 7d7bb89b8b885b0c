"""Hierarchical multi-length packing of tokenised documents.

Documents are cut at the longest window and their remainders are routed to the smallest context tier that holds them.
Tiers are packed from the longest down: a remainder opens a window of its tier and the gap behind it is filled with
the largest pieces of shorter tiers that fit whole; when none fits, a piece is cut so that the window is exactly full.
What is left at the end of a partition is laid into windows of falling powers of two. Every window is thus full, so
nothing is padded. Windows of one tier form step groups of equal token counts; only the last group of each tier in a
partition can be short. A partition is packed alone: there is no shuffle, its state is under one window of tokens,
and a lost task gives the same rows again.
"""

from __future__ import annotations

import itertools
import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ..session import ship
from .arrow import slices

TIERS = (256, 512, 1024, 2048)
STEP_TOKENS = 16384
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier long, step_id long"

#: Fixed value: the pre-token pattern that byte-level tokenizer files of this kind mean by use_regex.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Fixed value: white space as \s of PATTERN has it.
SPACE = "\t\n\v\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG = 1000  # longer runs of white space are encoded apart, as the pattern's look-ahead keeps a stack entry a character
_LONG_RUN = re.compile(f"[{SPACE}]{{{LONG},}}")

_encodings: dict[str, tiktoken.Encoding] = {}


def encoding(path: str) -> tiktoken.Encoding:
    """One encoder for each worker process and byte-level BPE file of the tokenizers library.

    The file's merges come in the order of their ids, so its vocabulary can be run as ranks, which is several times as
    fast and gives the same ids; added tokens are recognised in the text, as that library does. A file that isn't of
    this kind is refused.
    """
    if path not in _encodings:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before, model = spec["pre_tokenizer"] or {}, spec["model"]
        if spec["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or model["type"] != "BPE":
            raise ValueError(f"{path} isn't a plain byte-level BPE tokenizer")
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        if any(model["vocab"][a] >= model["vocab"][b] for a, b in itertools.pairwise(merged)):
            raise ValueError(f"the merges of {path} are not in the order of their ids")
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
        _encodings[path] = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)
    return _encodings[path]


def encode(tokenizer: tiktoken.Encoding, text: str) -> np.ndarray:
    """The ids of a text, whatever it holds.

    The pattern takes a run of white space before other text without its last character, which goes with what follows,
    and a run at the end, or before an added token, whole; a long run is cut out at these places and merged as the one
    piece that it is.
    """
    parts, at, added = [], 0, tuple(tokenizer.special_tokens_set)
    for run in _LONG_RUN.finditer(text):
        end = run.end() - (run.end() < len(text) and not text.startswith(added, run.end()))
        parts.append(tokenizer.encode_to_numpy(text[at : run.start()], allowed_special="all"))
        parts.append(np.array(tokenizer._encode_single_piece(text[run.start() : end]), np.uint32))
        at = end
    if not parts:
        return tokenizer.encode_to_numpy(text, allowed_special="all")
    return np.concatenate([*parts, tokenizer.encode_to_numpy(text[at:], allowed_special="all")])


class Piece:
    """A run of one document's ids."""

    __slots__ = ("doc", "ids", "start", "total")

    def __init__(self, doc: int | None, total: int, start: int, ids: np.ndarray):
        self.doc, self.total, self.start, self.ids = doc, total, start, ids

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.total, self.start, self.ids[:n]), Piece(self.doc, self.total, self.start + n, self.ids[n:])


class Pool:
    """Pieces by length, with a bitmap of the lengths that are there."""

    def __init__(self) -> None:
        self.by: dict[int, list[Piece]] = defaultdict(list)
        self.bits = 0

    def add(self, p: Piece) -> None:
        n = len(p.ids)
        self.by[n].append(p)
        self.bits |= 1 << n

    def _take(self, n: int) -> Piece:
        p = self.by[n].pop()
        if not self.by[n]:
            self.bits ^= 1 << n
        return p

    def largest(self, most: int) -> Piece | None:
        """The largest piece of at most so many ids."""
        n = (self.bits & ((1 << (most + 1)) - 1)).bit_length() - 1
        return self._take(n) if n > 0 else None

    def smallest(self, most: int) -> Piece | None:
        """The smallest piece of all those of at most so many ids."""
        bits = self.bits & ((1 << (most + 1)) - 1)
        return self._take((bits & -bits).bit_length() - 1) if bits else None


class Packer:
    """Packs pieces into full windows; emit(window size, pieces) is called for each."""

    def __init__(self, emit, tiers: tuple[int, ...] = TIERS):
        self.emit, self.tiers, self.pool = emit, sorted(tiers), Pool()

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        top, total, at = self.tiers[-1], len(ids), 0
        while total - at >= top:
            self.emit(top, [Piece(doc, total, at, ids[at : at + top])])
            at += top
        if at < total:
            self.pool.add(Piece(doc, total, at, ids[at:]))

    def fill(self) -> None:
        """Form all windows that can be filled; less than one window stays in the pool."""
        for tier, lower in zip(self.tiers[::-1], [*self.tiers[-2::-1], 0], strict=True):
            while (p := self.pool.largest(tier)) is not None:
                if len(p.ids) <= lower:
                    self.pool.add(p)
                    break
                held, gap = [p], tier - len(p.ids)
                while gap:
                    q = self.pool.largest(gap)
                    if q is None:  # none fits whole
                        if (q := self.pool.smallest(tier)) is None:
                            break
                        q, rest = q.cut(gap)
                        self.pool.add(rest)
                    held.append(q)
                    gap -= len(q.ids)
                if gap:  # nothing is left to fill it with
                    for q in held:
                        self.pool.add(Piece(q.doc, q.total, q.start, q.ids.copy()))
                    return
                self.emit(tier, held)

    def finish(self) -> None:
        """Lay what is left into windows of falling powers of two."""
        self.fill()
        rest = []
        while (p := self.pool.largest(self.tiers[-1])) is not None:
            rest.append(p)
        left = sum(len(p.ids) for p in rest)
        while left:
            size = 1 << (left.bit_length() - 1)
            left -= size
            held, gap = [], size
            while gap:
                p = rest.pop(0)
                if len(p.ids) > gap:
                    p, more = p.cut(gap)
                    rest.insert(0, more)
                held.append(p)
                gap -= len(p.ids)
            self.emit(size, held)


def pack(docs: DataFrame, path: str, eos: int = 1, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_id.

    A document is the tokenizer's ids without special tokens, then eos; a null or empty text is eos alone. tier is the
    length of the piece's sequence. Every sequence is full, so none needs padding. Repeated rows and ids are packed
    row by row (their pieces share the id), a null id stays null, an empty table gives no rows, and further columns
    are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, part = encoding(path), TaskContext.get().partitionId() << 32
        rows: list[tuple] = []
        n_sequences, n_steps = 0, 0
        open_steps: dict[int, list[int]] = {}

        def emit(size: int, pieces: list[Piece]) -> None:
            nonlocal n_sequences, n_steps
            step = open_steps.get(size)
            if step is None or step[1] + size > step_tokens:
                step = open_steps[size] = [n_steps, 0]
                n_steps += 1
            step[1] += size
            at = 0
            for p in pieces:
                rows.append((p.doc, p.start, len(p.ids), zlib.crc32(p.ids.tobytes()), p.total, part | n_sequences, at, size, part | step[0]))
                at += len(p.ids)
            n_sequences += 1

        def table() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[] for _ in range(9)]
            out = pa.record_batch([pa.array(c, pa.int64()) for c in columns], [c.split()[0] for c in SCHEMA.split(", ")])
            rows.clear()
            return out

        packer = Packer(emit, tiers)
        for batch in slices(batches, "text", 1 << 20):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").fill_null("").to_pylist(), strict=True):
                packer.add(doc, np.append(encode(tokenizer, text), np.uint32(eos)).astype("<u4", copy=False))
            packer.fill()
            yield table()
        packer.finish()
        yield table()

    ship(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
