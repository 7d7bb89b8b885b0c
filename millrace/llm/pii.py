"""Personal data by weak supervision.

Base patterns (e-mail, IP, card, phone) always count. Looser patterns propose further spans; regex, checksum,
gazetteer, context, shape and boundary labelers vote on every proposal (for, against or abstaining). The votes are
summed up to one count for each pattern of votes over all documents, a table whose size is bounded by the labelers
and not by the corpus. Expectation-maximisation estimates each labeler's reliability from these counts and gives every
pattern a probability; a logistic regression over kinds, votes and lengths is trained on them as soft labels and
decides which proposals become spans. Nothing is sampled.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrow import slices
from .store import Scratch

KINDS = ("email", "ip", "card", "phone", "ssn", "iban", "ipv6", "secret", "name")
BASE = 4
Span = tuple[int, int, int]  # kind, start, end in code points

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
# a match of the contract's pattern begins at the start of a run of digits, and so does one that fails
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        v = ord(c) - 48
        total += v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the e-mail pattern, found from each @ outwards, so that a long run of letters is read once."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[Span]:
    """The contract's spans of one text, by kind and start."""
    out = [(0, s, e) for s, e in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    if text.count(".") >= 3:
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split("."))]
    out += [(2, m.start(), m.end()) for m in _CARD.finditer(text) if 13 <= len(d := digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return out


# The looser patterns with strings of which each of their matches holds one, the gazetteers and the
# context words of each kind. Kind 0 is read outwards from its separator.
_AT = re.compile(r"\(at\)|\[at\]| at ")
_SPELT = re.compile(r" ?[A-Za-z0-9-]++(?: ?(?:\(dot\)|\[dot\]| dot |\.) ?[A-Za-z0-9-]++)+")
_DOT_WORD = re.compile(r"\(dot\)|\[dot\]| dot ")
_LOOSE = {
    2: (re.compile(r"(?<![0-9])[0-9]{4}(?:[ -]?[0-9]{4}){3}(?![0-9])"), None),
    3: (re.compile(r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"), None),
    4: (re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"), ("-",)),
    5: (re.compile(r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Z0-9])"), None),
    6: (re.compile(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])"), (":",)),
    7: (re.compile(r"(?i)\b(?:token|secret|password|passwd|api[_-]?key)\b[\"']?\s{0,2}[=:]\s{0,2}[\"']?[A-Za-z0-9_/+.-]{16,}+"), ("=", ":")),
    8: (re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sra?)\.? [^\W\d_a-z][^\W\d_]++(?: [^\W\d_a-z][^\W\d_]++)?"), ("Mr", "Ms", "Dr", "Prof", "Herr", "Frau", "Mme", "Sr")),
}
_CONTEXT = {
    0: ("mail", "contact", "write", "reach", "correo", "kontakt"), 2: ("card", "visa", "mastercard", "amex", "credit", "debit", "karte", "carte", "tarjeta"),
    3: ("call", "phone", "tel", "mobile", "fax", "contact", "anruf", "appel", "llam"), 4: ("ssn", "social", "security"), 5: ("iban", "account", "konto", "compte", "cuenta", "bank"),
    6: ("ip", "address", "host", "server"), 7: ("token", "secret", "password", "key", "auth"), 8: ("name", "contact", "dear", "patient", "signed", "from"),
}
_DOMAINS = frozenset("com org net edu gov io de fr es uk eu info biz".split())
_COUNTRIES = frozenset("AD AE AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK SM TR".split())
_TITLED = frozenset("Mr Mrs Ms Dr Prof Herr Frau Mme Sr Sra".split())
_LETTERS = {c: str(ord(c) - 55) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def _votes(kind: int, text: str, start: int, end: int) -> str:
    """One character for each labeler: + for, - against, 0 abstaining."""
    found = text[start:end]
    d = digits(found)
    # regex: the strict form of the kind
    strict = {0: "(at)" in found or "[at]" in found, 2: len(found) in (16, 19), 3: found[0] == "(" or found[3:4] == found[7:8], 4: True, 5: " " not in found or found[4:5] == " ", 6: True, 7: all(re.search(x, found.split("=")[-1].split(":")[-1]) for x in ("[0-9]", "[A-Za-z]")), 8: "." in found}[kind]
    # checksum
    check = "0"
    if kind == 2:
        check = "+" if luhn(d) else "-"
    elif kind == 4:
        check = "-" if d[:3] in ("000", "666") or d[0] == "9" or d[3:5] == "00" or d[5:] == "0000" else "+"
    elif kind == 5:
        flat = found.replace(" ", "")
        check = "+" if int("".join(_LETTERS.get(c, c) for c in flat[4:] + flat[:4])) % 97 == 1 else "-"
    # gazetteer
    named = "0"
    if kind == 0:
        named = "+" if re.split(r"[^A-Za-z0-9-]+", found)[-1].lower() in _DOMAINS else "-"
    elif kind == 5:
        named = "+" if found[:2] in _COUNTRIES else "-"
    elif kind == 8:
        named = "+" if re.split(r"\W+", found)[0] in _TITLED else "-"
    elif kind == 2:
        named = "+" if d[0] in "3456" else "-"
    # context
    before = text[max(0, start - 40) : start].lower()
    near = "+" if any(w in before for w in _CONTEXT[kind]) or (kind == 7) else "0"
    # shape
    shape = "0"
    if d and kind not in (0, 8):
        shape = "-" if len(set(d)) <= 2 else "+" if len(set(d)) >= 5 else "0"
    # boundary
    glued = (start > 0 and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum())
    return "".join(("+" if strict else "-", check, named, near, shape, "-" if glued else "+"))


class Taken:
    """Disjoint intervals in order; telling whether another one overlaps them takes a binary search."""

    def __init__(self, spans: list[Span]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s, e in sorted((s, e) for _, s, e in spans):
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def overlaps(self, s: int, e: int) -> bool:
        k = bisect.bisect_left(self.starts, e)  # those before k begin before e
        return k > 0 and s < self.ends[k - 1]

    def add(self, s: int, e: int) -> None:
        k = bisect.bisect_left(self.starts, s)
        self.starts.insert(k, s)
        self.ends.insert(k, e)


def _spelt(text: str) -> Iterator[tuple[int, int]]:
    """E-mail addresses with a written at sign; the plain word `at` counts only with a written dot after it."""
    if "(at)" not in text and "[at]" not in text and " at " not in text:
        return
    free = 0
    for m in _AT.finditer(text):
        end = start = m.start() - (m.start() > free and text[m.start() - 1] == " ")
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        d = _SPELT.match(text, m.end()) if start < end else None
        if d and (m[0].strip() != "at" or _DOT_WORD.search(d[0].lstrip())):
            yield start, d.end()
            free = d.end()


def proposals(text: str, base: list[Span]) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, pattern) of the looser patterns' matches that don't overlap a base span."""
    taken, numeric = Taken(base), bool(_DIGIT.search(text))
    found = [(0, s, e) for s, e in _spelt(text)]
    for kind, (pattern, needs) in _LOOSE.items():
        if any(x in text for x in needs) if needs else numeric:
            found += [(kind, *m.span()) for m in pattern.finditer(text)]
    return [(k, s, e, f"{k}{_votes(k, text, s, e)}{min(3, (e - s) // 10)}") for k, s, e in found if not taken.overlaps(s, e)]


LABELERS = 6


def learn(counts: dict[str, int], rounds: int = 40) -> dict[str, float]:
    """The probability of each pattern of votes: EM over labeler reliabilities, then a logistic regression on its soft labels."""
    if not counts:
        return {}
    keys = sorted(counts)
    n = np.array([counts[k] for k in keys], float)
    kind = np.array([int(k[0]) for k in keys])
    votes = np.array([["-0+".index(c) for c in k[1 : 1 + LABELERS]] for k in keys])
    p = 1 / (1 + np.exp(-(votes - 1).sum(axis=1)))  # a majority, to begin with
    for _ in range(rounds):
        odds = np.zeros(len(keys))
        for j in range(LABELERS):
            for v in range(3):
                at = votes[:, j] == v
                yes, no = ((n * w)[at].sum() + 1.0 for w in (p, 1 - p))
                odds[at] += np.log(yes / ((n * p).sum() + 3.0)) - np.log(no / ((n * (1 - p)).sum() + 3.0))
        for k in np.unique(kind):
            at = kind == k
            prior = ((n * p)[at].sum() + 1.0) / (n[at].sum() + 2.0)
            odds[at] += np.log(prior / (1 - prior))
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    x = np.hstack([np.eye(len(KINDS))[kind], *[(votes[:, [j]] == v).astype(float) for j in range(LABELERS) for v in (0, 2)], np.eye(4)[[int(k[-1]) for k in keys]]])
    weight, w = np.sqrt(n) / np.sqrt(n).sum(), np.zeros(x.shape[1])
    for _ in range(500):  # full-batch gradient with a small ridge
        w -= 2.0 * (x.T @ (weight * (1 / (1 + np.exp(-x @ w)) - p)) + 1e-4 * w)
    return dict(zip(keys, (1 / (1 + np.exp(-x @ w))).tolist(), strict=True))


def accepted(base: list[Span], proposed: list[tuple[int, int, int, str]], model: dict[str, float], least: float = 0.5) -> list[Span]:
    """Base spans and the proposals that the classifier takes, best first where they overlap; by kind and start."""
    out, taken = list(base), Taken(base)
    for k, s, e, pattern in sorted(proposed, key=lambda x: (-model.get(x[3], 0.0), x[1], x[0])):
        if model.get(pattern, 0.0) >= least and not taken.overlaps(s, e):
            out.append((k, s, e))
            taken.add(s, e)
    return sorted(out)


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


_FOUND = pa.list_(pa.struct([("k", pa.int32()), ("s", pa.int32()), ("e", pa.int32()), ("p", pa.string())]))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, found): base spans (p is null) and proposals of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = []
            for text in batch.column("text").fill_null("").to_pylist():
                base = base_spans(text)
                found.append([{"k": k, "s": s, "e": e, "p": None} for k, s, e in base] + [{"k": k, "s": s, "e": e, "p": p} for k, s, e, p in proposals(text, base)])
            yield pa.record_batch([batch.column("doc_id"), pa.array(found, _FOUND)], ["doc_id", "found"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, found array<struct<k: int, s: int, e: int, p: string>>")


def train(scanned: DataFrame) -> dict[str, float]:
    """The span classifier, from the votes on all proposals; the driver gets one count for each pattern of votes."""
    votes = scanned.select(F.explode("found.p").alias("p")).where("p is not null").groupBy("p").count()
    return learn({r["p"]: r["count"] for r in votes.collect()})


def find(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of the base spans, spans of all.

    A null text is empty and has no spans. Rows are judged one by one, so repeated rows, repeated ids and null ids come
    back as they are; an empty table gives an empty result; further columns are ignored.
    """
    scanned = Scratch(docs.sparkSession, "pii").save(scan(docs), "found")
    model = train(scanned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[] for _ in range(BASE)]
            digests, spans = [], []
            for found in batch.column("found").to_pylist():
                base = [(x["k"], x["s"], x["e"]) for x in found if x["p"] is None]
                for k in range(BASE):
                    counts[k].append(sum(x[0] == k for x in base))
                digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans.append(_joined(accepted(base, [(x["k"], x["s"], x["e"], x["p"]) for x in found if x["p"] is not None], model)))
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return scanned.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span's text replaced by its kind in brackets; n_chars follows if it is there.

    Null texts stay null and texts without a span as they are; repeated rows and ids and null ids come back row by row;
    all further columns are carried along, whatever their names; an empty table gives an empty result.
    """
    model = train(Scratch(docs.sparkSession, "pii").save(scan(docs), "found"))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            sizes = batch.column("n_chars").to_pylist() if "n_chars" in names else None
            for i, text in enumerate(texts):
                if text is None:
                    continue
                base = base_spans(text)
                spans = sorted(accepted(base, proposals(text, base), model), key=lambda x: (x[1], x[2]))
                at, out = 0, []
                for k, s, e in spans:
                    if e <= at:
                        continue
                    if s >= at:
                        out += [text[at:s], f"[{KINDS[k].upper()}]"]
                    at = e
                if spans:
                    texts[i] = "".join([*out, text[at:]])
                    if sizes is not None:
                        sizes[i] = len(texts[i])
            new = {"text": pa.array(texts, pa.string()), "n_chars": sizes and pa.array(sizes, batch.schema.field("n_chars").type)}
            yield pa.record_batch([new[n] if new.get(n) is not None else batch.column(n) for n in names], names)

    return docs.mapInArrow(run, docs.schema)
