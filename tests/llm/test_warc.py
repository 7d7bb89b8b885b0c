"""ZIP reading against the standard library, and the WARC round trip against plain Python."""

import hashlib
import io
import random
import zipfile

import pytest

from millrace.llm import warc


def zipped(members, always64=False):
    out = io.BytesIO()
    z = warc.ZipWriter(out, always64)
    for name, raw in members.items():
        z.begin(name)
        z.write(raw[:3])
        z.write(raw[3:])
        z.end()
    z.close()
    return out.getvalue()


MEMBERS = {"a.txt": b"hello world", "b/é.bin": bytes(range(256)) * 9, "empty": b""}


@pytest.mark.parametrize("always64", [False, True])
def test_own_archives_by_both_readers(always64):
    raw = zipped(MEMBERS, always64)
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        assert {n: z.read(n) for n in z.namelist()} == MEMBERS
    z = warc.ZipReader(io.BytesIO(raw))
    assert {n: z.member_range(n, 0, z.members[n][2]) for n in z.members} == MEMBERS
    assert z.member_range("a.txt", 6, 5) == b"world"
    with pytest.raises(ValueError):
        z.member_range("a.txt", 6, 6)


def test_library_archives_with_comment_and_compression():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("x", b"stored")
        z.writestr("y", b"deflated" * 50, zipfile.ZIP_DEFLATED)
        z.comment = b"with PK\x05\x06 in the comment"
    z = warc.ZipReader(out)
    assert z.member_range("x", 0, 6) == b"stored"
    with pytest.raises(ValueError, match="compressed"):
        z.locate("y")


def test_broken_archives():
    raw = zipped(MEMBERS)
    for bad in (b"", b"PK", raw[:-1], raw[: len(raw) // 2]):
        with pytest.raises(ValueError):
            warc.ZipReader(io.BytesIO(bad))


def brute(rows):
    first = {}
    for i, _, html in rows:
        raw = (html or "").encode()
        if i is not None and len(raw) >= 100:
            first[raw] = min(i, first.get(raw, i))
    out = []
    for i, _, html in rows:
        raw = (html or "").encode()
        again = i is not None and len(raw) >= 100 and i != first[raw]
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[raw] if again else None))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_round_trip(spark):
    rng = random.Random(2)
    bodies = [None, "", "é" * 49, "é" * 50, "x" * 99, "x" * 100, "<p>\r\n\r\nWARC/1.1</p>" * 40, "y" * 300000]
    rows = [(i * 7 % 101, f"http://a/{i} b\n", rng.choice(bodies)) for i in range(101)] + [(None, None, "x" * 100), (3, "u", "x" * 100), (3, "u", "x" * 100)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as kind").repartition(3)
    assert got(warc.archive_round_trip(df)) == brute(rows)


def test_whole_pages_table(spark, sf):
    df = spark.read.parquet(f"{sf}/pages.parquet")
    assert got(warc.archive_round_trip(df)) == brute([(r.page_id, r.url, r.html) for r in df.collect()])


def test_empty(spark):
    assert warc.archive_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
