"""Base spans against the contract's own patterns; the classifier on planted proposals."""

import hashlib
import random
import re
import time

from millrace.llm import pii, queries

RULES = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(re.sub("[^0-9]", "", s)) <= 19 and plain_luhn(re.sub("[^0-9]", "", s))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15),
]


def plain_luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0


def brute(text):
    return [(k, m.start(), m.end()) for k, (_, p, ok) in enumerate(RULES) for m in re.finditer(p, text) if ok(m[0])]


def joined(spans):
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in spans)


def test_random_texts():
    rng = random.Random(9)
    for _ in range(4000):
        text = "".join(rng.choice(["1", "4", "0", "9", "25", ".", ".", "@", "a", "b-", " ", "-", "+", "(", ")", "é", "4111111111111111", "x@y.z", "256"]) for _ in range(rng.randrange(40)))
        assert pii.base_spans(text) == brute(text), text


def test_long_runs_stay_linear():
    began = time.time()
    for text in ("a" * 10**6 + " 1", "9" * 10**6, "1." * 500000, "a@" * 300000, "+1" + "." * 10**6, "1 " * 500000, "a@b" + ".c" * 300000):
        pii.proposals(text, pii.base_spans(text))
    assert time.time() - began < 30


def test_whole_documents_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in pii.find(df).collect()}
    texts = {r.doc_id: r.text for r in df.collect()}
    assert set(rows) == set(texts)
    for i, t in texts.items():
        base, r = brute(t), rows[i]
        assert r.base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in range(4)]
        assert set(joined(base).split(",")) <= set(r.spans.split(","))


def test_classifier_takes_good_proposals(spark):
    good = ["Call me: tel (212) 555-0187 now", "my ssn is 219-09-9999 ok", "IBAN DE89 3704 0044 0532 0130 00 bank", "write to joe (at) example (dot) com please", 'token = "186661156f3f9905942d70850a01cbf2"']
    bad = ["x4111 1111 1111 1112y", "9999 9999 9999 9999", "a(000-00-0000)b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate((good + bad) * 40)], "doc_id long, text string")
    rows = {r.doc_id: r.spans for r in pii.find(df).collect()}
    assert all(rows[i] for i in range(len(good)))
    assert not any(rows[len(good) + i] for i in range(len(bad)))
    out = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert out[1] == "my ssn is [SSN] ok" and out[len(good)] == bad[0]


#: The looser patterns once more, over whole texts and without any test that skips them.
WRITTEN, LABEL = r"(?:\(dot\)|\[dot\]| dot )", "[A-Za-z0-9-]+"
REST = rf"(?: ?(?:{WRITTEN}|\.) ?{LABEL})"
SPELT = re.compile(rf"[A-Za-z0-9._%+-]+ ?(?:(?:\(at\)|\[at\]) ?{LABEL}{REST}+| at  ?{LABEL}(?={REST}* ?{WRITTEN} ?{LABEL}){REST}+)")


def brute_proposals(text, base):
    found = [(0, *m.span()) for m in SPELT.finditer(text)]
    found += [(k, *m.span()) for k, (p, _) in pii._LOOSE.items() for m in p.finditer(text)]
    return [(k, s, e, f"{k}{pii._votes(k, text, s, e)}{min(3, (e - s) // 10)}") for k, s, e in found if not any(s < y and x < e for _, x, y in base)]


def brute_spans(texts):
    """All spans of the method: every pair of spans compared, votes counted over all texts."""
    counts, made = {}, {}
    for i, t in texts.items():
        base = brute(t)
        made[i] = base, brute_proposals(t, base)
        for p in made[i][1]:
            counts[p[3]] = counts.get(p[3], 0) + 1
    model, out = pii.learn(counts), {}
    for i, (base, proposed) in made.items():
        spans = list(base)
        for k, s, e, p in sorted(proposed, key=lambda x: (-model[x[3]], x[1], x[0])):
            if model[p] >= 0.5 and not any(s < y and x < e for _, x, y in spans):
                spans.append((k, s, e))
        out[i] = joined(sorted(spans))
    return out


def test_registered_query_equals_brute_force(spark, sf, tmp_path):
    planted = ["ssn 219-09-9999", "IBAN DE89 3704 0044 0532 0130 00", "Dr. Ada Lovelace wrote", "x666-00-0000y 000-00-0000", "secret: " + "k3" * 20, "ann [at] site (dot) org or 212-555-0187"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs.union(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(planted * 5)], docs.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()}
    got = {r.doc_id: r.spans for r in queries.queries()["op8_weakly_supervised_pii"](spark, str(tmp_path)).collect()}
    want = brute_spans(texts)
    assert got == want and all(k in ",".join(want.values()) for k in ("ssn", "secret", "name", "iban"))


def test_proposals_equal_brute_force():
    rng = random.Random(4)
    parts = ["joe", "a.b", " ", " ", " at ", "(at)", " [at] ", "x", " dot ", ".", "com", "123-45-6789", "Dr. Ada Lo", "token=abcdefghijklmnopqrst", "PASSWORD: abcdefghijklmnopqrst", "212-555-0187", "a@b.co", "1:2:3:4:5:6:7:8", "\n"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(25)))
        base = pii.base_spans(text)
        assert sorted(pii.proposals(text, base)) == sorted(brute_proposals(text, base)), text


def test_many_spans_take_linear_time():
    text = "a@b.co 10.0.0.1 212-555-0187 219-09-9999 joe (at) x.com " * 20_000
    began = time.time()
    base = pii.base_spans(text)
    proposed = pii.proposals(text, base)
    assert len(pii.accepted(base, proposed, {p[3]: 0.9 for p in proposed})) == 100_000
    assert time.time() - began < 20


def test_redaction_keeps_other_columns(spark):
    df = spark.createDataFrame([(None, "a@b.co", 1, "x"), (2, None, 2, "y"), (2, None, 2, "y")], "doc_id long, text string, found int, p string")
    out = pii.redact(df)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(None, "[EMAIL]", 1, "x"), (2, None, 2, "y"), (2, None, 2, "y")], key=str)
    assert pii.redact(df.where("false")).collect() == []


def test_edges(spark):
    df = spark.createDataFrame([(None, None, 1), (1, "", 0), (1, "mail a@b.co, 10.0.0.1", 21), (1, "mail a@b.co, 10.0.0.1", 21)], "doc_id long, text string, n_chars long")
    rows = pii.find(df).collect()
    assert sorted(r.spans for r in rows) == ["", "", "email:5:11,ip:13:21", "email:5:11,ip:13:21"]
    assert pii.find(df.where("false")).collect() == []
    out = pii.redact(df)
    assert out.columns == df.columns
    assert sorted((r.text or "", r.n_chars) for r in out.collect()) == [("", 0), ("", 1), ("mail [EMAIL], [IP]", 18), ("mail [EMAIL], [IP]", 18)]
