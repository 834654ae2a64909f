"""Personal data: base spans against plain regular expressions, added spans case by case."""

import hashlib
import random
import re

import pytest

from rankshift.llm import pii

PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def passes(kind, run):
    d = re.sub("[^0-9]", "", run)
    if kind == 1:
        return all(int(p) <= 255 for p in run.split("."))
    if kind == 2:
        twice = [int(c) * 2 for c in d[-2::-2]]
        return 14 <= len(d) <= 19 and (sum(map(int, d[-1::-2])) + sum(x // 10 + x % 10 for x in twice)) % 10 == 0
    return kind == 0 or 10 <= len(d) <= 15


def plain(text):
    return sorted((m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text)
                  if passes(k, m.group()))


def test_base_spans_equal_the_patterns():
    auto, rng, found = pii.anchors(), random.Random(3), 0
    parts = ["@", ".", "1", "2", "90", "a", "B", "-", " ", "+", "(", ")", "é", "%", "user@ex.com", "10.0.0.1", "256",
             "4111 1111 1111 1111", "+1 (523) 555-1055", "İ", "tel:", "iban ", "::", "[at]", "0001", "..", "٠"]
    for _ in range(20000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(30)))
        base, spans = pii.scan(text, auto)
        assert base == plain(text), text
        assert set(base) <= set(spans) and spans == sorted(spans)
        found += len(base)
    assert found > 10000


@pytest.mark.parametrize("text, kind, part", [
    ("mail john [at] example [dot] com now", "email", "john [at] example [dot] com"),
    ("see x%40y.org.", "email", "x%40y.org"), ("müller@exämple.de!", "email", "müller@exämple.de"),
    ('"john doe"@example.com', "email", '"john doe"@example.com'), ("to MAILTO:Bob@Host ok", "email", "Bob@Host"),
    ("u@[192.168.1.1]", "email", "u@[192.168.1.1]"), ("tel:555-1234567", "phone", "555-1234567"),
    ("Phone no. 0049 30/1234567, x", "phone", "0049 30/1234567"),
    ("IBAN: DE89 3704 0044 0532 0130 00 and more", "card", "DE89 3704 0044 0532 0130 00"),
    ("card 4111.1111.1111.1111", "card", "4111.1111.1111.1111"), ("account no 12345678", "card", "12345678"),
    ("http://[2001:db8::1]/", "ip", "2001:db8::1"), ("see 2001:db8::8a2e:370:7334.", "ip", "2001:db8::8a2e:370:7334"),
    ("İ IP: 2001:0db8:85a3:0000:0000:8a2e:0370:7334,", "ip", "2001:0db8:85a3:0000:0000:8a2e:0370:7334"),
])
def test_other_spellings(text, kind, part):
    _, spans = pii.scan(text, pii.anchors())
    assert (text.index(part), pii.KINDS.index(kind), text.index(part) + len(part)) in spans


@pytest.mark.parametrize("text", ["hotel: 1234567890", "std::vector a::b", "IBAN DE88 3704 0044 0532 0130 00",
                                  "card 4111.1111.1111.1112", "a@b", "phone home", "account of 12345678 euros",
                                  "one of 3.14 and 256.1.1.1", "", "İ" * 50])
def test_clean_texts_stay(text):
    assert pii.scan(text, pii.anchors()) == ([], [])


def test_linear_on_long_runs():
    auto = pii.anchors()
    for unit in ("a@", "1.", "+1 ", "1 ", "::", "tel:1", "card 1 ", "iban DE89 ", "é@", '"', "[at]", "phone (", "@a-"):
        pii.scan(unit * 200_000, auto)


def test_whole_table(spark):
    big = "x " * 200_000 + "a@b.org " + "+1 (523) 555-1055"
    rows = [(1, None, "k"), (2, "", "k"), (3, big, "k"), (4, "a@b.cc 1.2.3.4", None), (4, "a@b.cc 1.2.3.4", None),
            (None, "tel:5551234567", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string").repartition(3)
    auto = pii.anchors()
    want = []
    for i, t, _ in rows:
        base, spans = pii.scan(t or "", auto)
        listed = [",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in x) for x in (base, spans)]
        want.append((i, *(sum(b[1] == k for b in base) for k in range(4)),
                     hashlib.sha256(listed[0].encode()).hexdigest(), listed[1]))
    got = [tuple(r) for r in pii.op12(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    whole = pii.pii_scan(docs)
    assert whole.columns.count("spans") == 1
    assert whole.where("doc_id = 4").first()["redacted"] == "[EMAIL] [IP]"
    assert pii.op12(docs.limit(0)).count() == 0


def test_documents_equal_the_patterns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want = {}
    for i, t in docs.collect():
        base = plain(t or "")
        listed = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
        want[i] = (*(sum(b[1] == k for b in base) for k in range(4)), hashlib.sha256(listed.encode()).hexdigest())
    got = {r[0]: tuple(r)[1:6] for r in pii.op12(docs).collect()}
    assert got == want and sum(w[0] for w in want.values()) > 0
