import hashlib
import random
import re

from helpers import documents

from prefmill.llm import pii

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group(0))
            valid = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group(0).split(".")),
                     "card": 12 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if valid:
                out.append((m.start(), rank, kind, m.end()))
    return [(s, k, e) for s, _, k, e in sorted(out)]


def base_spans(text, anchors=pii.automaton()):
    return [s for s in pii.spans_of(text, anchors) if s[1] in pii.BASE]


def test_base_spans_equal_the_patterns():
    random.seed(5)
    parts = ["1", "25", "256", "4111111111111111", ".", "@", "a", "b-", "+", "+49", " ", "-", "(", ")", "%", "é", "\n", "12345"]
    for _ in range(20000):
        text = "".join(random.choice(parts) for _ in range(random.randint(0, 30)))
        assert base_spans(text) == brute(text), text


def test_added_kinds_and_masks():
    text = "IBAN DE89 3704 0044 0532 0130 00, SSN: 123-45-6789, https://joe:pw1@h.org kim (at) ex (dot) com"
    spans = pii.spans_of(text, pii.automaton())
    assert [k for _, k, _ in spans] == ["iban", "ssn", "login", "email", "mailat"]
    assert pii.masked(text, spans) == "IBAN [IBAN], SSN: [SSN], https://[LOGIN] [MAILAT]"
    assert pii.masked("plain words 12", []) == "plain words 12"


def test_table_cases(spark):
    long = "x " * 300_000 + "joe@ex.org"
    docs = documents(spark, [(1, None), (2, ""), (3, "a@b.cd 10.0.0.1"), (3, "a@b.cd 10.0.0.1"), (4, long), (None, "no")])
    out = {r["doc_id"]: r for r in pii.scan(docs).collect()}
    assert pii.scan(docs).count() == 6
    assert out[1]["spans"] == "" and out[1]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert out[3]["spans"] == "email:0:6,ip:7:15" and out[3]["base_sha256"] == hashlib.sha256(b"email:0:6,ip:7:15").hexdigest()
    assert out[4]["n_email"] == 1 and out[4]["spans"] == "email:600000:600010"
    clean = pii.redact(docs)
    assert clean.columns == docs.columns
    got = {r["doc_id"]: r for r in clean.collect()}
    assert got[1]["text"] is None and got[3]["text"] == "[EMAIL] [IP]" and got[3]["n_chars"] == 12 and got[None]["text"] == "no"
    assert pii.scan(docs.limit(0)).count() == 0 and pii.redact(docs.limit(0)).count() == 0
