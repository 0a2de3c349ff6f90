import math
import random
import string

import numpy as np
from helpers import documents

from prefmill.llm import secretforest


def corpus_texts(rng, size=160):
    """Each text holds two plain strings of 20 signs, one in capitals and one in small letters, without any cue."""
    rows, spans = [], []
    for i in range(size):
        upper = "".join(rng.choice(string.ascii_uppercase + string.digits) for _ in range(20))
        lower = "".join(rng.choice(string.ascii_lowercase + string.digits) for _ in range(20))
        text = f"some words here {upper} and more {lower} end"
        rows.append((i, text))
        spans += [(i, text.index(upper), text.index(upper) + 20, "u"), (i, text.index(lower), text.index(lower) + 20, "l")]
    return rows, spans


def test_labelled_findings_decide_what_a_secret_is(spark):
    rows, spans = corpus_texts(random.Random(1))
    docs = documents(spark, rows)
    found = {}
    for kind in "ul":
        labels = [(i, a, b, int(k == kind)) for i, a, b, k in spans if i < 120]
        labels += [(9999, 0, 5, 1), (0, 0, 10**6, 1), (0, 5, 5, 1), (1, -3, 4, 0), (2, 0, 4, None), *labels[:3]]
        findings = spark.createDataFrame(labels, "doc_id long, start long, end long, label int")
        out = {r["doc_id"]: r["spans"] for r in secretforest.scan(docs, findings=findings).collect()}
        want = {i: f"{a}:{b}" for i, a, b, k in spans if k == kind}
        found[kind] = np.mean([out[i] == want[i] for i in range(120, 160)])
    assert found["u"] > 0.9 and found["l"] > 0.9
    # without them there is no cue in these texts, so nothing is one
    assert secretforest.scan(docs, findings=findings.limit(0)).filter("n_secrets > 0").count() == 0


def test_hot_document_of_findings(spark):
    rows, spans = corpus_texts(random.Random(2), 40)
    long_text = " ".join(t for _, t in rows)
    marks = [(7, m, m + 20, int(long_text[m].isupper())) for m in range(0, len(long_text) - 20, 7)]
    docs = documents(spark, [(7, long_text), (7, long_text)])
    findings = spark.createDataFrame(marks, "doc_id long, start long, end long, label int")
    corpus = secretforest.Corpus(secretforest.trigram_counts(docs))
    assert secretforest.candidates(docs, corpus, findings).count() >= len({(a, b) for _, a, b, _ in marks})


def test_features_equal_plain_counting():
    rng = random.Random(3)
    corpus = secretforest.Corpus(np.ones(secretforest.SIGNS ** 3, np.int64))
    for _ in range(200):
        value = "".join(rng.choice("abcXYZ019_-+=") for _ in range(rng.randint(16, 60)))
        before, path = rng.choice(["token = ", "sha: ", "x ", "password: '", "/"]), rng.choice(["a/b/test.py", "", "x.json"])
        text = before + value + "' rest"
        got = corpus.features(text, len(before), len(before) + len(value), path)
        shares = [value.count(c) / len(value) for c in set(value)]
        assert got[0] == len(value) and abs(got[1] + sum(p * math.log2(p) for p in shares)) < 1e-9
        assert abs(got[2] - sum(c.isupper() for c in value) / len(value)) < 1e-9 and abs(got[3] - sum(c.islower() for c in value) / len(value)) < 1e-9
        assert abs(got[4] - sum(c.isdigit() for c in value) / len(value)) < 1e-9
        assert abs(got[8] - sum(a == b for a, b in zip(value, value[1:])) / (len(value) - 1)) < 1e-9
        assert abs(got[9] - len(set(value)) / len(value)) < 1e-9
        assert got[14] == any(w in before.lower() for w in secretforest.SECRET_WORDS) and got[19] == path.count("/")
