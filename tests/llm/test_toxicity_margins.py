"""Margins of texts against plain loops over words and grams, equal scores, and a very long labelled text."""

import random

import numpy as np
from helpers import documents

from prefmill.llm import toxicity as T


def plain_words(text):
    data = bytes(32 if b in T._PUNCTUATION or b < 32 or b == 127 else b for b in text.lower().encode("utf-8", "replace"))
    out = []
    for word in data.split(b" "):
        if word and (not out or out[-1] != word):
            out.append(word)
        elif word:
            continue
    return out


def bucket(gram):
    code = sum(int(T._PLACE[k][b]) for k, b in enumerate(gram)) % 2**32
    return max(((code + len(gram)) * 0x9E3779B1 % 2**32) >> 15, 1)


def plain_margin(model, text):
    words = plain_words(text)
    blocks = [words[i:i + T.BLOCK] for i in range(0, len(words), T.BLOCK)]
    passages = [a + b for a, b in zip(blocks, blocks[1:])] or blocks
    best = -np.inf
    for passage in passages:
        total, number = 0.0, 0
        for word in passage:
            padded = b" " + word + b" "
            for n in T.GRAMS:
                for i in range(len(padded) - n + 1):
                    total += float(model.table[bucket(padded[i:i + n])])
                    number += 1
        best = max(best, total / max(number, T.FEWEST) + model.bias)
    return best


def test_margins_equal_plain_loops():
    rng = random.Random(5)
    table = np.random.default_rng(6).normal(size=T.BUCKETS).astype(np.float32)
    table[0] = 0
    model = T.Model(table, 0.25, (1.0, 0.0), 0.5)
    parts = ["you", "You,", "YOU", "zorgle", "é😀", "a", "...", "\t", "  ", "don't", "x1", "word", "straße", "\u007f"]
    texts = ["", " ", "...", "a"] + [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(120)]
    want = [plain_margin(model, t) for t in texts]
    assert np.allclose(model.margins(texts), want, rtol=1e-4, atol=1e-4)
    assert np.allclose([model.margins([t])[0] for t in texts[3:30]], want[3:30], rtol=1e-4, atol=1e-4)  # whatever stands beside a text


def test_equal_texts_score_alike_and_a_long_labelled_text_trains(spark):
    rows = [(i, "you awful zorgle person" if i % 2 else "a nice day for walking") for i in range(30)]
    rows += [(100, "plain words of a long text here " * 40_000 + "you awful zorgle person"), (101, "you awful zorgle person"), (102, "you awful zorgle person")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(100, 1)], "doc_id long, toxic int")
    out = {r["doc_id"]: r["score"] for r in T.predictions(documents(spark, rows), labels).collect()}
    assert out[101] == out[102] == out[1] and out[101] > 0.5 > out[0]


def test_texts_are_scored_in_bounded_steps(spark, monkeypatch):
    """What tasks hold for grams follows from SCORED; scores do not depend on it."""
    limits, mapped = [], T.map_steps
    monkeypatch.setattr(T, "map_steps", lambda *a, **k: limits.append(k.get("limit", 1_000_000)) or mapped(*a, **k))
    table = np.random.default_rng(6).normal(size=T.BUCKETS).astype(np.float32)
    model = T.Model(table, 0.0, (1.0, 0.0), 0.5)
    docs = documents(spark, [(i, f"text{i} of words{i % 7} " * 60 * i) for i in range(60)] + [(99, "long " * 100_000), (100, None)]).coalesce(1)
    got = {r["doc_id"]: r["score"] for r in T.scored(docs, model).collect()}
    assert limits == [T.SCORED] and T.SCORED <= 250_000
    assert got == {r["doc_id"]: model.scores([r["text"] or ""])[0] for r in docs.collect()}
