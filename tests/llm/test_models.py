"""Toxicity, quality, language and secrets: held-out accuracy, and defined results for odd rows."""

import collections
import random
import zlib

import numpy as np
import pytest
from helpers import documents
from pyspark.sql import functions as F

from prefmill.llm import langid, quality, secretforest, toxicity
from prefmill.llm.base import table


def fold(key, n):
    return zlib.crc32(str(key).encode()) % n


def auc(score, label):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    n = label.sum()
    return (rank[label].sum() - n * (n + 1) / 2) / (n * (len(label) - n))


@pytest.fixture(scope="module")
def middle():
    return "/root/testdata/sf0.01"


def test_toxicity_held_out(spark, middle):
    docs, labels = table(spark, middle, "documents"), table(spark, middle, "labels")
    out = toxicity.predictions(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert all(fold(d, 3) == 1 for d in out["doc_id"])
    assert ((out["score"] >= 0) & (out["score"] <= 1)).all() and (out["predicted"] == (out["score"] >= 0.7)).all()
    assert auc(out["score"].to_numpy(), out["toxic"].to_numpy() > 0) > 0.8


def test_toxicity_labels_of_held_out_rows_change_nothing(spark, folder):
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    flipped = labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 3 = 1 THEN 1 - toxic ELSE toxic END AS toxic")
    assert sorted(map(tuple, toxicity.predictions(docs, labels).collect())) == sorted(map(tuple, toxicity.predictions(docs, flipped).collect()))


def test_grams_and_passages():
    grams = toxicity.Grams(["one two", "", " , ", "a b c d e f g h i"])
    assert grams.blocks.tolist() == [1, 0, 0, 3]
    a, b, owner = grams.passages()
    assert sorted(zip(a, b, owner)) == [(0, 0, 0), (1, 2, 3), (2, 3, 3)]
    assert (toxicity.Grams(["One, TWO."]).ids != 0).sum() == (toxicity.Grams(["one two"]).ids != 0).sum()
    word = toxicity.Grams(["abc"]).ids
    assert (word != 0).sum() == 3 + 2 + 1  # _ab abc bc_, _abc abc_, _abc_


def test_toxicity_odd_rows(spark):
    rows = [(i, "you awful zorgle person" if i % 2 else "a nice day for walking") for i in range(40)]
    docs = documents(spark, rows + [(100, None), (101, ""), (102, "!!! ..."), (103, "word " * 100_000 + "zorgle"), (None, "zorgle"), (1, "zorgle")])
    labels = spark.createDataFrame([(i, i % 2, 1) for i in range(40)] + [(None, 1, 1), (3, 0, 1), (5, None, 1)], "doc_id long, toxic int, quality int")
    out = {r["doc_id"]: r for r in toxicity.predictions(docs, labels).collect()}
    assert len(out) == 45 and out[100]["score"] == out[101]["score"] == out[102]["score"] < 0.5
    assert out[103]["predicted"] == 1 or out[103]["score"] > out[101]["score"]
    kept = toxicity.clean(docs, labels)
    assert kept.columns == docs.columns and {100, 101, 102} <= {r["doc_id"] for r in kept.collect()}
    assert toxicity.predictions(docs.limit(0), labels).count() == 0
    assert {r["score"] for r in toxicity.predictions(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.clean(docs, labels.limit(0)).count() == docs.count()


def test_quality_held_out(spark, middle):
    docs, labels = table(spark, middle, "documents"), table(spark, middle, "labels")
    out = quality.predictions(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert all(fold(d, 5) == 0 for d in out["doc_id"])
    assert ((out["predicted"] > 0) == (out["quality"] > 0)).mean() > 0.95 and (out["predicted"] == (out["score"] >= 0.3)).all()


def test_pairwise_term_is_the_sum_over_pairs():
    machine = quality.Machine(np.random.default_rng(1))
    machine.weights[:] = np.random.default_rng(2).normal(size=len(machine.weights))
    found = quality.features([b"one two two three", b""])
    owner, feature, value, n = machine.joined(found)
    for t in range(n):
        f, x = feature[owner == t], value[owner == t]
        v = machine.factors[f].astype(float)
        want = (machine.weights[f] * x).sum() + sum(v[i] @ v[j] * x[i] * x[j] for i in range(len(f)) for j in range(i))
        assert abs(machine.margins(found)[0][t] - want) < 1e-4


def test_quality_odd_rows(spark):
    docs = documents(spark, [(i, "good prose here" if i % 2 else "### $$$ %%%") for i in range(30)] + [(50, None), (51, ""), (None, "x"), (1, "dup"), (52, "w " * 300_000)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(None, 1)], "doc_id long, quality int")
    out = quality.predictions(docs, labels).collect()
    assert len(out) == 35 and all(0 <= r["score"] <= 1 for r in out)
    assert quality.predictions(docs.limit(0), labels).count() == 0
    assert {r["score"] for r in quality.predictions(docs, labels.limit(0)).collect()} == {1.0}


def plain_counts(text):
    out = collections.Counter()
    for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        for n in (1, 2, 3):
            padded = f" {word} "
            out.update(g for g in (padded[i:i + n] for i in range(len(padded) - n + 1)) if g != " ")
    return out


@pytest.mark.parametrize("part", [1 << 20, 5])
def test_gram_counts_equal_plain_ones(monkeypatch, part):
    monkeypatch.setattr(langid, "PART", part)
    rng = random.Random(1)
    for _ in range(500):
        text = "".join(rng.choice("ab é,ß1Z\nЖ") for _ in range(rng.randint(0, 25)))
        want = collections.Counter()
        for gram, n in plain_counts(text).items():
            code = 0
            for c in gram:
                code = code << 21 | (int(langid.BORDER) if c == " " else ord(c))
            want[code] += n
        grams, number = langid.counts(text)
        assert dict(zip(grams.tolist(), number.tolist())) == dict(want)


def test_distance_is_out_of_place():
    def code(c):
        return ord(c)
    profiles = langid.Profiles([("x", code("a"), 9), ("x", code("b"), 5), ("y", code("c"), 9), ("y", code("b"), 5)])
    name, score = profiles.predict("")
    assert (name, score) == ("und", 0.0)
    grams, place = langid.ranks(np.array([3, 5, 9], np.uint64), np.array([4, 7, 4]))
    assert grams.tolist() == [5, 3, 9] and place.tolist() == [0, 1.5, 1.5]


def test_language_held_out(spark, middle):
    docs = table(spark, middle, "documents")
    out = langid.predictions(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (out["lang_pred"] == out["lang"]).mean() > 0.97


def test_language_odd_rows(spark):
    rows = [(i, "the cat and the dog", "en", "s") if i % 2 else (i, "der hund und die katze", "de", "s") for i in range(40)]
    docs = documents(spark, rows + [(50, None, "en", "s"), (51, "", "de", "s"), (52, "12 !!", None, "s"), (53, "the the " * 100_000, None, None),
                                    (None, "und der hund", "de", "s"), (1, "the cat and the dog", "en", "s")])
    out = [(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.predictions(docs).collect()]
    got = {d: (p, s) for d, p, s in out}
    assert len(out) == 46 and got[50] == got[51] == got[52] == ("und", 0.0)
    assert got[53][0] == "en" and got[None][0] == "de" and all(got[i][0] == ("en" if i % 2 else "de") for i in range(40))
    assert langid.predictions(docs.limit(0)).count() == 0
    nothing = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.predictions(nothing).collect()} == {"und"}


def test_secrets(spark):
    rng = random.Random(2)

    def hexes(n):
        return "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows, truth = [], {}
    for i in range(120):
        key, number = hexes(40), "".join(rng.choice("0123456789") for _ in range(18))
        text = f"some ordinarywordsinarow here {number} and " + (f'token = "{key}" more' if i % 3 else "counterrevolutionary text")
        rows.append((i, text))
        truth[i] = f"{text.index(key)}:{text.index(key) + 40}" if i % 3 else ""
    bare = f"words {hexes(40)} words"
    docs = documents(spark, rows + [(500, bare), (501, None), (502, ""), (1, rows[1][1]), (None, "no"), (503, "a" * 200_000)])
    out = {r["doc_id"]: r for r in secretforest.scan(docs).collect()}
    assert all(out[i]["spans"] == truth[i] for i in range(120))
    assert out[501]["n_candidates"] == out[502]["n_candidates"] == 0 and out[503]["n_candidates"] == 1 and out[503]["n_secrets"] == 0
    assert out[500]["score"] > out[503]["score"]
    assert secretforest.scan(docs.limit(0)).count() == 0


def test_forest_learns_a_rule():
    rng = np.random.default_rng(0)
    x = rng.random((600, 6))
    y = ((x[:, 1] > 0.5) & (x[:, 4] < 0.6)).astype(float)
    forest = secretforest.Forest().fit(x[:400], y[:400])
    assert ((forest.scores(x[400:]) >= 0.5) == (y[400:] > 0)).mean() > 0.9
