import random

import numpy as np
from helpers import documents
from pyspark import cloudpickle

from prefmill.llm import decontaminate
from prefmill.llm.base import table


def naive_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_lcs_equals_the_table_method():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.randrange(1, 5) for _ in range(rng.randrange(0, 12))] for _ in range(2))
        assert decontaminate.lcs(a, b) == naive_lcs(a, b)


def test_windows_cover_items():
    assert decontaminate.windows(5) == [(0, 5)] and decontaminate.windows(32) == [(0, 32)]
    assert decontaminate.windows(60) == [(0, 32), (16, 48), (28, 60)]


def test_words_and_answers():
    assert decontaminate.words("The CAT, sat&&& on...") == [b"the", b"cat", b"sat", b"on"]
    assert decontaminate.answer("What is it? A cat.\nThe dog.") == [b"the", b"dog"] and decontaminate.answer("...") == []


def test_whole_items_and_paraphrases_are_found(spark):
    rng = random.Random(8)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgk" for b in ("an", "el", "or", "ut") for c in ("ta", "mi", "so", "ne", "ru")]

    def text(n):
        return [rng.choice(vocabulary) + rng.choice(["", "x", "y", "z", "q"]) for _ in range(n)]
    items = [(i, " ".join(text(n))) for i, n in enumerate([15, 20, 31, 33, 48, 60, 90])]
    rows = [(i, " ".join(text(rng.randrange(1, 400)))) for i in range(150)]
    truth = set()
    for k in range(42):
        own = items[k % len(items)][1].split()
        if k % 3 == 1:  # every ninth word replaced
            own = [w if i % 9 else "changed" for i, w in enumerate(own)]
        rows.append((1000 + k, " ".join(text(k * 7) + [w.upper() + "," if k % 2 else w for w in own] + text(40))))
        truth.add((1000 + k, items[k % len(items)][0]))
    docs = documents(spark, rows + [(2000, None), (2001, ""), (None, items[2][1]), (1000, rows[150][1])])
    bench = spark.createDataFrame(items + [(50, None), (51, "..."), (2, items[2][1])], "item_id long, text string")
    found = decontaminate.leaks(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == truth | {(None, 2)}
    assert len(found) == len(truth) + 1
    clean = decontaminate.clean(docs, bench)
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == set(range(150)) | {2000, 2001}
    assert decontaminate.leaks(docs.limit(0), bench).count() == 0
    assert decontaminate.clean(docs, bench.limit(0)).count() == docs.count()


def test_recall_on_the_given_tables(spark, folder):
    docs, bench = table(spark, folder, "documents"), table(spark, folder, "benchmark")

    def plain(text):
        return b" " + b" ".join(decontaminate.words(text or "")) + b" "
    items = [(r["item_id"], plain(r["text"])) for r in bench.collect()]
    truth = {(r["doc_id"], i) for r in docs.collect() for i, item in items if item in plain(r["text"])}
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()}
    assert truth <= found and len(found - truth) <= 0.1 * len(truth) + 1


def test_gram_product_equals_dense_algebra(spark):
    rng = np.random.default_rng(1)
    idf = np.append(0, rng.random(20)).astype(np.float32)
    texts = [rng.integers(0, 21, n).astype(np.int32) for n in (0, 5, 16, 40, 100)]
    rows = spark.createDataFrame([(bytes(t.tobytes()), 2.0) for t in texts], "ids binary, weight double")
    right = rng.standard_normal((21, 4))
    dense = np.zeros((21, 21))
    for t in texts:
        if len(t):
            blocks = [np.bincount(t[i:i + 16], minlength=21) * idf for i in range(0, len(t), 16)]
            for p in ([blocks[i] + blocks[i + 1] for i in range(len(blocks) - 1)] if len(blocks) > 1 else blocks):
                if np.linalg.norm(p):
                    p = p / np.linalg.norm(p)
                    dense += 2 * np.outer(p, p)
    assert np.allclose(decontaminate.gram_product(rows, idf, right), dense @ right, atol=1e-4)


def dense_gram(texts, idf):
    out = np.zeros((len(idf), len(idf)))
    for t in texts:
        blocks = [np.bincount(t[i:i + 16], minlength=len(idf)) * idf for i in range(0, len(t), 16)]
        for p in ([a + b for a, b in zip(blocks, blocks[1:])] if len(blocks) > 1 else blocks):
            if np.linalg.norm(p):
                out += np.outer(p, p) / (p @ p)
    return out


def test_gram_matrix_equals_dense_algebra(spark, monkeypatch):
    rng = np.random.default_rng(4)
    idf = np.append(0, rng.random(20)).astype(np.float32)
    texts = [rng.integers(0, 21, n).astype(np.int32) for n in (0, 5, 16, 17, 40, 100, 333)]
    rows = spark.createDataFrame([(bytes(t.tobytes()), 2.0) for t in texts], "ids binary, weight double")
    dense = 2 * dense_gram(texts, idf)
    assert np.allclose(decontaminate.gram_matrix(rows, idf), dense, atol=1e-4)
    right = rng.standard_normal((21, 4))
    for part in (1, 3):  # parts of long texts have the same passages
        monkeypatch.setattr(decontaminate, "PART", part)
        entries = [*decontaminate.passage_entries(texts, [2.0] * len(texts), idf)]
        found = np.zeros((21, 21))
        for passage, term, value in entries:
            rows_here = np.zeros((passage.max() + 1, 21))
            rows_here[passage, term] = value
            found += rows_here.T @ rows_here
        assert np.allclose(found, dense, atol=1e-4)
    assert np.allclose(decontaminate.gram_product(rows, idf, right), dense @ right, atol=1e-3)


def test_what_tasks_are_sent_holds_no_sums(spark, monkeypatch):
    """2000 terms have 2 million pairs, 8 MB; what is sent for them is their number."""
    texts, sent = [[1, 2, 3], [3, 2000]], []
    rows = spark.createDataFrame([(np.array(t, np.int32).tobytes(), 1.0) for t in texts], "ids binary, weight double").coalesce(1)
    summed = decontaminate._summed
    monkeypatch.setattr(decontaminate, "_summed", lambda rows, total, *a: sent.append(len(cloudpickle.dumps(total))) or summed(rows, total, *a))
    idf = np.ones(2001, np.float32)
    gram = decontaminate.gram_matrix(rows, idf)
    assert sent and max(sent) < 100_000
    assert np.allclose(gram[:5, :5], dense_gram(texts, idf)[:5, :5], atol=1e-4)


def test_the_basis_is_that_of_all_documents(spark, monkeypatch):
    rng = np.random.default_rng(6)
    index = decontaminate.Index([(1, "a b c d e f g h"), (2, "i j k l m n o p q r")])
    texts = [rng.integers(0, len(index.idf), rng.integers(1, 40)).astype(np.int32) for _ in range(9000)]
    index.idf[1:] = 1 + rng.random(len(index.idf) - 1)
    docs = spark.createDataFrame([(i, bytes(t.tobytes())) for i, t in enumerate(texts)], "doc_id long, ids binary").repartition(5)
    own = [np.array(index.items[i][a:b]) for i, a, b in index.spans]
    gram = dense_gram(texts, index.idf) + len(texts) / len(own) * dense_gram(own, index.idf)
    for limit in (6000, 3):
        monkeypatch.setattr(decontaminate, "GRAM_TERMS", limit, raising=False)
        basis = decontaminate.latent_basis(docs, index, len(texts))
        assert np.allclose(basis.T @ gram @ basis, np.eye(basis.shape[1]), atol=1e-4)


def test_short_texts_are_projected_together_and_long_ones_in_parts(monkeypatch):
    rng = np.random.default_rng(9)
    vocabulary = [f"w{i}" for i in range(60)]
    index = decontaminate.Index([(i, " ".join(rng.choice(vocabulary, n))) for i, n in enumerate([4, 12, 40, 70])])
    terms = len(index.idf)
    index.weigh(np.append(0, rng.integers(1, 9, terms - 1)), 400)
    index.project(np.linalg.qr(rng.standard_normal((terms, terms)))[0])
    texts = [np.where(rng.random(n) < 0.5, rng.integers(0, terms, n), 0).astype(np.int32) for n in [0, 1, 16, 17, 33, 900] + [20] * 200]
    texts[5][100:140] = index.items[2]
    want = []
    for t in texts:  # one text and one passage at a time
        found = {}
        last = max(1, -(-len(t) // 16) - 1) if len(t) else 0
        for p in range(last):
            v = index.vectors[t[p * 16:p * 16 + 32]].sum(0)
            for (item, a, _), c in zip(index.spans, index.queries.T @ v / max(1e-12, np.linalg.norm(v))):
                if c >= decontaminate.COSINE:
                    found[item, p * 16 - a] = max(found.get((item, p * 16 - a), 0), c)
        want.append(found)
    calls, sums = [], decontaminate.block_sums
    monkeypatch.setattr(decontaminate, "block_sums", lambda *a: calls.append(1) or sums(*a))
    for blocks in (1, 3, 512):
        monkeypatch.setattr(decontaminate, "BLOCKS", blocks, raising=False)
        calls.clear()
        got = index.candidates(texts)
        assert [set(g) for g in got] == [set(w) for w in want] and sum(map(len, want)) > 20
        assert all(abs(g[k] - w[k]) < 1e-5 for g, w in zip(got, want) for k in w)
    assert len(calls) == 1
    assert any(m[0] == 2 for m in index.matches(texts)[5]) and index.matches([]) == [] and index.matches(texts[:1]) == [[]]
