import random
import re

import numpy as np
from helpers import documents
from pyspark.sql import functions as F

from prefmill.llm import graph, superminhash
from prefmill.llm.base import table
from prefmill.llm.graph import beside, components
from prefmill.llm.shingles import SEGMENT, shingle_set, word_lists, words


def brute(rows, k, percent):
    """component of each row, by all pairs of full sets."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group(0).lower(), text or ""))
        sets.append({tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return [(d, len(sets[i]), low[find(i)], low[find(i)] == d) for i, (d, _) in enumerate(rows)]


def family(rng, n, words_each, changes):
    base = [f"w{rng.randrange(500)}" for _ in range(words_each)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randrange(changes + 1)):
            copy[rng.randrange(len(copy))] = f"v{rng.randrange(500)}"
        out.append(" ".join(copy))
    return out


def test_groups_equal_all_pairs(spark):
    rng = random.Random(4)
    texts = [t for n, w, c in [(60, 80, 12), (25, 40, 3), (30, 6, 1), (10, 2, 0), (40, 150, 25)] for t in family(rng, n, w, c)]
    texts += ["", None, "  \n", "one", "ONE", "One two", "one two", "Äpfel", "äpfel"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    for k, percent in ((3, 85), (5, 80)):
        got = superminhash.grouped(documents(spark, rows), k, percent).select("doc_id", "n_shingles", "component_id", "kept")
        assert sorted(map(tuple, got.collect())) == sorted(brute(rows, k, percent))


def test_blocks_change_nothing(spark, monkeypatch):
    rng = random.Random(9)
    rows = list(enumerate(family(rng, 80, 60, 10)))
    monkeypatch.setattr(superminhash, "BAND_BLOCK", 7)
    monkeypatch.setattr(superminhash, "SET_BLOCK", 500)
    got = superminhash.grouped(documents(spark, rows), 3, 85).select("doc_id", "n_shingles", "component_id", "kept")
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows, 3, 85))


def test_given_table(spark, folder):
    docs = table(spark, folder, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = superminhash.grouped(docs, 3, 85).select("doc_id", "n_shingles", "component_id", "kept")
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows, 3, 85))


def test_rows_that_stay(spark):
    text, near = "a b c d e f g h", "A B C D E F G H"
    docs = documents(spark, [(5, text), (2, text), (2, text), (2, near), (2, "other words here and there now"), (7, None),
                             (8, ""), (None, text), (None, None), (None, "lonely words of nobody here at all")])
    kept = superminhash.deduplicated(docs)
    assert kept.columns == docs.columns
    got = [(r["doc_id"], (r["text"] or "").lower()) for r in kept.collect()]
    assert sorted(got, key=repr) == sorted([(2, text), (2, "other words here and there now"), (7, ""), (8, ""), (None, ""),
                                            (None, "lonely words of nobody here at all")], key=repr)
    assert superminhash.grouped(docs.limit(0)).count() == 0 and superminhash.deduplicated(docs.limit(0)).count() == 0


def test_signature_estimates_and_long_texts():
    rng = np.random.default_rng(2)
    found = []
    for _ in range(100):
        a = np.unique(rng.integers(0, 1 << 62, 90).astype(np.uint64))
        b = np.unique(np.concatenate([a[10:], rng.integers(0, 1 << 62, 10).astype(np.uint64)]))
        s = superminhash.signatures([a, b], 96)
        found.append((s[0] == s[1]).mean())
    assert abs(np.mean(found) - 80 / 100) < 0.02
    one = superminhash.signatures([np.array([7], np.uint64)], 96)
    assert one.max() < 96 << 24 and len(np.unique(one >> 24)) == 96  # a single element fills every place
    data = b"ab cd " * (SEGMENT // 4) + b"x" * (2 * SEGMENT) + b" ab"
    hashes, offsets = words(data)
    assert len(hashes) == len(data.split()) and hashes[0] == hashes[-1] and data[offsets[-1]:] == b"ab"
    assert [len(w) for w in word_lists([b"", b"a B", b" "])] == [0, 2, 0]
    assert len(shingle_set(word_lists([b"a a a a"])[0], 3)) == 1


def test_components(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(path, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hubs_are_split(spark, monkeypatch):
    monkeypatch.setattr(graph, "HOT_ROWS", 3)
    monkeypatch.setattr(graph, "HOT_KEYS", 10)
    stars = [(100, i) for i in range(40)] + [(i, 200) for i in range(150, 190)] + [(300, 301), (301, 302)] + [(39, 150)]
    got = dict(map(tuple, components(spark.createDataFrame(stars, "a long, b long")).collect()))
    assert {n for n, r in got.items() if r == 0} == {*range(40), 100, *range(150, 190), 200}
    assert {n for n, r in got.items() if r == 300} == {300, 301, 302} and len(got) == 85


def test_rows_beside_their_group(spark, monkeypatch):
    monkeypatch.setattr(graph, "HOT_ROWS", 3)
    monkeypatch.setattr(graph, "HOT_KEYS", 10)
    rows = [(1, i) for i in range(50)] + [(2, 7), (2, 7), (3, 9), (None, 5)]
    got = beside(spark.createDataFrame(rows, "k int, v int"), "k", F.min("v").alias("low"), F.count("v").alias("n"))
    want = [(1, i, 0, 50) for i in range(50)] + [(2, 7, 7, 2)] * 2 + [(3, 9, 9, 1)]
    assert got.columns == ["k", "v", "low", "n"] and sorted(map(tuple, got.collect())) == want


def test_rounds_leave_few_files_however_many_partitions_a_shuffle_has(spark, monkeypatch):
    files, held = [], {}
    for key, value in {"spark.sql.shuffle.partitions": "48", "spark.sql.adaptive.coalescePartitions.enabled": "false"}.items():
        held[key] = spark.conf.get(key)
        spark.conf.set(key, value)

    def counted(df, settle=graph.settled):
        out = settle(df)
        files.append(len(out.inputFiles()))
        return out
    monkeypatch.setattr(graph, "settled", counted)
    try:
        got = dict(map(tuple, components(spark.createDataFrame([(2 * i, 2 * i + 1) for i in range(1000)], "a long, b long")).collect()))
    finally:
        for key, value in held.items():
            spark.conf.set(key, value)
    assert got == {i: i - i % 2 for i in range(2000)}
    assert len(files) == 5 and max(files) <= 4 * spark.sparkContext.defaultParallelism  # stars at once: one round is enough
