"""Losses, series, text overlap and subspaces against plain Python and numpy."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefmill.operators import losses as L, ngrams as N, series as S, subspace as U


def test_dpo_losses(spark):
    rng = random.Random(2)
    rows = [(i, *[-rng.random() * 900 for _ in range(4)]) for i in range(50)]
    df = spark.createDataFrame(rows, "example_id int, pc double, pr double, rc double, rr double")
    got = {r.example_id: r for r in df.select("example_id", L.loss_sigmoid(0.1).alias("s"), L.loss_hinge(0.1).alias("h")).collect()}
    for i, pc, pr, rc, rr in rows:
        x = 0.1 * ((pc - pr) - (rc - rr))
        assert got[i].s == pytest.approx(np.logaddexp(0, -x)) and got[i].h == pytest.approx(max(0, 1 - x))


def softmax(x):
    e = np.exp(x - x.max())
    return e / e.sum()


def test_token_losses(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {"dft": [], "kl": [], "eaft": [], "acc": []}
    for e in range(6):
        logits, ref = rng.normal(size=(5, 32)) * 3, rng.normal(size=(5, 32))
        labels = [int(x) for x in rng.integers(0, 32, 5)]
        labels[2] = -100
        hits = []
        for t in range(5):
            rows.append((e, t, labels[t], logits[t].tolist(), ref[t].tolist()))
            if t + 1 < 5 and labels[t + 1] != -100:
                p, q = softmax(logits[t]), softmax(ref[t])
                nll = -math.log(p[labels[t + 1]])
                top = softmax(np.sort(logits[t])[::-1][:20])
                want["dft"].append(nll * math.exp(-nll))
                want["kl"].append(float((q * (np.log(q) - np.log(p))).sum()))
                want["eaft"].append(nll * float(-(top * np.log(top)).sum()) / 3)
                hits.append(int(p.argmax() == labels[t + 1]))
        want["acc"].append(np.mean(hits))
    df = spark.createDataFrame(rows, "example_id int, pos int, label int, policy array<double>, ref array<double>")
    asft = L.loss_asft(df, 0.1).first()
    assert asft.dft == pytest.approx(np.mean(want["dft"])) and asft.kl == pytest.approx(np.mean(want["kl"]))
    assert L.loss_dft(df).first().loss == pytest.approx(np.mean(want["dft"]))
    assert L.loss_eaft(df).first().loss == pytest.approx(np.mean(want["eaft"]))
    assert L.token_accuracy(df).first().accuracy == pytest.approx(np.mean(want["acc"]))


def test_smoothing_over_many_blocks(spark):
    rng = random.Random(8)
    runs = {1: [rng.random() * 10 for _ in range(2600)], 2: [1.5], 3: [rng.random() for _ in range(40)]}
    df = spark.createDataFrame([(r, i * 3, x) for r, xs in runs.items() for i, x in enumerate(xs)], "run int, step long, loss double")
    got = {(r.run, r.step): r.smoothed for r in S.ema_smooth(df, ["run"], "step", "loss").collect()}
    for run, xs in runs.items():
        w, s = 1.8 * (1 / (1 + math.exp(-0.05 * len(xs))) - 0.5), xs[0]
        for i, x in enumerate(xs):
            s = s * w + (1 - w) * x
            assert got[run, i * 3] == pytest.approx(s, abs=1e-12)


def test_slow_decay_uses_long_blocks(spark):
    xs = [math.sin(i) for i in range(9000)]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(xs)], "g int, i long, x double")
    got = {r.i: r.s for r in S.decayed(df, ["g"], "i", "x", F.lit(0.99), F.lit(2.0), "s", 0.99).collect()}
    s = 2.0
    for i, x in enumerate(xs):
        s = 0.99 * s + 0.01 * x
        assert got[i] == pytest.approx(s, abs=1e-12)


def test_running_moments(spark):
    rng = random.Random(4)
    xs = [rng.gauss(100, 3) for _ in range(500)]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(xs)], "g int, i long, x double")
    got = S.running_moments(S.batch_moments(df, ["g"], "i", "x", 32), ["g"]).orderBy("batch").collect()
    mean, var, count = 0.0, 1.0, 0
    for r in got:
        part = np.array(xs[r.batch * 32:(r.batch + 1) * 32])
        n, delta = len(part), part.mean() - mean
        m2 = var * count + part.var(ddof=1) * n + delta ** 2 * count * n / (count + n)
        mean, count = mean + delta * n / (count + n), count + n
        var = m2 / count
        assert (r["count"], r["mean"], r["var"]) == (count, pytest.approx(mean), pytest.approx(var))


def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_common_subsequence():
    rng = random.Random(6)
    for _ in range(200):
        a, b = [[rng.choice("abcd") for _ in range(rng.randrange(0, 70))] for _ in range(2)]
        assert N.common_length(a, b) == lcs(a, b)


def test_text_scores(spark):
    df = spark.createDataFrame([(1, "the cat sat down", "the cat sat down"), (2, "a b c", "x y z"), (3, "", "x"), (4, "ab", "ab")], "id int, p string, l string")
    p, t = F.col("p"), F.col("l")
    got = {r.id: r for r in df.select("id", N.bleu4(p, t).alias("b"), N.rouge_n(p, t, 1).alias("r1"), N.rouge_n(p, t, 2).alias("r2"), N.rouge_l(p, t).alias("rl")).collect()}
    assert (got[1].b, got[1].r1, got[1].r2, got[1].rl) == (100.0, 100.0, 100.0, 100.0)
    assert (got[2].r1, got[2].rl) == (0.0, 0.0) and got[3].b == 0.0
    # "ab": p1 = p2 = 1, p3 -> 1/2, p4 -> 1/4
    assert got[4].b == pytest.approx(100 * (0.5 * 0.25) ** 0.25, abs=1e-3)


def test_clipped_gram_counts(spark):
    rng, rows = random.Random(1), []
    for i in range(300):
        signs = "ab 0\U0001F600é1\n"[:rng.randrange(1, 9)]
        rows.append((i, *["".join(rng.choice(signs) for _ in range(rng.randrange(0, 30))) for _ in range(2)]))
    rows.append((300, "a" * 50_000, "a" * 20_000 + "b"))
    found = spark.createDataFrame([*rows, (301, None, "a"), (302, "a", None)], "id int, p string, l string").select("id", N.matches(F.col("p"), F.col("l")).alias("m"))
    got = {r.id: r.m for r in found.collect()}
    for i, p, label in rows:
        grams = [[Counter(x[j:j + n] for j in range(len(x) - n + 1)) for x in (p, label)] for n in (1, 2, 3, 4)]
        assert got[i] == [sum((a & b).values()) for a, b in grams]


def test_grams_are_not_folded_one_by_one(spark):
    df = spark.createDataFrame([("a", "b")], "p string, l string").select(N.bleu4(F.col("p"), F.col("l")).alias("b"))
    assert "aggregate(" not in df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(7)
    data = {f"m{i}": rng.normal(size=(40 + i, 12)) for i in range(2)}
    rows = [(m, i, v.tolist()) for m, x in data.items() for i, v in enumerate(x)]
    return data, spark.createDataFrame(rows, "module string, row long, vec array<double>").repartition(5)


def test_nullspace_projector(vectors):
    data, df = vectors
    spectra = U.spectrum(U.gram(df)).collect()
    basis = U.nullspace_basis(df.sparkSession.createDataFrame(spectra)).collect()
    for m, x in data.items():
        u, s, _ = np.linalg.svd(x.T, full_matrices=False)
        assert np.allclose(sorted((r.sigma for r in spectra if r.module == m), reverse=True), s)
        keep = max(1, int(0.8 * len(s)))
        mine = np.array([r.vec for r in sorted((b for b in basis if b.module == m), key=lambda b: b.vec_no)])
        ref = u[:, len(s) - keep:]
        assert np.allclose(mine.T @ mine, ref @ ref.T, atol=1e-8)


def test_gram_in_two_levels(vectors, monkeypatch):
    data, df = vectors
    monkeypatch.setattr(U, "TREE_WIDTH", 2)
    got = {(r.module, r.row): r.vec for r in U.gram(df).collect()}
    assert all(np.allclose(got[m, i], (x.T @ x)[i]) for m, x in data.items() for i in range(12))


def test_projection_paths_agree(spark, vectors):
    data, df = vectors
    basis = U.nullspace_basis(U.spectrum(U.gram(df))).filter("module = 'm0'")
    near = {(r.module, r.row): r.projected for r in U.project_vectors(df, basis).collect()}
    far = {(r.module, r.row): r.projected for r in U.project_vectors(df, basis, limit=0).collect()}
    assert near.keys() == far.keys()
    for k in near:
        assert np.allclose(near[k], far[k], atol=1e-9)
    assert near["m1", 0] == data["m1"][0].tolist()


def test_lowrank_product(spark):
    rng = np.random.default_rng(3)
    a, b, t = rng.normal(size=(4, 30)), rng.normal(size=(50, 4)), rng.normal(size=(30, 4))
    def rows(m, x):
        return [(m, i, v.tolist()) for i, v in enumerate(x)]
    schema = "module string, row long, vec array<double>"
    left = spark.createDataFrame(rows("p", a) + rows("q", t), schema)
    right = spark.createDataFrame(rows("p", b) + rows("q", b), schema)
    got = {(r.module, r.row): r.vec for r in U.lowrank_product(left, right, block=8).collect()}
    for i in range(50):
        assert np.allclose(got["p", i], (b @ a)[i]) and np.allclose(got["q", i], (b @ t.T)[i])
