import random

import pytest
from pyspark.sql import functions as F

from prefmill.functions.hashing import uniform
from prefmill.operators import joins as J, mixing as M, sampling as S

SIZES = {0: 50, 1: 17, 2: 3}


def members(spark):
    return spark.createDataFrame([(d, d * 1000 + i) for d, n in SIZES.items() for i in range(n)], "ds int, id long")


def listed(df):
    rows = sorted((r.pos, r.ds, r.id) for r in df.select("pos", "ds", "id").collect())
    assert [r[0] for r in rows] == list(range(len(rows)))
    return [(d, i) for _, d, i in rows]


def simulate(picks, stop):
    """Draw members one by one, as a loop over positions."""
    at, done, out = dict.fromkeys(SIZES, 0), dict.fromkeys(SIZES, False), []
    for d in picks:
        if stop == "once":
            if not done[d]:
                out.append((d, d * 1000 + at[d]))
                at[d] += 1
                done[d] = at[d] == SIZES[d]
            if all(done.values()):
                break
            continue
        if (any if stop == "under" else all)(done.values()):
            break
        out.append((d, d * 1000 + at[d]))
        at[d] += 1
        if at[d] == SIZES[d]:
            done[d], at[d] = True, 0
    return out


@pytest.mark.parametrize("stop", ["under", "over", "once"])
def test_probabilities(spark, stop):
    probs = {0: 0.2, 1: 0.3, 2: 0.5}
    us = [r.u for r in spark.range(20000).select(uniform(4, F.lit("pos"), F.col("id")).alias("u")).collect()]
    picks = [0 if u < 0.2 else 1 if u < 0.5 else 2 for u in us]
    assert listed(M.mix(members(spark), f"interleave_{stop}", probs, seed=4)) == simulate(picks, stop)


def test_round_robin(spark):
    df = members(spark)
    under = listed(M.mix(df, "interleave_under"))
    assert under == [(d, d * 1000 + i) for i in range(3) for d in SIZES]
    over = listed(M.mix(df, "interleave_over"))
    assert over == [(d, d * 1000 + i % SIZES[d]) for i in range(50) for d in SIZES]
    once = listed(M.mix(df, "interleave_once"))
    assert once == [(d, d * 1000 + i) for i in range(50) for d in SIZES if i < SIZES[d]]
    assert listed(M.mix(df, "concat")) == [(d, d * 1000 + i) for d, n in SIZES.items() for i in range(n)]


def test_tiny_member_is_expanded_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(M, "CHUNK", 4)
    assert listed(M.mix(members(spark), "interleave_over")) == [(d, d * 1000 + i % SIZES[d]) for i in range(50) for d in SIZES]
    probs = {0: 0.2, 1: 0.3, 2: 0.5}
    small = listed(M.mix(members(spark), "interleave_over", probs, seed=4))
    monkeypatch.setattr(M, "CHUNK", 4096)
    assert small == listed(M.mix(members(spark), "interleave_over", probs, seed=4))


def test_sampling(spark):
    df = spark.range(20).toDF("id")
    rows = S.sample_num(df, "id", 50, seed=1).collect()
    assert sorted(r.draw for r in rows) == list(range(50))
    assert sorted(r.id for r in rows if r.draw < 20) == list(range(20))
    fewer = [r.id for r in S.sample_num(df, "id", 7, seed=1).collect()]
    assert len(set(fewer)) == 7
    assert S.sample_weighted(df, "id", 10, 2.5).count() == 25
    assert S.sample_max(df, "id", 500).count() == 20


def test_limits(spark):
    df = spark.range(300).toDF("id").repartition(7)
    assert sorted(r.id for r in S.first_n(df, "id", 120).collect()) == list(range(120))
    assert sorted(r.id for r in S.skip_n(df, "id", 120).collect()) == list(range(120, 300))


@pytest.mark.parametrize("cut", [(None, None, 1), (3, 15, 4), (-5, None, 1), (None, None, -3), (15, 2, -4), (5, 5, 1)])
def test_slices(spark, cut):
    got = [r.id for r in S.select_slice(spark.range(20).toDF("id"), "id", *cut).orderBy("out").collect()]
    assert got == list(range(20))[slice(*cut)]


def test_split(spark):
    df = spark.range(101).toDF("id")
    held = M.split(df, "id", 0.1, seed=2).filter("split = 'validation'").count()
    assert held == 11 and M.split(df, "id", 30, seed=2).filter("split = 'validation'").count() == 30
    with pytest.raises(ValueError):
        M.split_named(df, {"a": df}, 0.1)


def test_copies_change_nothing(spark, monkeypatch):
    """Rows that are used often are copied; results stay the same."""
    df, few = members(spark), spark.range(3).toDF("id")
    def results():
        return (listed(M.mix(df, "interleave_over")), listed(M.mix(df, "interleave_over", {0: 0.2, 1: 0.3, 2: 0.5}, seed=4)),
                sorted((r.draw, r.id) for r in S.sample_num(few, "id", 200, seed=1).collect()),
                sorted((r.idx, r.id) for r in S.sample_weighted(few, "id", 50, 3.0, seed=1).collect()))
    before = results()
    monkeypatch.setattr(J, "PER_COPY", 2)
    assert results() == before and len(before[2]) == 200 and len(before[3]) == 150
