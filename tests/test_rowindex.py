import random

import pytest
from pyspark.sql import functions as F

from prefmill.operators.rowindex import bucketed_index, ordered_index, shuffled_index
from prefmill.operators.series import running_sums


def skewed(spark, n=3000):
    """A third of the rows in one group."""
    rng = random.Random(3)
    rows = [("hot" if i % 3 == 0 else f"g{rng.randrange(20)}", i * 7 % 100003, float(i)) for i in range(n)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "g string, k long, x double")


@pytest.mark.parametrize("partitions", [1, 4, 17])
def test_ordered_index(spark, partitions):
    rows, df = skewed(spark)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {(r.g, r.k): (r.idx, r.n) for r in ordered_index(df, ["k"], ["g"], total="n").collect()}
        flat = {r.k: r.idx for r in ordered_index(df.select("k"), ["k"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    groups = {}
    for g, k, _ in rows:
        groups.setdefault(g, []).append(k)
    assert got == {(g, k): (i, len(ks)) for g, ks in groups.items() for i, k in enumerate(sorted(ks))}
    assert flat == {k: i for i, k in enumerate(sorted(k for _, k, _ in rows))}


def test_shuffled_index_is_a_permutation_and_stable(spark):
    _, df = skewed(spark)
    a = {r.k: r.idx for r in shuffled_index(df.select("k"), ["k"], 5, buckets=3).collect()}
    b = {r.k: r.idx for r in shuffled_index(df.repartition(13).select("k"), ["k"], 5, buckets=50).collect()}
    assert a == b and sorted(a.values()) == list(range(3000))
    assert a != {r.k: r.idx for r in shuffled_index(df.select("k"), ["k"], 6).collect()}


def test_bucketed_index_and_running_sums(spark):
    df = spark.range(5000).select("id", (F.col("id") % 7).alias("g"))
    got = {r.id: r.idx for r in bucketed_index(df, F.floor(F.col("id") / 100), ["id"], ["g"]).collect()}
    assert got == {i: i // 7 for i in range(5000)}
    sums = {r.id: r.id_sum for r in running_sums(spark.range(5000).toDF("id"), [], "id", ["id"]).collect()}
    assert sums[4999] == sum(range(5000)) and sums[0] == 0 and sums[2000] == sum(range(2001))


TIED = [(1, "a"), (1, "b"), (2, "c"), (None, "d"), (2, "c")]


def tied(spark):
    return spark.createDataFrame(TIED, "k long, text string")


def test_equal_and_null_keys_keep_every_row(spark):
    rows = ordered_index(tied(spark), ["k"], total="n").orderBy("idx").collect()
    assert [r.idx for r in rows] == list(range(5)) and [r.k for r in rows] == [None, 1, 1, 2, 2] and {r.n for r in rows} == {5}
    assert sorted(r.text for r in rows) == ["a", "b", "c", "c", "d"]
    grouped = ordered_index(tied(spark), ["text"], ["k"]).collect()
    assert sorted((r.k or 0, r.idx) for r in grouped) == [(0, 0), (1, 0), (1, 1), (2, 0), (2, 1)]
    mixed = shuffled_index(tied(spark), ["k"], 3, total="n").collect()
    assert sorted(r.idx for r in mixed) == list(range(5)) and sorted(r.text for r in mixed) == ["a", "b", "c", "c", "d"]


def test_operators_on_tied_keys(spark):
    from prefmill.operators import mixing, packing, sampling
    df = tied(spark)
    for count in range(7):
        assert sorted(((r.k or 0) for r in sampling.first_n(df, "k", count).collect())) == [0, 1, 1, 2, 2][:count]
        assert sampling.skip_n(df, "k", count).count() == max(0, 5 - count)
    assert sampling.sample_max(df, "k", 4).count() == 4
    assert sampling.sample_num(df, "k", 3, seed=1).count() == 3 and sampling.sample_num(df, "k", 12, seed=1).count() == 12
    assert sampling.sample_weighted(df, "k", 4, 2.0, seed=1).count() == 8
    assert sorted(r.idx for r in packing.batched(df, "k", 2).collect()) == list(range(5))
    assert sorted(r.batch for r in packing.batched(df, "k", 2).collect()) == [0, 0, 1, 1, 2]
    parts = mixing.split(df, "k", 2.0).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in parts} == {"validation": 2, "train": 3}
    members = df.withColumnRenamed("k", "id").withColumn("ds", F.lit(0)).unionByName(
        spark.createDataFrame([(7, "x"), (7, "y"), (None, "z")], "id long, text string").withColumn("ds", F.lit(1)))
    for strategy, n in (("concat", 8), ("interleave_under", 6), ("interleave_over", 10), ("interleave_once", 8)):
        rows = mixing.mix(members, strategy).collect()
        assert sorted(r.pos for r in rows) == list(range(n)), strategy
    rows = mixing.mix(members, "interleave_once", {0: 0.5, 1: 0.5}, seed=2).collect()
    assert sorted(r.pos for r in rows) == list(range(8)) and sorted(r.text for r in rows) == sorted("abccdxyz")


def test_draws_reach_beyond_32_bits(spark):
    from prefmill.operators.sampling import draws
    size = 1 << 40
    seen = [r.idx for r in draws(spark, 400, size, 1).collect()]
    assert max(seen) > 1 << 39 and min(seen) < 1 << 38 and len(set(seen)) == 400


def test_null_answer_keeps_its_place(spark):
    from prefmill.operators.encode import kl_shift
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k long, x string")
    assert [r.kl_x for r in kl_shift(df, "k", ["x"]).orderBy("k").collect()] == ["c", "a", None]
