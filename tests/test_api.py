from pyspark.sql import functions as F

from prefmill import api
from prefmill.operators import losses


def test_every_name_exists():
    assert all(hasattr(api, name) for name in api.__all__)


def test_metrics_and_hooks(spark):
    rows = spark.createDataFrame([("a b c d e", "a b c d e"), ("", "x")], "predict string, label string")
    out = api.evaluate(rows).orderBy(F.desc("predict")).collect()
    assert out[0]["rouge-l"] == out[0]["rouge-1"] == 100.0 and out[1]["rouge-1"] == 0.0
    own = api.evaluate(rows, metrics={"same": lambda p, r: p == r}).collect()
    assert sorted(r.same for r in own) == [False, True]


def test_reward_hook(spark):
    pairs = spark.createDataFrame([(1.0, 2.0, 0.5, 0.5)], "pc double, pr double, rc double, rr double")
    row = api.rewards(pairs, 2.0, wrap=lambda reward, side: reward - (1 if side == "rejected" else 0)).first()
    assert (row.chosen_reward, row.rejected_reward) == (1.0, 2.0)


def test_table_losses(spark):
    logits = spark.createDataFrame([(1, 0, -100, [0.0, 1.0]), (1, 1, 1, [0.0, 0.0])], "example_id int, pos int, label int, policy array<double>")
    assert api.table_losses(logits, "dft").first().loss == losses.loss_dft(logits).first().loss > 0
    added = api.with_supervised_term(spark.createDataFrame([(1.0, -2.0)], "loss double, avg double"), F.col("avg"), 0.5).first()
    assert added.loss == 2.0
