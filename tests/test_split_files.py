"""Large JSON arrays read by many tasks."""

import json
import random

import pytest
from pyspark.sql import functions as F

from prefmill.sources import files


def odd_rows(seed, size):
    rng = random.Random(seed)
    parts = ["}", "{", "[", "]", '"', "\\", "\\\"", "a", "é😀", "\n", ",", " ", "}]}", "\\\\"]
    return [{"id": i, "text": "".join(rng.choice(parts) for _ in range(rng.randint(0, 20))), "n": rng.choice([None, 1.5, -2]),
             "deep": {"list": [{"k": "}" * rng.randint(0, 3)} for _ in range(rng.randint(0, 3))], "none": {}}} for i in range(size)]


@pytest.mark.parametrize("indent, block", [(None, "3k"), (2, "7k"), (None, "64m"), (1, "501b")])
def test_array_equals_whole_file_read(spark, tmp_path, indent, block):
    rows = odd_rows(indent or 0, 300)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps(rows, indent=indent))
    (tmp_path / "in" / "b.json").write_text(" \n[ " + ",".join(json.dumps(r, ensure_ascii=False) for r in rows[:7]) + "]\n\n")
    path = str(tmp_path / "in")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum") if spark.conf.get(k, None)}
    whole = spark.read.json(path, multiLine=True)
    want = sorted(r["j"] for r in whole.select(F.to_json(F.struct("*")).alias("j")).collect())
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        tasks = spark.read.option("lineSep", "}").text(path).rdd.getNumPartitions()
        got = files.read_array(spark, path, whole.schema)
        assert sorted(r["j"] for r in got.select(F.to_json(F.struct("*")).alias("j")).collect()) == want
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert block == "64m" or tasks > 8
    values = [json.loads(r["value"]) for r in files.array_records(spark, path).collect()]
    assert sorted(v["id"] for v in values) == sorted([*range(300), *range(7)]) and all(v == rows[v["id"]] for v in values)


def test_small_limit_takes_the_split_way(spark, tmp_path, monkeypatch):
    (tmp_path / "x.json").write_text(json.dumps([{"a": i, "b": "}"} for i in range(50)]))
    before = sorted(map(tuple, files.read_files(spark, str(tmp_path / "x.json")).collect()))
    monkeypatch.setattr(files, "SPLIT_BYTES", 1)
    assert sorted(map(tuple, files.read_files(spark, str(tmp_path / "x.json")).collect())) == before and len(before) == 50
    (tmp_path / "e.json").write_text("[]")
    assert files.array_records(spark, str(tmp_path / "e.json")).count() == 0


def test_streams_cannot_be_sampled(spark, tmp_path):
    spec = {"path": str(tmp_path), "streaming": True, "schema": "a long"}
    with pytest.raises(ValueError, match="no size to sample"):
        files.read_set(spark, {"x": dict(spec, weight=0.5), "y": spec})
