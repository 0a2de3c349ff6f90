import json

import pytest
from pyspark.sql import functions as F, types as T

from prefmill import api
from prefmill.operators import media as M
from prefmill.session import scratch_path
from prefmill.sources import files as FS
from prefmill.sources.registry import DatasetSpec
from prefmill.streaming import jobs as J


def test_kinds(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.json").write_text(json.dumps([{"id": 1, "t": "a"}, {"id": 2, "t": "b\nc"}], indent=1))
    assert sorted((r.id, r.t) for r in FS.read_files(spark, str(tmp_path / "a")).collect()) == [(1, "a"), (2, "b\nc")]
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.jsonl").write_text('{"id": 1}\n\n{"id": 2}\n')
    assert FS.read_files(spark, str(tmp_path / "b")).count() == 2
    (tmp_path / "b" / "y.csv").write_text("id\n1\n")
    with pytest.raises(ValueError, match="identical"):
        FS.file_kind(spark, str(tmp_path / "b"))
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "x.doc").write_text("?")
    with pytest.raises(ValueError, match="allowed"):
        FS.file_kind(spark, str(tmp_path / "c"))
    with pytest.raises(ValueError, match="not found"):
        FS.file_kind(spark, str(tmp_path / "none"))


def test_load_spec(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text("\n".join(json.dumps({"id": i, "instruction": str(i)}) for i in range(10)))
    spec = DatasetSpec("d", location="d.jsonl", num_samples=15)
    assert api.load(spark, spec, str(tmp_path), key="id").count() == 15
    assert api.load(spark, DatasetSpec("d", location="d.jsonl"), str(tmp_path), key="id", max_samples=4).count() == 4
    with pytest.raises(ValueError):
        api.load(spark, DatasetSpec("d", load_from="hub"), str(tmp_path))


def test_media(spark):
    listing = spark.createDataFrame([("m/a.png",)], "path string")
    df = spark.createDataFrame([(1, ["a.png", "b.png"]), (2, ["a.png"] * 40)], "id long, images array<string>")
    got = {r.id: (r.images, r.missing) for r in M.media_resolve(df, "id", "images", listing, "m").collect()}
    assert got == {1: (["m/a.png", "b.png"], 1), 2: (["m/a.png"] * 40, 0)}
    frames = spark.createDataFrame([(1, [["a.png", "b.png"], ["a.png"]])], "id long, videos array<array<string>>")
    row = M.media_resolve(frames, "id", "videos", listing, "m").first()
    assert (row.videos, row.missing) == ([["m/a.png", "b.png"], ["m/a.png"]], 1)
    plan = spark.createDataFrame([(0, 10.0), (100, 2.0), (5, 0.1)], "n int, d double").select(M.video_frame_plan(F.col("n"), F.col("d"), 2.0, 4).alias("f"))
    assert [r.f for r in plan.collect()] == [[0, 1, 2, 3], [0, 33, 66, 99], [0]]


def test_media_rules(spark):
    df = spark.createDataFrame([([("user", "<image> and <image>"), ("assistant", "<image>!")], [2, 1, 3])], "m array<struct<role:string,content:string>>, n array<int>")
    row = df.select(*[F.transform(M.expand_by_rule(F.col("m"), F.col("n"), r), lambda m: m["content"]).alias(r) for r in ("llava", "qwen2_vl")]).first()
    s, p, e = "<|vision_start|>", "<|image_pad|>", "<|vision_end|>"
    assert row.llava == ["<image><image> and <image><image>", "<image><image>!"]
    assert row.qwen2_vl == [f"{s}{p}{p}{e} and {s}{p}{e}", f"{s}{p}{p}{p}{e}!"]
    with pytest.raises(ValueError):
        M.register_media_rule("llava", M.MEDIA_RULES["llava"])


def test_hot_run_in_stream_state(spark):
    """A run with most of the rows, spread over several micro-batches, ends in the state a single pass gives."""
    path = scratch_path(spark, "hot")
    rows = [(1 if i % 3 else 2, i, float(i % 17)) for i in range(900)]
    for part in range(3):
        spark.createDataFrame(rows[part * 300:(part + 1) * 300], "run long, current_steps long, loss double").coalesce(1).write.mode("append").json(path)
    schema = "run long, current_steps long, loss double, total_steps long, lr double, total_tokens long"
    out = {r.run: r for r in J.stream_log_monitor(J.open_stream(spark, path, schema), *J.folders(spark, "hot")).collect()}
    for run in (1, 2):
        xs = [x for r, _, x in rows if r == run]
        s = xs[0]
        for x in xs:
            s = 0.9 * s + 0.1 * x
        assert out[run].smoothed == pytest.approx(s) and out[run].current_steps == max(i for r, i, _ in rows if r == run)


def test_batcher_limit(spark):
    path = scratch_path(spark, "limit")
    spark.range(5).select("id", F.lit("a").alias("s"), F.lit(10).alias("n")).coalesce(1).write.json(path)
    table, checkpoint = J.folders(spark, "limit")
    with pytest.raises(Exception, match="more than 20"):
        J.stream_batcher(J.open_stream(spark, path, "id long, s string, n long"), "id", "s", 16, table, checkpoint, "n", 20)


def test_api_chain(spark):
    df = spark.createDataFrame([(i, f"question {i}", "", "answer " * (i % 5 + 1)) for i in range(30)], "id long, instruction string, input string, output string")
    aligned = api.align(df, DatasetSpec("d"), ["id"])
    encoded = api.encode(aligned, "sft", "chatml", "id", cutoff=128)
    packed = api.pack(encoded, "id", 256, neat=True)
    assert all(len(r.input_ids) == len(r.labels) == len(r.attention_mask) == 256 for r in packed.collect())
    assert api.encode(aligned, "ppo", "chatml", "id").count() == 30
    assert api.encode(aligned, "pt", "default", "id").count() == 30
    assert api.pad(encoded, "id", 8).count() == 30


def test_tolerant_schema(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n{"a": }\n\n')
    good, bad = FS.read_jsonl_tolerant(spark, str(tmp_path / "x.jsonl"), T.StructType([T.StructField("a", T.LongType())]))
    assert [r.a for r in good.collect()] == [1] and [r.line for r in bad.collect()] == ['{"a": }']
