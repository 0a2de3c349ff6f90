"""A limit that stops a stream does so before anything is written."""

import hashlib

import pytest
from pyspark.sql import functions as F

from prefmill.session import entries, scratch_path
from prefmill.streaming import jobs as J


def test_batcher_limit_leaves_no_rows(spark):
    path = scratch_path(spark, "limit")
    spark.range(5).select("id", F.lit("a").alias("s"), F.lit(10).alias("n")).coalesce(1).write.json(path)
    table, checkpoint = J.folders(spark, "limit")
    with pytest.raises(Exception, match="more than 20"):
        J.stream_batcher(J.open_stream(spark, path, "id long, s string, n long"), "id", "s", 16, table, checkpoint, "n", 20)
    assert entries(spark, f"{table}/rows") == [] and entries(spark, f"{table}/counts") == []


def test_moments_go_on_after_a_stop(spark):
    """A second run on the same checkpoint ends in what one pass over all rows gives; a micro-batch writes the keys it
    touches alone."""
    path = scratch_path(spark, "scores")
    table, checkpoint = J.folders(spark, "moments")
    rows = [(i % 3, float(i * i % 23)) for i in range(300)]
    later = [(1, float(i % 7)) for i in range(50)] + [(9, 4.0)]

    def run(new):
        spark.createDataFrame(new, "run long, x double").coalesce(1).write.mode("append").json(path)
        stream = J.open_stream(spark, path, "run long, x double")
        return {r.run: r for r in J.stream_running_moments(stream, "run", "x", table, checkpoint).collect()}

    assert {k: r.n for k, r in run(rows).items()} == {0: 100, 1: 100, 2: 100}
    got = run(later)
    for key in (0, 1, 2, 9):
        xs = [x for k, x in rows + later if k == key]
        mean = sum(xs) / len(xs)
        assert got[key].n == len(xs) and got[key].mean == pytest.approx(mean)
        assert got[key].m2 == pytest.approx(sum((x - mean) ** 2 for x in xs))
    assert {r.run for r in spark.read.parquet(table).filter("v = 1").collect()} == {1, 9}


def buffered(spark, path, table, checkpoint, new, places):
    """Rows by pos after ``new`` has come, one file and micro-batch for each list."""
    for rows in new:
        spark.createDataFrame(rows, "id long, t string, xs array<double>").coalesce(1).write.mode("append").json(path, ignoreNullFields=False)
    stream = J.open_stream(spark, path, "id long, t string, xs array<double>")
    return sorted(J.shuffle_buffer(stream, "id", table, checkpoint, places, seed=3).collect(), key=lambda r: r.pos)


def test_shuffle_buffer_lives_across_batches(spark):
    """Every row once, with its columns; the order crosses the border of micro-batches; a stop in between changes nothing;
    the order is that of a plain buffer."""
    first = [(i, f"a{i}" if i % 7 else None, [i / 3, None]) for i in range(120)] + [(None, "null key", None)]
    second = [(i, f"b\n{i}", []) for i in range(1000, 1120)]
    path, (table, checkpoint) = scratch_path(spark, "rows"), J.folders(spark, "buffer")
    held = buffered(spark, path, table, checkpoint, [first], 32)
    assert sorted(map(str, (r.id for r in held))) == sorted(str(r[0]) for r in first) and [r.pos for r in held] == list(range(121))
    got = buffered(spark, path, table, checkpoint, [second], 32)
    assert sorted(((r.id, r.t, r.xs) for r in got), key=str) == sorted(first + second, key=str)
    ids = [r.id for r in got]
    mixed = [i for i in ids if i is None or i < 1000]
    assert ids != mixed + [i for i in ids if i is not None and i >= 1000] and mixed != sorted(mixed, key=lambda i: i or 0)

    def draw(part, i, digits):
        return int(hashlib.md5(":".join(["3", part] + ([] if i is None else [str(i)])).encode()).hexdigest()[:digits], 16)

    places, left = {}, []
    for rows in (first, second):
        for i in sorted((r[0] for r in rows), key=lambda i: draw("turn", i, 15)):
            place = draw("place", i, 8) % 32
            if place in places:
                left.append(places[place])
            places[place] = i
    assert ids == left + sorted(places.values(), key=lambda i: draw("turn", i, 15))


def test_shuffle_buffer_edges(spark):
    """No rows; fewer rows than places; rows that are equal."""
    path, (table, checkpoint) = scratch_path(spark, "rows"), J.folders(spark, "buffer")
    assert buffered(spark, path, table, checkpoint, [[]], 8) == []
    same = [(5, "x", [1.5])] * 20
    assert [(r.id, r.t, r.xs, r.pos) for r in buffered(spark, path, table, checkpoint, [same], 8)] == [(*same[0], p) for p in range(20)]


def test_monitor_goes_on_after_a_stop(spark):
    """Steps that come late take their place; a second run ends in what one pass gives, over several levels of blocks; a
    micro-batch writes the blocks it touches alone."""
    path, (table, checkpoint) = scratch_path(spark, "log"), J.folders(spark, "monitor")
    rows = [(1 if i % 4 else 2, i, None if i % 11 == 0 else float(i * i % 29)) for i in range(200)]
    parts = [[r for r in rows if r[1] % 3], [r for r in rows if r[1] % 3 == 0] + [(3, 7, None)]]
    schema = "run long, current_steps long, loss double, total_steps long, lr double, total_tokens long"
    for part in parts:
        spark.createDataFrame(part, "run long, current_steps long, loss double").coalesce(1).write.mode("append").json(path)
        got = {r.run: r for r in J.stream_log_monitor(J.open_stream(spark, path, schema), table, checkpoint, 0.8, 4).collect()}
    for run in (1, 2):
        xs = [x for r, _, x in rows if r == run and x is not None]
        s = xs[0]
        for x in xs:
            s = 0.8 * s + 0.2 * x
        assert got[run].smoothed == pytest.approx(s) and got[run].loss == xs[-1]
        assert got[run].current_steps == max(i for r, i, _ in rows if r == run)
    assert (got[3].current_steps, got[3].loss, got[3].smoothed) == (7, None, None)
    spark.createDataFrame([(2, 196, 1.0)], "run long, current_steps long, loss double").coalesce(1).write.mode("append").json(path)
    J.stream_log_monitor(J.open_stream(spark, path, schema), table, checkpoint, 0.8, 4)
    assert [(r.run, r["at"]) for r in spark.read.parquet(table).filter("v = 2").collect()] == [(2, 49)]
