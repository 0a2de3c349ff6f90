"""Prefix sums over many levels, placeholder filling, hot keys, page lookup, run lengths, clipped n-grams."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from prefmill.operators import joins, media, ngrams, packing, sampling, series, subspace


def test_running_sums_climb_as_many_levels_as_needed(spark):
    rng = random.Random(1)
    rows = [(run, i, rng.randint(-9, 9)) for run, n in (("a", 400), ("b", 3), (None, 65), ("c", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "run string, i long, x long")
    got = {(r["run"], r["i"]): r["x_sum"] for r in series.running_sums(df, ["run"], "i", ["x"], block=4).collect()}
    sums = {}
    for run, i, x in rows:
        sums[run, i] = sums.get((run, i - 1), 0) + x
    assert got == sums
    whole = spark.range(1000).select(F.col("id").alias("i"), (F.col("id") % 7).alias("x"))
    out = series.running_sums(whole, [], "i", ["x"], block=10)
    assert {r["i"]: r["x_sum"] for r in out.collect()} == {i: sum(k % 7 for k in range(i + 1)) for i in range(1000)}
    assert series.running_sums(whole.limit(0), [], "i", ["x"]).count() == 0


def test_no_window_of_running_sums_holds_more_than_a_block(spark):
    df = spark.range(5000).select(F.col("id").alias("i"), F.lit(1).alias("x"))
    plan = series.running_sums(df, [], "i", ["x"], block=16)._jdf.queryExecution().optimizedPlan().toString()
    # levels of 5000, 313, 20 and 2 rows, each cut into blocks of 16
    assert plan.count("Window [") == 4
    assert sum(plan.count(f"windowspecdefinition(i{'_block' * n}#") for n in (1, 2, 3, 4)) == 4


def messages(spark, texts):
    df = spark.createDataFrame([([("user", t) for t in texts],)], "m array<struct<role:string,content:string>>")
    return df


def brute_fill(texts, shown):
    out, k = [], 0
    for t in texts:
        parts = t.split("<image>")
        text = parts[0]
        for p in parts[1:]:
            text += (shown[k] if k < len(shown) else "") + p
            k += 1
        out.append(text)
    return out


def test_placeholders_are_filled_in_order(spark):
    rng = random.Random(2)
    parts = ["<image>", "a", "\u0001", "\u00010", "\u00011", "<ima", "ge>", "é😀", "$1", "\\", ""]
    for _ in range(12):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(1, 5))]
        shown = [rng.choice(["X", "", "\u0001", "$0", "[s]**[e]"]) for _ in range(rng.randint(0, 6))]
        df = messages(spark, texts).withColumn("s", F.lit(shown).cast("array<string>") if shown else F.array().cast("array<string>"))
        got = df.select(media.media_fill(F.col("m"), F.col("s")).alias("m")).first()["m"]
        assert [r["content"] for r in got] == brute_fill(texts, shown)


def test_many_messages_and_odd_lists(spark):
    texts = ["<image>a"] * 20_000
    df = messages(spark, texts).withColumn("c", F.transform(F.sequence(F.lit(0), F.lit(19_999)), lambda i: i % 3))
    got = df.select(media.media_expand(F.col("m"), F.col("c"), "*", before="[", after="]").alias("m")).first()["m"]
    assert [r["content"] for r in got] == ["[" + "*" * (i % 3) + "]a" for i in range(20_000)]
    none = spark.createDataFrame([([],), ([("user", None), ("user", "<image>x")],)], "m array<struct<role:string,content:string>>")
    out = [[r["content"] for r in x["m"]] for x in none.select(media.media_expand(F.col("m"), F.array(F.lit(2)), "#").alias("m")).collect()]
    assert out == [[], [None, "##x"]]


def test_shapes_of_images(spark):
    df = spark.createDataFrame([(16, 16), (336, 336), (1000, 300), (300, 1000), (1, 999), (672, 672)], "w int, h int")

    def tiled(w, h):
        best = None
        for i, (tall, wide) in enumerate(media.TILINGS):
            scale = min(wide / w, tall / h)
            kept = min(int(w * scale) * int(h * scale), w * h)
            if best is None or (kept, kept - tall * wide) > best[:2]:
                best = (kept, kept - tall * wide, tall // 336 * 24, wide // 336 * 24)
        rows, columns = best[2:]
        if w / h > columns / rows:
            rows -= (rows - int(round(h * (columns / w), 7))) // 2 * 2
        else:
            columns -= (columns - int(round(w * (rows / h), 7))) // 2 * 2
        return rows * columns + rows + 576
    got = {(r["w"], r["h"]): r["t"] for r in df.select("w", "h", media.tiled_tokens(F.col("w"), F.col("h")).alias("t")).collect()}
    assert got == {k: tiled(*k) for k in got} and got[16, 16] == 1176
    grid = df.limit(1).select(media.grid_text(F.lit(32), F.lit(48), 16, "I", "/", ".").alias("g"), media.grid_text(F.lit(32), F.lit(9), 16, "I", "/", ".").alias("n")).first()
    assert tuple(grid) == ("II/II/II.", "")
    chat = messages(spark, ["<image>ab<image>", "c"])
    bare = chat.select(media.expand_by_rule(F.col("m"), F.array().cast("array<int>"), "paligemma").alias("m")).first()["m"]
    assert [r["content"] for r in bare] == ["ab", "c"]
    ids = spark.range(1).select(*media.media_prefix(F.array(F.lit(5)), F.array(F.lit(6)), F.lit(2), 2, 9)).first()
    assert [list(x) for x in ids] == [[9, 9, 9, 9, 5], [-100] * 4 + [6]]
    audio = messages(spark, ["hear <audio>"])
    assert audio.select(media.expand_by_rule(F.col("m"), F.array(F.lit(3)), "qwen2_audio").alias("m")).first()["m"][0]["content"] == \
        "hear <|audio_bos|><|AUDIO|><|AUDIO|><|AUDIO|><|audio_eos|>"


def test_a_hot_path_is_spread_and_found(spark):
    rows = 6000
    uses = spark.range(rows).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("p"), (F.col("id") % 500).cast("string"))).alias("k"))
    listed = uses.select("k").distinct().filter("k != 'p7'").withColumn("v", F.length("k"))
    before = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for c, v in zip(before, ("false", "-1")):
            spark.conf.set(c, v)
        out = joins.join_measured(uses, listed, ["k"], ["id"], per_copy=100)
        shares = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(shares) == rows and max(shares) < rows / 4  # unsplit, one of eight tasks would hold a third and its share
        assert {r["id"]: r["v"] for r in out.collect()} == {r["id"]: (None if r["k"] == "p7" else len(r["k"])) for r in uses.collect()}
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def test_paths_with_many_uses_and_none(spark):
    df = spark.createDataFrame([(i, ["a.png"] * (i % 3) + (["b.png"] if i % 5 == 0 else []) if i % 7 else None) for i in range(300)], "id long, images array<string>")
    out = media.media_resolve(df, "id", "images", spark.createDataFrame([("m/a.png",), ("m/a.png",)], "path string"), "m", per_copy=20)
    want = {r["id"]: [("m/" + p if p == "a.png" else p) for p in r["images"] or []] for r in df.collect()}
    got = {r["id"]: (list(r["images"]), r["missing"]) for r in out.collect()}
    assert got == {i: (p, p.count("b.png")) for i, p in want.items()}


@pytest.mark.parametrize("kind, values", [
    ("long", [None, None, -2**63, 2**63 - 1, 0, 0, 0, 5, 6, 7, 10**12]), ("int", list(range(40)) * 2), ("long", [3]), ("long", [None]),
    ("string", [None, "", "", "a", "ab", "abc", "abcdefgh", "abcdefgi", "bé", "b\U0001F600", "zz", "zz", "https://x/1", "https://x/2"])])
def test_pages_by_key_lookup(spark, kind, values):
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], f"k {kind}, row long")
    order = sorted(values, key=lambda v: (v is not None, v.encode() if isinstance(v, str) else v or 0))
    for position in sorted({-1, 0, 1, len(values) // 2, len(values) - 1, len(values)}):
        found = sampling.key_at(df, "k", position)
        assert found == ((order[position], order.index(order[position])) if 0 <= position < len(order) else None)
    rows = []
    for page in range(len(values) // 9 + 2):
        got = sampling.preview_page(df, "k", page, 9).orderBy("idx").collect()
        assert [r["idx"] for r in got] == list(range(page * 9, min(page * 9 + 9, len(values)))) and all(r["total"] == len(values) for r in got)
        rows += got
    assert [r["k"] for r in rows] == order and sorted(r["row"] for r in rows) == list(range(len(values)))


def test_pages_of_empty_tables_and_other_keys(spark):
    assert sampling.preview_page(spark.createDataFrame([], "k long"), "k", 0).count() == 0
    df = spark.createDataFrame([(0.5, 1), (0.25, 2), (None, 3)], "k double, row long")
    assert [r["row"] for r in sampling.preview_page(df, "k", 0, 2).orderBy("idx").collect()] == [3, 2]


def test_page_reads_only_its_keys(spark, folder):
    plan = sampling.preview_page(spark.read.parquet(f"{folder}/documents.parquet"), "doc_id", 3)
    assert plan.count() == 2
    bounds = spark.read.parquet(f"{folder}/documents.parquet").filter((F.col("doc_id") >= 6) & (F.col("doc_id") <= 7))
    assert "GreaterThanOrEqual(doc_id,6)" in bounds._jdf.queryExecution().executedPlan().toString()


def test_segment_lengths_in_one_pass(spark):
    masks = [[], [0, 0], [1, 1, 2, 3, 3, 3, 0], [3, 1, 1], [2] * 5, [1, 2, 1, 0, 2]]
    df = spark.createDataFrame([(m,) for m in masks], "m array<int>")
    got = [list(r["s"]) for r in df.select(packing.segment_lengths(F.col("m")).alias("s")).collect()]
    assert got == [[n for _, n in sorted(Counter(x for x in m if x > 0).items())] for m in masks]


def test_clipped_ngrams_equal_counting(spark):
    rng = random.Random(3)
    pairs = [("".join(rng.choice("ab01é😀 ") for _ in range(rng.randint(0, 15))), "".join(rng.choice("ab01é😀 ") for _ in range(rng.randint(0, 15)))) for _ in range(150)]
    pairs += [("", ""), ("", "a"), ("a", ""), ("abcd" * 500, "abce" * 500), ("\u0000\u0001", "\u0001\u0000")]
    df = spark.createDataFrame(pairs, "p string, t string")
    for (p, t), r in zip(pairs, df.select(ngrams.matches(F.col("p"), F.col("t")).alias("m")).collect()):
        def grams(x, n):
            return Counter(x[i:i + n] for i in range(len(x) - n + 1))
        assert list(r["m"]) == [(grams(p, n) & grams(t, n)).total() for n in (1, 2, 3, 4)], (p, t)


def test_basis_join_moves_no_basis(spark):
    basis = spark.createDataFrame([("a", 0, [1.0, 0.0]), ("a", 1, [0.0, 1.0])], "module string, row long, vec array<double>")
    vectors = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [1.0]), ("b", [1.0, 2.0]), (None, [1.0])], "module string, vec array<double>")
    out = subspace.join_module_basis(vectors, basis)
    assert sorted((str(r["module"]), len(r["vec"]), r["fits"]) for r in out.collect()) == [("None", 1, False), ("a", 1, False), ("a", 2, True), ("b", 2, False)]
    assert "basis" not in out.columns
