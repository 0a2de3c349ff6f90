import re
import random

import pytest
from pyspark.sql import functions as F

from prefmill.operators import encode as E, packing as P, tokens as TK


@pytest.mark.parametrize("source, target, cutoff, expected", [
    (3000, 2000, 1000, (600, 400)), (2000, 3000, 1000, (400, 600)), (1000, 100, 1000, (900, 100)), (100, 1000, 1000, (100, 900)),
    (100, 500, 1000, (100, 500)), (500, 100, 1000, (500, 100)), (10, 10, 1000, (10, 10))])
def test_lengths(spark, source, target, cutoff, expected):
    row = spark.range(1).select(E.infer_seqlen(F.lit(source), F.lit(target), cutoff).alias("k")).first().k
    assert tuple(row) == expected


TURNS = [([11, 12], [21, 22, 23]), ([13], [24])]
X = -100


@pytest.mark.parametrize("cutoff, options, ids, labels", [
    (99, {}, [11, 12, 21, 22, 23, 13, 24], [X, X, 21, 22, 23, X, 24]),
    (99, {"train_on_prompt": True}, [11, 12, 21, 22, 23, 13, 24], [11, 12, 21, 22, 23, 13, 24]),
    (99, {"mask_history": True}, [11, 12, 21, 22, 23, 13, 24], [X, X, X, X, X, X, 24]),
    (99, {"efficient_eos": True}, [11, 12, 21, 22, 23, 13, 24, 2], [X, X, 21, 22, 23, 2, 24, 2]),
    (4, {}, [11, 12, 21, 22], [X, X, 21, 22]),
    (4, {"mask_history": True}, [11, 21, 13, 24], [X, X, X, 24]),
    (6, {}, [11, 12, 21, 22, 23, 13], [X, X, 21, 22, 23, X]),
])
def test_sft_goldens(spark, cutoff, options, ids, labels):
    df = spark.createDataFrame([(TURNS,)], "turns array<struct<s:array<int>,t:array<int>>>")
    row = E.sft_arrays(df, "turns", cutoff, **options).first()
    assert (row.input_ids, row.labels) == (ids, labels)


@pytest.mark.parametrize("history", [False, True])
def test_sft_rules(spark, history):
    """Rows keep the turn order, take prefixes of prompts and answers, fill at most the budget, and mask by position."""
    rng = random.Random(9)
    rows = []
    for k in range(200):
        turns = [(rng.randrange(0, 12), rng.randrange(1, 12)) for _ in range(rng.randrange(1, 6))]
        rows.append((k, [([1000 * i + x for x in range(s)], [1000 * i + 500 + x for x in range(t)]) for i, (s, t) in enumerate(turns)]))
    df = spark.createDataFrame(rows, "k int, turns array<struct<s:array<int>,t:array<int>>>")
    got = {r.k: (r.input_ids, r.labels) for r in E.sft_arrays(df, "turns", 24, mask_history=history).collect()}
    for k, turns in rows:
        ids, labels = got[k]
        size = sum(len(s) + len(t) for s, t in turns)
        assert ids == sorted(ids) and len(ids) <= 24 and (size > 24 or len(ids) == size)
        for i, (s, t) in enumerate(turns):
            mine = [x for x in ids if x // 1000 == i]
            asked, answered = [x for x in mine if x % 1000 < 500], [x for x in mine if x % 1000 >= 500]
            assert asked == s[:len(asked)] and answered == t[:len(answered)]
        learned = [x for x in ids if x % 1000 >= 500 and (not history or x // 1000 == len(turns) - 1)]
        assert [x for x in labels if x != X] == learned and len(labels) == len(ids)


def test_knapsack(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(1, 120)) for i in range(700)]
    df = spark.createDataFrame(rows, "id long, length long")
    got = P.pack_knapsack(df, "id", 100, batch=200).collect()
    fits = {i for i, n in rows if n <= 100}
    assert {r.id for r in got} == fits and len(got) == len(fits)
    packs = {}
    for r in got:
        assert r.id // 200 == r.batch
        packs.setdefault((r.batch, r.pack), []).append((r.slot, r.length, r.id))
    for batch in range(4):
        left = [(n, i) for i, n in rows if i // 200 == batch and n <= 100]
        for pack in range(sum(1 for b, _ in packs if b == batch)):
            room, chosen = 100, []
            while [x for x in left if x[0] <= room]:
                best = max(x for x in left if x[0] <= room)  # longest first, then the latest row
                left.remove(best)
                chosen.append(best)
                room -= best[0]
            assert chosen == [(n, i) for _, n, i in sorted(packs[batch, pack])]


def test_blocks_drop_the_tail(spark):
    df = spark.createDataFrame([(i, list(range(i * 10, i * 10 + 7))) for i in range(5)], "id long, input_ids array<int>")
    got = {(r.batch, r.block): r.input_ids for r in P.pack_blocks(df, "id", 8, batch=3, bos=1).collect()}
    first = [x for i in range(3) for x in range(i * 10, i * 10 + 7)]
    last = [x for i in (3, 4) for x in range(i * 10, i * 10 + 7)]
    assert got == {(0, 0): [1] + first[1:8], (0, 1): [1] + first[9:16], (1, 0): [1] + last[1:8]}


MASKS = [(0, [1, 1, 2, 2, 2, 0]), (1, [1, 2, 2, 3, 3, 3])]


def test_segments(spark):
    df = spark.createDataFrame(MASKS, "row int, mask array<int>").withColumn("batch", F.lit(0))
    got = sorted((r.row, r.segment, r.length, r.start, r.longest) for r in P.seqlens(df, "batch", "row", "mask").collect())
    assert [g[2] for g in got] == [2, 3, 1, 2, 3] and [g[3] for g in got] == [0, 2, 5, 6, 8] and {g[4] for g in got} == {3}
    idx = df.orderBy("row").select(P.unmasked_indices(F.col("mask"), F.col("row")).alias("i"), P.attn_pairs(F.col("mask")).alias("n")).collect()
    assert idx[0].i + idx[1].i == [0, 1, 2, 3, 4, 6, 7, 8, 9, 10, 11] and [r.n for r in idx] == [9, 10]


def test_padding(spark):
    df = spark.createDataFrame([(0, [1, 2, 3, 4, 5, 6], [-100, 2, 3, 4, 5, 6]), (0, [7, 8], [7, 8])], "batch int, input_ids array<int>, labels array<int>")
    rows = sorted(P.pad_batch(df).collect(), key=lambda r: -sum(r.attention_mask))
    assert rows[0].input_ids == [1, 2, 3, 4, 5, 6, 0, 0] and rows[0].labels == [-100, 2, 3, 4, 5, 6, -100, -100]
    assert rows[1].attention_mask == [1, 1, 0, 0, 0, 0, 0, 0] and rows[1].labels == [7, 8] + [-100] * 6
    cut = sorted(r.input_ids for r in P.pad_truncate(df, 4).collect())
    assert cut == [[1, 2, 3, 4], [7, 8, 0, 0]]


def test_micro_batches(spark):
    rows = P.micro_batches(spark.range(100).toDF("id"), "id", 1, 4, 8).collect()
    steps = {}
    for r in rows:
        steps.setdefault(r.step, []).append((r.micro, r.slot))
    assert len(steps) == 100 // 8 and all(sorted(s) == [(m, i) for m in range(2) for i in range(4)] for s in steps.values())
    with pytest.raises(ValueError):
        P.micro_batches(spark.range(10).toDF("id"), "id", 3, 4, 8)


def test_vocabulary_paths_agree(spark, monkeypatch):
    df = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 37}" for j in range(1, 30)) + " rare" + "x" * 80) for i in range(40)] + [(99, " ")], "id long, text string")
    vocab = TK.vocab_build(df)
    ids = {r.token: r.id for r in vocab.collect()}
    assert [ids[t] for t in TK.SPECIALS] == [0, 1, 2, 3] and sorted(ids.values()) == list(range(len(ids)))
    def encoded():
        return {r.id: r.input_ids for r in TK.encode_tokens(df, vocab, "id").collect()}
    long_token = encoded()  # a token past HOT_CHARS takes the shuffle path
    monkeypatch.setattr(TK, "HOT", 5)
    assert encoded() == long_token == {r.id: [ids[w] for w in r.text.split()] for r in df.collect()}
    monkeypatch.setattr(TK, "HOT", 10**6)
    monkeypatch.setattr(TK, "HOT_CHARS", 1000)
    assert encoded() == long_token


TOOL = '[{"name":"measure","description":"Measures a thing","parameters":{"type":"object","properties":{"thing":{"type":"string"}},"required":["thing"]}}]'


def chats(spark, tools):
    message = "struct<role:string,content:string>"
    rows = [([("user", "how tall is it")], [("assistant", "two metres")], "", tools),
            ([("user", "and wide")], [("assistant", "one"), ("assistant", "nine")], "be brief", tools)]
    return spark.createDataFrame(rows, f"_prompt array<{message}>, _response array<{message}>, _system string, _tools string").withColumn("id", F.size("_response"))


def plain(ids):
    return "".join(chr(i - TK.SHIFT) for i in ids)


def test_every_encoder_tells_the_tools(spark):
    def texts(tools):
        rows = chats(spark, tools)
        sft = E.encode_sft(rows, "qwen", 5000, ["id"]).first()
        rm = E.encode_pairwise(rows, "qwen", 5000, ["id"]).first()
        ppo = E.encode_prompt_only(rows, "qwen", 5000, ["id"]).filter("id = 1").first()
        return plain(sft.input_ids), plain(rm.chosen_input_ids), plain(ppo.input_ids)
    for told, without, null in zip(texts(TOOL), texts(""), texts(None)):
        assert "measure" in told and "measure" not in without and len(told) > len(without) and null == without


def test_feedback_tells_the_tools(spark):
    rows = chats(spark, TOOL).filter("id = 1").withColumn("_response", F.array_append("_response", F.struct(F.lit("assistant").alias("role"), F.lit("").alias("content"))))
    row = E.encode_feedback(rows, "qwen", "id", 5000).first()
    assert "measure" in plain(row.input_ids) and "measure" in plain(row.kl_input_ids)


def test_marks_become_one_id(spark):
    marks = {"<|im_start|>": 900, "<|im_end|>": 901, "<|im_end|>x": 902}
    tokenize = TK.with_specials(TK.char_ids, marks)
    got = spark.createDataFrame([("a<|im_start|>b\n<|im_end|>x<|im_end|>",), ("",), ("<|im_", )], "t string").select(tokenize(F.col("t")).alias("i"))
    c = [ord(x) + TK.SHIFT for x in "ab\n"]
    assert [r.i for r in got.collect()] == [[c[0], 900, c[1], c[2], 902, 901], [], [ord(x) + TK.SHIFT for x in "<|im_"]]
    row = E.encode_sft(chats(spark, ""), "chatml", 5000, ["id"], tokenize).filter("id = 1").first()
    assert row.input_ids.count(900) >= 2 and row.input_ids.count(901) >= 2


def test_a_tokenizer_file_encodes_chats(spark):
    public = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    path = public.path("byte_bpe_50k.json")
    row = E.encode_sft(chats(spark, TOOL), "qwen", 5000, ["id"], TK.Subwords(path)).first()
    text = E.encode_sft(chats(spark, TOOL), "qwen", 5000, ["id"]).first()
    encoder = tokenizers.Tokenizer.from_file(path)
    cut = text.labels.index(next(x for x in text.labels if x != -100))
    want = [i for part in (plain(text.input_ids[:cut]), plain(text.input_ids[cut:])) for i in encoder.encode(part, add_special_tokens=False).ids]
    assert row.input_ids == want and row.labels.count(-100) == len(encoder.encode(plain(text.input_ids[:cut]), add_special_tokens=False).ids)


def test_more_text_is_regrouped_in_more_places(spark, monkeypatch):
    monkeypatch.setattr(TK, "PART_BYTES", 1000, raising=False)
    df = spark.createDataFrame([(i, f"w{i % 7} " * (i % 60)) for i in range(200)] + [(None, "w1 w2"), (3, "w5"), (500, None)], "id long, text string")
    out = TK.encode_tokens(df, TK.vocab_build(df), "id")
    places = int(re.search(r"hashpartitioning\(id#\d+L, (\d+)\)", out._jdf.queryExecution().executedPlan().toString())[1])
    assert places > int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = {r.id: r.input_ids for r in out.collect()}
    assert len(got[59]) == 59 and got[0] == [] and got[500] == [] and len(got[3]) == 4 and len(got[None]) == 2
