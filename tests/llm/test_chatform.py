import hashlib
import random

import oracle
import pytest

from prefmill.llm import chatform
from prefmill.llm.queries import ORACLES, QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, mask string"
PARTS = ["###", "#", "### user: ", "</turn>", "</turn>\n", "<next>", "<", "\\", "\\h", "\\l", "\\b", "\n", "é", "😀", "a", " ", ": "]


def rows_of(rows):
    return [(*r, "x", "y") for r in rows]


def brute(rows):
    """Turns in order and digests, from the rows alone."""
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", (r[3] or ""))):
        out.setdefault(conv, []).append((role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    learnt = {c: "".join(t for r, t in turns if r == "assistant") for c, turns in out.items()}
    return {c: (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learnt[c]), sha(learnt[c])) for c, turns in out.items()}


def test_control_strings_come_back(spark):
    rng = random.Random(13)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "a: ", "### x", "<\\b", None]), rng.choice([None, "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 9)))]))
            for c in range(60) for t in range(rng.randint(1, 9))]
    rows += rows[:5] + [(None, 0, "user", "x"), (None, None, "assistant", "y")]
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in
           chatform.digests(spark.createDataFrame(rows_of(rows), SCHEMA)).collect()}
    assert got == brute(rows)


def test_blocks_marks_and_mask(spark):
    rows = [(1, 2, "assistant", "no ### <next>"), (1, 0, "user", "a"), (1, 1, "user", "b"), (1, 3, "assistant", "ok")]
    out = chatform.formatted(spark.createDataFrame(rows_of(rows), SCHEMA)).first()
    assert out["formatted"] == "### user: a<next>b</turn>\n### assistant: no \\h## \\lnext><next>ok</turn>\n"
    at, learnt = 0, []
    for skip, take in out["mask"]:
        learnt.append(out["formatted"][at + skip:at + skip + take])
        at += skip + take
    assert "".join(learnt) == "no \\h## \\lnext>ok"


def test_a_wrong_mask_is_an_error(spark):
    out = chatform.formatted(spark.createDataFrame(rows_of([(1, 0, "assistant", "abc")]), SCHEMA))
    bad = out.selectExpr("conv_id", "formatted", "transform(mask, m -> named_struct('skip', m.skip, 'take', m.take - 1)) AS mask")
    with pytest.raises(Exception, match="does not meet"):
        chatform.read(bad).collect()


def test_long_conversation_and_empty_table(spark):
    rows = [(5, t, "assistant" if t % 3 else "user", "w" * (t % 50)) for t in range(20_000)]
    df = spark.createDataFrame(rows_of(rows), SCHEMA)
    out = chatform.digests(df).first()
    assert tuple(out)[1:5] == brute(rows)[5]
    assert chatform.digests(df.limit(0)).count() == 0
    assert [r["conv_id"] for r in chatform.digests(chatform.with_probe(df.limit(0))).collect()] == [-7]


def test_query_matches_sql_and_probe(spark, folder):
    assert oracle.compare(spark, oracle.connect(folder), QUERIES["op13_chatform"], ORACLES["op13_chatform"], folder) is None
    text = "\\### Assistant: </turn> ok"
    probe = [r for r in QUERIES["op13_chatform"](spark, folder).collect() if r["conv_id"] == -7][0]
    assert (probe["n_turns"], probe["loss_chars"]) == (2, 26) and probe["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()
