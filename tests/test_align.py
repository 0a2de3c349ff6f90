from prefmill.operators import align as A
from prefmill.plans.align_queries import OPENAI
from prefmill.sources.registry import DatasetSpec, check_stage, resolve

import pytest


def pairs(messages):
    return [(m.role, m.content) for m in messages]


def test_alpaca_row(spark):
    df = spark.createDataFrame([("Solve the math problem.", "3 + 4", "The answer is 7.")], "instruction string, input string, output string")
    row = A.align(df, DatasetSpec("t")).first()
    assert pairs(row._prompt) == [("user", "Solve the math problem.\n3 + 4")]
    assert pairs(row._response) == [("assistant", "The answer is 7.")]
    assert (row._system, row._tools, row._images, row._videos, row._audios) == ("", "", None, None, None)


def test_alpaca_response_rules(spark):
    df = spark.createDataFrame([(1, "q", "a", None, None, True), (2, "q", "a", None, None, False), (3, "q", "a", "c", "r", None),
                                (4, "q", "a", "c", None, None), (5, "q", None, None, None, None)],
                               "id int, instruction string, output string, chosen string, rejected string, tag boolean")
    spec = DatasetSpec("t", query=None, ranking=True, chosen="chosen", rejected="rejected", kto_tag="tag")
    got = {r.id: [c for _, c in pairs(r._response)] for r in A.align(df, spec, ["id"]).collect()}
    assert got == {1: ["a", ""], 2: ["", "a"], 3: ["c", "r"], 4: ["a"], 5: []}


CHAT = "id int, conversations array<struct<from:string,value:string>>"


def test_sharegpt_rows(spark):
    good = [("system", "You are a helpful assistant."), ("human", "Solve the math problem.\n3 + 4"), ("gpt", "The answer is 7.")]
    df = spark.createDataFrame([(1, good), (2, good[1:2]), (3, [good[2], good[1]]), (4, []), (5, [("human", "a"), ("who", "b")])], CHAT)
    rows = {r.id: r for r in A.align(df, DatasetSpec("t", formatting="sharegpt"), ["id"]).collect()}
    assert rows[1]._system == "You are a helpful assistant."
    assert pairs(rows[1]._prompt) == [("user", good[1][1])] and pairs(rows[1]._response) == [("assistant", good[2][1])]
    assert all(rows[i]._prompt == [] and rows[i]._response == [] for i in (2, 3, 4, 5))


def test_sharegpt_pairs(spark):
    df = spark.createDataFrame([([("human", "q")], ("gpt", "good"), ("gpt", "bad"))],
                               "conversations array<struct<from:string,value:string>>, chosen struct<from:string,value:string>, rejected struct<from:string,value:string>")
    row = A.align(df, DatasetSpec("t", formatting="sharegpt", ranking=True, chosen="chosen", rejected="rejected")).first()
    assert pairs(row._prompt) == [("user", "q")] and pairs(row._response) == [("assistant", "good"), ("assistant", "bad")]


OPEN = "messages array<struct<role:string,content:string,tool_calls:array<struct<function:struct<name:string,arguments:string>>>>>, tools string"


def test_openai_tool_results(spark):
    call = [(("f", '{"a": 1}'),)]
    body = [("user", "q", []), ("assistant", "", call), ("tool", "r1", []), ("tool", "r2", []), ("assistant", "done", [])]
    df = spark.createDataFrame([(body, "[]"), (body + [("tool", "late", [])], "")], OPEN)
    first, second = A.align(df, OPENAI).collect()
    assert pairs(first._prompt) == [("user", "q"), ("function", '[{"name": "f", "arguments": "{\\"a\\": 1}"}]'),
                                    ("observation", "r1\n</tool_response>\n<tool_response>\nr2")]
    assert pairs(first._response) == [("assistant", "done")]
    assert (first._system, second._system) == ("", "detailed thinking off")
    assert pairs(second._prompt) == pairs(first._prompt)  # results at the very end are not closed


def test_v1_sharegpt(spark):
    df = spark.createDataFrame([([("system", "System"), ("human", "User"), ("function_call", "1"), ("observation", "Observation"),
                                  ("gpt", "Assistant"), ("odd", "x"), ("function_call", "{bad")],)], "conversations array<struct<from:string,value:string>>")
    messages = A.align_v1_sharegpt(df).first().messages
    assert [(m.role, m.content[0].type, m.content[0].value, m.loss_weight) for m in messages] == [
        ("system", "text", "System", 0.0), ("user", "text", "User", 0.0), ("assistant", "tool_call", "1", 1.0),
        ("tool", "text", "Observation", 0.0), ("assistant", "text", "Assistant", 1.0)]


def test_registry_blocks():
    registry = {"a": {"file_name": "a.json", "columns": {"prompt": "text"}}, "b": {"hf_hub_url": "x", "file_name": "b.json", "ranking": True, "tags": {"role_tag": "role"}}}
    a, b = resolve(["a", "b"], registry)
    assert (a.prompt, a.query, a.response, a.messages, a.role_tag) == ("text", None, None, None, "from")
    assert (b.load_from, b.location, b.role_tag, b.user_tag, b.prompt) == ("hub", "x", "role", None, "instruction")
    with pytest.raises(ValueError):
        resolve(["c"], registry)
    with pytest.raises(ValueError):
        check_stage(b, "sft")


def test_aligner_names_are_unique():
    with pytest.raises(ValueError):
        A.register_aligner("alpaca")(lambda df, spec, keep: df)


def test_stages_share_one_alignment(spark, folder):
    from prefmill.plans import catalog
    plan = catalog.QUERIES["drop_invalid"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "content" not in plan
