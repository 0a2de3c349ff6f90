"""Calls written with keywords, against Python's own parser."""

import ast
import json

from pyspark.sql import functions as F

from prefmill.operators import tools as T

SOUND = ['f()', 'f(a=1)', '[f(a="x")]', "[f(a='it\\'s', b=\"say \\\"hi\\\"\"), g(c=[1, 2.5, -3], d={'k': None, \"l\": [True, False]})]",
         '[ f ( a = "b=c, d(e)" , b = true ) , ]', 'f(a="tab\\tline\\nback\\\\slash \\d \\x41\\u00e9", b=null)', 'f(a="[](){},:=", b="")',
         '[f(a=1,), g(b=[1, 2,],)]', 'f(a="ä 漢 😀")', "f(a='\"', b='#')", 'f(a=1e5)', "f(a=[[], {}, [[1]]])", "_f2(a_1=0)"]
BROKEN = ['', 'f', 'f(1, a=2)', 'f(', 'f(a=1', 'f(a=1))', '[f(a=1)', 'f(a=1]', 'f(a={)}', 'f(a=1}}', 'f(a==1)', 'f(a=b)', 'f(a=g(b=1))', '[f(), 3]', '[]',
          'f(), g()', 'a.f(b=1)', 'f(a="x)', 'f(a="x\ny")', '[{"name": "f", "arguments": [{}]}]', 'f(**k)', 'f(a=2x)', 'f(a=01)', 'f(a=1 b=2)',
          '{"a": 1}', 'f(a=[g()])', 'f(a=1)(b=2)']


def parsed(code):
    """[(name, arguments)] or None; calls with positional arguments are none."""
    words = {"true": True, "false": False, "null": None}
    try:
        body = ast.parse(code.strip(), mode="eval").body
        nodes = body.elts if isinstance(body, ast.List) else [body]
        out = []
        for node in nodes:
            if not isinstance(node, ast.Call) or not isinstance(node.func, ast.Name) or node.args:
                return None
            out.append((node.func.id, {k.arg: words[k.value.id] if isinstance(k.value, ast.Name) else ast.literal_eval(k.value) for k in node.keywords}))
    except (SyntaxError, ValueError, KeyError):
        return None
    return out or None


def test_keyword_calls(spark):
    codes = [(i, c) for i, c in enumerate(SOUND + BROKEN)]
    df = spark.createDataFrame([(i, f"First. <|tool_call_start|>{c}<|tool_call_end|> <|tool_call_start|>z()<|tool_call_end|>") for i, c in codes], "id int, t string")
    got = {r.id: r.c for r in df.select("id", T.extract_calls(F.col("t"), "lfm2").alias("c")).collect()}
    for i, code in codes:
        calls = None if got[i] is None else [(c.name, json.loads(c.arguments)) for c in got[i]]
        assert calls == parsed(code), code
        assert (calls is None) == (code in BROKEN), code


def test_no_marks_or_repeated_keywords_no_calls(spark):
    df = spark.createDataFrame([("f(a=1)",), ("<|tool_call_start|>f(a=1, a=2)<|tool_call_end|>",), ("<|tool_call_start|>f(a=1)",), ("<|tool_call_end|>f()<|tool_call_start|>",), ("",), (None,)], "t string")
    assert all(r.c is None for r in df.select(T.extract_calls(F.col("t"), "lfm2").alias("c")).collect())


def test_by_column_and_rejects(spark):
    rows = [(1, "lfm2", '<|tool_call_start|>[f(a=1), g(b="x, y")]<|tool_call_end|>'), (2, "lfm2", "f(a=1)"),
            (3, "qwen", '<tool_call>\n{"name": "f", "arguments": {"a": 1}}\n</tool_call>')]
    calls, rejects = T.calls_table(spark.createDataFrame(rows, "id int, fmt string, t string"), "t", F.col("fmt"), ["id"])
    assert sorted(map(tuple, calls.collect())) == [(1, 0, "f", '{"a": 1}'), (1, 1, "g", '{"b": "x, y"}'), (3, 0, "f", '{"a": 1}')]
    assert [r.id for r in rejects.collect()] == [2]
