"""Tool catalogues, tool calls as text, and extraction of calls from generated text, per call syntax."""

from pyspark.sql import Column, Window, functions as F

from prefmill.functions.jsontext import field, is_json, items, quoted, spaced
from prefmill.functions.numeric import let
from prefmill.functions.text import strip

CALLS = "array<struct<name:string,arguments:string>>"

# Instruction text around the tool descriptions, as (before, after).
TOOL_PROMPTS = {
    "default": (
        "You have access to the following tools:\n",
        "Use the following format if using a tool:\n```\nAction: tool name (one of [@names@])\n"
        "Action Input: the input to the tool, in a JSON format representing the kwargs "
        '(e.g. ```{"input": "hello world", "num_beams": 5}```)\n```\n'),
    "glm4": (
        "你是一个名为 ChatGLM 的人工智能助手。你是基于智谱 AI 公司训练的语言模型 GLM-4 模型开发的，"
        "你的任务是针对用户的问题和要求提供适当的答复和支持。\n\n# 可用工具", ""),
    "glm4_moe": (
        "\n\n# Tools\n\nYou may call one or more functions to assist with the user query.\n\n"
        "You are provided with function signatures within <tools></tools> XML tags:\n<tools>",
        "\n</tools>\n\nFor each function call, output the function name and arguments within the following XML format:"
        "\n<tool_call>{function-name}\n<arg_key>{arg-key-1}</arg_key>\n<arg_value>{arg-value-1}</arg_value>"
        "\n<arg_key>{arg-key-2}</arg_key>\n<arg_value>{arg-value-2}</arg_value>\n...\n</tool_call>\n"),
    "llama3": (
        "Cutting Knowledge Date: December 2023\nToday Date: @date@\n\n"
        "You have access to the following functions. To call a function, please respond with JSON for a function call. "
        'Respond in the format {"name": function name, "parameters": dictionary of argument name and its value}. '
        "Do not use variables.\n\n", ""),
    "minimax1": (
        "You are provided with these tools:\n<tools>\n",
        "</tools>\n\nIf you need to call tools, please respond with <tool_calls></tool_calls> XML tags, and provide "
        "tool-name and json-object of arguments, following the format below:\n<tool_calls>\n"
        '{"name": <tool-name-1>, "arguments": <args-json-object-1>}\n...\n</tool_calls>'),
    "minimax2": (
        "\n\n# Tools\n\nYou may call one or more tools to assist with the user query.\n"
        "Here are the tools available in JSONSchema format:\n\n<tools>\n",
        "</tools>\n\nWhen making tool calls, use XML format to invoke tools and pass parameters:\n"
        '\n<minimax:tool_call>\n<invoke name="tool-name-1">\n<parameter name="param-key-1">param-value-1</parameter>\n'
        '<parameter name="param-key-2">param-value-2</parameter>\n...\n</invoke>\n</minimax:tool_call>'),
    "mistral": ("[AVAILABLE_TOOLS] [", "][/AVAILABLE_TOOLS]"),
    "qwen": (
        "\n\n# Tools\n\nYou may call one or more functions to assist with the user query.\n\n"
        "You are provided with function signatures within <tools></tools> XML tags:\n<tools>",
        "\n</tools>\n\nFor each function call, return a json object with function name and arguments within "
        '<tool_call></tool_call> XML tags:\n<tool_call>\n{"name": <function-name>, "arguments": <args-json-object>}'
        "\n</tool_call>"),
    "qwen3_5": (
        "\n\n# Tools\n\nYou have access to the following functions:\n\n<tools>",
        "\n</tools>\n\nIf you choose to call a function ONLY reply in the following format with NO suffix:\n\n"
        "<tool_call>\n<function=example_function_name>\n<parameter=example_parameter_1>\nvalue_1\n</parameter>\n"
        "<parameter=example_parameter_2>\nThis is the value for the second parameter\nthat can span\nmultiple lines\n"
        "</parameter>\n</function>\n</tool_call>\n\n<IMPORTANT>\nReminder:\n"
        "- Function calls MUST follow the specified format: "
        "an inner <function=...></function> block must be nested within <tool_call></tool_call> XML tags\n"
        "- Required parameters MUST be specified\n"
        "- You may provide optional reasoning for your function call in natural language "
        "BEFORE the function call, but NOT after\n"
        "- If there is no function call available, answer the question like normal with your current knowledge "
        "and do not tell the user about function calls\n</IMPORTANT>"),
    "seed_oss": (
        "system\nYou are Doubao, a helpful AI assistant. You may call one or more functions to assist with the user "
        "query.Tool List:\nYou are authorized to use the following tools (described in JSON Schema format). Before "
        "performing any task, you must decide how to call them based on the descriptions and parameters of these "
        "tools.\n",
        "\n工具调用请遵循如下格式:\n<seed:tool_call>\n<function=example_function_name>\n"
        "<parameter=example_parameter_1>value_1</parameter>\n<parameter=example_parameter_2>This is the value for the "
        "second parameter\nthat can span\nmultiple lines</parameter>\n</function>\n</seed:tool_call>\n"),
    "ling": (
        "# Tools\n\nYou may call one or more functions to assist with the user query.\n\n"
        "You are provided with function signatures within <tools></tools> XML tags:\n<tools>",
        "\n</tools>\n\nFor each function call, return a json object with function name and arguments within "
        '<tool_call></tool_call> XML tags:\n<tool_call>\n{"name": <function-name>, "arguments": <args-json-object>}'
        "\n</tool_call>\ndetailed thinking off"),
    "lfm2": ("List of tools: <|tool_list_start|>[", "]<|tool_list_end|>"),
}
FORMATS = list(TOOL_PROMPTS)
THOUGHT = ("<think>\n", "\n</think>\n\n")
CALL_WORDS = ("<tool_call>", "</tool_call>")


def literal(text: str) -> str:
    """A regex that matches the text itself."""
    return r"\Q" + text + r"\E"


def indented(text: Column, width: int = 4) -> Column:
    """JSON laid out over lines, as a fold over its tokens with the nesting depth as state."""
    tokens = F.regexp_extract_all(text, F.lit(r'("[^"\\]*+(?:\\.[^"\\]*+)*+"|[{}\[\],:]|[^"\s,:{}\[\]]++)'), F.lit(1))

    def line(depth):
        return F.concat(F.lit("\n"), F.repeat(F.lit(" " * width), depth))

    def step(acc, t):
        opens, closes = t.isin("{", "["), t.isin("}", "]")
        lead = F.when(acc["fresh"] & ~closes & ~t.isin(",", ":"), line(acc["depth"])).otherwise("")
        body = (F.when(closes & ~acc["fresh"], F.concat(line(acc["depth"] - 1), t))
                .when(t == ",", F.concat(F.lit(","), line(acc["depth"]))).when(t == ":", ": ").otherwise(t))
        depth = acc["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        return F.struct(F.concat(acc["text"], lead, body).alias("text"), depth.alias("depth"), opens.alias("fresh"))

    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("depth"), F.lit(False).alias("fresh"))
    return F.aggregate(tokens, start, step, lambda acc: acc["text"])


def _bare(tool: Column) -> Column:
    return F.when(field(tool, "type") == "function", field(tool, "function")).otherwise(tool)


def _wrapped(tool: Column) -> Column:
    return F.when(field(tool, "type") == "function", spaced(tool)).otherwise(
        F.concat(F.lit('{"type": "function", "function": '), spaced(tool), F.lit("}")))


def _argument_line(tool: Column, entry: Column) -> Column:
    key, rule = entry["key"], entry["value"]
    required = F.array_contains(F.from_json(field(tool, "parameters.required"), "array<string>"), key)
    choices = F.from_json(field(rule, "enum"), "array<string>")
    each = field(rule, "items")
    return F.concat(
        F.lit("  - "), key, F.lit(" ("), F.coalesce(field(rule, "type"), F.lit("")),
        F.when(F.coalesce(required, F.lit(False)), ", required").otherwise(""), F.lit("): "),
        F.coalesce(field(rule, "description"), F.lit("")),
        F.when(F.size(choices) > 0, F.concat(F.lit(", should be one of ["), F.array_join(choices, ", "), F.lit("]"))).otherwise(""),
        F.when(each.isNotNull() & (each != "{}"), F.concat(F.lit(", where each item should be "),
                                                           F.coalesce(field(each, "type"), F.lit("")))).otherwise(""),
        F.lit("\n"))


def _described(tool: Column) -> Column:
    entries = F.map_entries(F.from_json(field(tool, "parameters.properties"), "map<string,string>"))
    return F.concat(F.lit("> Tool Name: "), field(tool, "name"), F.lit("\nTool Description: "),
                    F.coalesce(field(tool, "description"), F.lit("")), F.lit("\nTool Args:\n"),
                    F.array_join(F.transform(entries, lambda e: _argument_line(tool, e)), ""), F.lit("\n"))


def tool_prompt(tools: Column, fmt: str = "default", date: str = "") -> Column:
    """Text that tells a model which tools it has; ``tools`` is a JSON list. Empty for an empty list."""
    each = items(tools)
    bare = F.transform(each, _bare)

    def lines(array, build, sep=""):
        return F.array_join(F.transform(array, build), sep)

    body = {
        "default": lambda: lines(bare, _described),
        "glm4": lambda: lines(bare, lambda t: F.concat(F.lit("\n\n## "), field(t, "name"), F.lit("\n\n"), indented(t),
                                                       F.lit("\n在调用上述函数时，请使用 Json 格式表示调用的参数。"))),
        "llama3": lambda: lines(each, lambda t: F.concat(indented(_wrapped(t)), F.lit("\n\n"))),
        "minimax1": lambda: lines(bare, lambda t: F.concat(spaced(t), F.lit("\n"))),
        "minimax2": lambda: lines(bare, lambda t: F.concat(F.lit("<tool>"), spaced(t), F.lit("</tool>\n"))),
        "mistral": lambda: lines(each, _wrapped, ", "),
        "qwen3_5": lambda: lines(bare, lambda t: F.concat(F.lit("\n"), spaced(t))),
        "seed_oss": lambda: spaced(tools),
        "lfm2": lambda: lines(bare, spaced, ", "),
    }.get(fmt, lambda: lines(each, lambda t: F.concat(F.lit("\n"), _wrapped(t))))()
    before, after = TOOL_PROMPTS[fmt]
    after_text = F.lit(after)
    if "@names@" in after:
        left, right = after.split("@names@")
        after_text = F.concat(F.lit(left), lines(bare, lambda t: field(t, "name"), ", "), F.lit(right))
    text = F.concat(F.lit(before.replace("@date@", date)), body, after_text)
    return F.when(F.size(each) > 0, text).when(F.size(each) == 0, "")


# ---- calls as text --------------------------------------------------------------------------------------------------

def _argument_text(call: Column, name: str = "arguments") -> Column:
    """Value of a field as JSON text; a string value is written as a JSON string."""
    value = field(call, name)
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(call), f"$.{name}", "variant"))
    return F.when(kind == "STRING", quoted(value)).otherwise(spaced(value))


def parse_calls(text: Column) -> Column:
    """Calls from ``{"name", "arguments"}`` or a list of such objects; null when the JSON is broken."""
    calls = F.transform(items(text), lambda c: F.struct(field(c, "name").alias("name"), _argument_text(c).alias("arguments")))
    return F.when(is_json(text), calls).cast(CALLS)


def _arguments(call: Column) -> Column:
    """Array of (key, value as shown): strings bare, other values as JSON; the flag tells which."""
    raw = F.map_entries(F.from_json(call["arguments"], "map<string,string>"))
    typed = F.map_values(F.from_json(call["arguments"], "map<string,variant>"))
    return F.zip_with(raw, typed, lambda e, v: F.struct(
        e["key"].alias("key"), (F.schema_of_variant(v) == "STRING").alias("is_text"),
        F.when(F.schema_of_variant(v) == "STRING", e["value"]).otherwise(
            F.coalesce(spaced(e["value"]), F.lit("null"))).alias("value")))


def _each_argument(call: Column, before: str, middle: str, after: str) -> Column:
    return F.array_join(F.transform(_arguments(call), lambda a: F.concat(
        F.lit(before), a["key"], F.lit(middle), a["value"], F.lit(after))), "")


def _object(call: Column, name: str = "arguments") -> Column:
    return F.concat(F.lit('{"name": '), quoted(call["name"]), F.lit(f', "{name}": '), call["arguments"], F.lit("}"))


def format_calls(calls: Column, fmt: str = "default") -> Column:
    """Calls in one syntax. The glm4 syntax holds a single call; more than one gives null."""
    def lines(build, sep="\n"):
        return F.array_join(F.transform(calls, build), sep)

    if fmt == "default":
        return lines(lambda c: F.concat(F.lit("Action: "), c["name"], F.lit("\nAction Input: "), c["arguments"]))
    if fmt == "glm4":
        return F.when(F.size(calls) == 1, F.concat(calls[0]["name"], F.lit("\n"), calls[0]["arguments"]))
    if fmt == "llama3":
        objects = lines(lambda c: _object(c, "parameters"), ", ")
        return F.when(F.size(calls) == 1, objects).otherwise(F.concat(F.lit("["), objects, F.lit("]")))
    if fmt == "mistral":
        return F.concat(F.lit("["), lines(lambda c: _object(c), ", "), F.lit("]"))
    if fmt == "minimax1":
        return F.concat(F.lit("<tool_calls>\n"), lines(lambda c: _object(c)), F.lit("\n</tool_calls>"))
    if fmt == "minimax2":
        return lines(lambda c: F.concat(F.lit('<invoke name="'), c["name"], F.lit('">'), _each_argument(
            c, '\n<parameter name="', '">', "</parameter>"), F.lit("\n</invoke>")))
    if fmt in ("qwen", "ling"):
        return lines(lambda c: F.concat(F.lit("<tool_call>\n"), _object(c), F.lit("\n</tool_call>")))
    if fmt == "qwen3_5":
        return lines(lambda c: F.concat(F.lit("<tool_call>\n<function="), c["name"], F.lit(">"), _each_argument(
            c, "\n<parameter=", ">\n", "\n</parameter>"), F.lit("\n</function>\n</tool_call>")))
    if fmt == "glm4_moe":
        return lines(lambda c: F.concat(F.lit("\n<tool_call>"), c["name"], _each_argument(
            c, "\n<arg_key>", "</arg_key>\n<arg_value>", "</arg_value>")))
    if fmt == "seed_oss":
        return lines(lambda c: F.concat(F.lit("\n<seed:tool_call>\n<function="), c["name"], F.lit(">"), _each_argument(
            c, "\n<parameter=", ">", "</parameter>"), F.lit("\n</function>\n</seed:tool_call>")))
    if fmt == "lfm2":
        def call(c):
            shown = F.transform(_arguments(c), lambda a: F.concat(a["key"], F.lit("="), F.when(
                a["is_text"], F.concat(F.lit('"'), a["value"], F.lit('"'))).otherwise(a["value"])))
            return F.concat(c["name"], F.lit("("), F.array_join(shown, ", "), F.lit(")"))
        return F.concat(F.lit("<|tool_call_start|>["), lines(call, ", "), F.lit("]<|tool_call_end|>"))
    raise ValueError(f"unknown tool format {fmt}")


def between(text: Column, opening: Column, closing: Column) -> Column:
    """Struct (whole, inner) of the first stretch from ``opening`` to the next ``closing``; nulls without one."""
    start = F.position(opening, text)
    inner = start + F.length(opening)
    end = F.position(closing, text, inner)
    found = (start > 0) & (end > 0)
    return F.struct(F.when(found, text.substr(start, end + F.length(closing) - start)).alias("whole"),
                    F.when(found, text.substr(inner, end - inner)).alias("inner"))


def render_function(content: Column, fmt: str = "default", thought=THOUGHT, call_words=CALL_WORDS) -> Column:
    """A function message as text. Text before a tagged call, or a thought, stays in front of the calls. The words may
    be strings or columns."""
    def column(word):
        return F.lit(word) if isinstance(word, str) else word

    def text(z):
        tagged = z["call"]["whole"].isNotNull()
        whole = F.coalesce(z["call"]["whole"], z["thought"]["whole"])
        rest = F.when(whole.isNotNull(), F.replace(content, whole, F.lit(""))).otherwise(content)
        lead = F.when(tagged, rest).otherwise(F.coalesce(z["thought"]["whole"], F.lit("")))
        calls = parse_calls(F.when(tagged, z["call"]["inner"]).otherwise(rest))
        return F.concat(lead, let(calls, lambda c: format_calls(c, fmt)))

    found = F.struct(between(content, *map(column, call_words)).alias("call"), between(content, *map(column, thought)).alias("thought"))
    return let(found, text)


def by_format(fmt: Column, formats, build) -> Column:
    """build(name) for the syntax named in the row; null for a name that is not listed."""
    out = F.lit(None).cast("string")
    for name in formats:
        out = F.when(fmt == name, build(name)).otherwise(out)
    return out


# ---- calls from text ------------------------------------------------------------------------------------------------

def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _call(name: Column, arguments: Column) -> Column:
    return F.struct(name.cast("string").alias("name"), arguments.cast("string").alias("arguments"))


def _sound(calls: Column) -> Column:
    """All or nothing: null when any call lacks a name or arguments, or when there is none."""
    whole = (F.size(calls) > 0) & F.forall(calls, lambda c: c["name"].isNotNull() & c["arguments"].isNotNull())
    return F.when(whole, calls)


def _object_call(text: Column, name: str = "arguments") -> Column:
    return _call(F.when(is_json(text), field(text, "name")), F.when(is_json(text), _argument_text(text, name)))


def _tagged_arguments(block: Column, pattern: str, trim_raw: bool) -> Column:
    """JSON object from (key, value) tags; a value that is not JSON becomes a string."""
    pairs = F.arrays_zip(_all(block, pattern, 1).alias("k"), _all(block, pattern, 2).alias("v"))
    shown = F.transform(pairs, lambda p: F.concat(quoted(p["k"]), F.lit(": "), F.when(
        is_json(strip(p["v"])), spaced(strip(p["v"]))).otherwise(quoted(strip(p["v"]) if trim_raw else p["v"]))))
    return F.concat(F.lit("{"), F.array_join(shown, ", "), F.lit("}"))


# Parts of a keyword call: a text in quotes, the start of a call, a keyword, a word, a number, a sign.
_PARTS = (r"""("(?:[^"\\\n]|\\[^\n])*+"|'(?:[^'\\\n]|\\[^\n])*+'|\b[A-Za-z_]\w*\s*\(|\b[A-Za-z_]\w*\s*=|\b(?:True|False|None|true|false|null)\b"""
          r"""|-?(?:\b0|\b[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?\b|[\[\]{}:,)])""")
_ESCAPES = {"\\n": "\n", "\\t": "\t", "\\r": "\r", "\\b": "\b", "\\f": "\f", "\\a": "\a", "\\v": "\v", "\\\\": "\\", "\\'": "'", '\\"': '"'}


def _unescaped(body: Column) -> Column:
    """The characters of a text between quotes; an escape without a meaning stays as it is written."""
    def meant(piece):
        code = F.regexp_replace(piece, r"^\\x", r"\\u00")
        out = F.when(piece.rlike(r"^\\(x..|u....)$"), F.get_json_object(F.concat(F.lit('["'), code, F.lit('"]')), "$[0]"))
        for written, char in _ESCAPES.items():
            out = out.when(piece == written, F.lit(char))
        return out.otherwise(piece)
    pieces = _all(body, r"(?s)([^\\]+|\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\.)", 1)
    return F.array_join(F.transform(pieces, meant), "")


def _keyword_calls(code: Column) -> Column:
    """Calls written as ``f(a="x", b=[1, 2])``, one or a list of them. Part for part they become JSON, in which a call is an
    object that holds a list, so that brackets which do not match give no JSON. Numbers keep their spelling. Positional
    arguments, repeated keywords, tuples, keys that are not texts, and texts with a prefix or three quotes give no call."""
    def shown(part):
        word = F.regexp_replace(part, r"\s*[(=]$", "")
        return (F.when(part.rlike("^[\"']"), quoted(_unescaped(part.substr(F.lit(2), F.length(part) - 2))))
                .when(part.endswith("("), F.concat(F.lit('{"name": "'), word, F.lit('", "arguments": [{')))
                .when(part.endswith("="), F.concat(F.lit('"'), word, F.lit('": ')))
                .when(part == ")", "}]}").when(part == "None", "null").when(part.isin("True", "False"), F.lower(part))
                .otherwise(part))

    def build(parts):
        # A comma that ends a list is told from others by the part after it.
        last = F.transform(parts, lambda p, i: (p == ",") & F.coalesce(F.get(parts, i + 1), F.lit("")).isin(")", "]", "}"))
        kept = F.filter(parts, lambda p, i: ~F.get(last, i))
        starts = F.size(F.filter(parts, lambda p: p.endswith("(") & ~p.rlike("^[\"']")))
        text = F.array_join(F.transform(kept, shown), " ")
        listed = F.get(parts, F.lit(0)) == "["
        whole = F.regexp_replace(code, _PARTS, "").rlike(r"^\s*$") & is_json(text) & (listed | (starts == 1))

        def call(c):
            held = field(c, "arguments")
            return _call(field(c, "name"), spaced(held.substr(F.lit(2), F.length(held) - 2)))
        return F.when(whole, let(items(text), lambda found: F.when(F.size(found) == starts, _sound(F.transform(found, call)))))
    return let(_all(code, _PARTS, 1), build)


def extract_calls(text: Column, fmt: str = "default") -> Column:
    """Array of (name, arguments as JSON) or null when the text holds no well-formed call in this syntax."""
    if fmt == "default":
        pattern = r"(?sU)Action:\s*([a-zA-Z0-9_]+)\s*Action Input:\s*(.+?)(?=\s*Action:|\s*$)"
        found = F.arrays_zip(_all(text, pattern, 1).alias("n"), _all(text, pattern, 2).alias("a"))

        def build(m):
            value = F.trim(F.trim(strip(m["a"]), F.lit('"')), F.lit("`"))
            return _call(strip(m["n"]), F.when(is_json(value), spaced(value)))
        return _sound(F.transform(found, build)).cast(CALLS)
    if fmt == "glm4":
        at = F.instr(text, "\n")
        value = strip(text.substr(at + 1, F.length(text)))
        good = (at > 0) & is_json(value)
        return F.when(good, F.array(_call(text.substr(F.lit(1), at - 1), spaced(value)))).cast(CALLS)
    if fmt in ("llama3", "mistral"):
        name = "parameters" if fmt == "llama3" else "arguments"
        calls = F.transform(items(strip(text)), lambda c: _object_call(c, name))
        return F.when(is_json(strip(text)), _sound(calls)).cast(CALLS)
    if fmt == "minimax1":
        inner = F.regexp_extract(text, r"(?sU)<tool_calls>\s*(.+?)\s*</tool_calls>", 1)
        rows = F.filter(F.transform(F.split(inner, "\n"), strip), is_json)
        return F.when(text.rlike(r"(?sU)<tool_calls>\s*(.+?)\s*</tool_calls>"),
                      F.transform(rows, lambda r: _object_call(r))).cast(CALLS)
    if fmt == "minimax2":
        pattern = r"(?sU)<minimax:tool_call>\s*(.+?)\s*</minimax:tool_call>"
        inner = F.regexp_extract(text, pattern, 1)
        invoke = r'(?s)<invoke name="(.*?)">(.*?)</invoke>'
        found = F.arrays_zip(_all(inner, invoke, 1).alias("n"), _all(inner, invoke, 2).alias("b"))
        return F.when(text.rlike(pattern), F.transform(found, lambda m: _call(strip(m["n"]), _tagged_arguments(
            m["b"], r'(?s)<parameter name="(.*?)">(.*?)</parameter>', False)))).cast(CALLS)
    if fmt in ("qwen", "ling", "glm4_moe"):
        found = _all(text, r"(?sU)<tool_call>(.+?)</tool_call>(?=\s*<tool_call>|\s*$)", 1)
        return _sound(F.transform(found, lambda m: _object_call(strip(m)))).cast(CALLS)
    if fmt in ("qwen3_5", "seed_oss"):
        # The seed syntax takes every character up to a blank or "<" as the name, the closing ">" included.
        tag, name = ("tool_call", r"([^\s<>]+)") if fmt == "qwen3_5" else ("seed:tool_call", r"([^\s<]+)")
        pattern = rf"(?sU)<{tag}>\s*<function=\s*{name}\s*(.*?)\s*</function>\s*</{tag}>"
        found = F.arrays_zip(_all(text, pattern, 1).alias("n"), _all(text, pattern, 2).alias("b"))
        calls = F.transform(found, lambda m: _call(strip(m["n"]), _tagged_arguments(
            m["b"], r"(?s)<parameter=(.*?)>(.*?)</parameter>", fmt == "qwen3_5")))
        return (F.when(F.size(calls) > 0, calls) if fmt == "qwen3_5" else calls).cast(CALLS)
    if fmt == "lfm2":
        found = between(text, F.lit("<|tool_call_start|>"), F.lit("<|tool_call_end|>"))
        return let(found["inner"], _keyword_calls).cast(CALLS)
    raise ValueError(f"no extractor for tool format {fmt}")


def calls_of(text: str, fmt: str | Column) -> Column:
    """Calls of each text; ``fmt`` is a syntax name or a column of names."""
    def choose(t):
        if isinstance(fmt, str):
            return extract_calls(t, fmt)
        calls = F.lit(None).cast(CALLS)
        for name in FORMATS:
            calls = F.when(fmt == name, extract_calls(t, name)).otherwise(calls)
        return calls
    return let(F.col(text), choose)


def calls_table(df, text: str, fmt: str | Column, keep: list[str]):
    """(calls: keep..., call_idx, name, arguments; rejects: keep..., text). The calls are exploded as an expression:
    exploding a computed column would make the optimizer compute it again in a filter on its size."""
    found = df.select(*keep, F.posexplode(calls_of(text, fmt)).alias("call_idx", "_call"))
    rejects = df.filter(F.coalesce(F.size(calls_of(text, fmt)), F.lit(0)) <= 0).select(*keep, text)
    return found.select(*keep, "call_idx", "_call.name", "_call.arguments"), rejects


def usage_stats(df, text: str, fmt, by: list[str]):
    """Per group and function name: calls, and the group's texts, failed texts and failure_rate. Texts without a
    well-formed call form the row without a name. Texts are read once; the group totals come from the counted rows."""
    spread = df.select(*by, F.posexplode_outer(calls_of(text, fmt)).alias("_i", "_call"))
    per = spread.groupBy(*by, F.col("_call.name").alias("name")).agg(
        F.count(F.lit(1)).alias("calls"), F.sum(F.when(F.coalesce("_i", F.lit(0)) == 0, 1).otherwise(0)).alias("_texts"))
    group = Window.partitionBy(*by)
    failed = F.coalesce(F.sum(F.when(F.col("name").isNull(), F.col("calls"))).over(group), F.lit(0))
    out = per.withColumn("texts", F.sum("_texts").over(group)).withColumn("failed", failed).drop("_texts")
    return out.withColumn("failure_rate", F.col("failed") / F.col("texts"))


# ---- parts of generated text ----------------------------------------------------------------------------------------

PART_TAGS = r"(?sU)<(thinking|tool_call)>\s*(.*?)\s*</\1>\s*"


def parse_generated(text: Column) -> Column:
    """Ordered parts (type, value): text between tags, thinking as reasoning, tool_call bodies; ``bad_call`` marks a
    body that is not JSON."""
    def part(kind, value):
        return F.struct(kind.alias("type"), value.alias("value"))

    def one(z):
        def at(piece, i):
            tag, body = F.get(z["tags"], i), strip(F.get(z["bodies"], i))
            kind = F.when(tag == "thinking", "reasoning").when(is_json(body), "tool_call").otherwise("bad_call")
            lead = part(F.lit("text"), strip(piece))
            return F.when(tag.isNull(), F.array(lead)).otherwise(F.array(lead, part(kind, body)))
        return F.flatten(F.transform(z["between"], at))

    parts = let(F.struct(F.split(text, PART_TAGS, -1).alias("between"), _all(text, PART_TAGS, 1).alias("tags"),
                         _all(text, PART_TAGS, 2).alias("bodies")), one)
    return F.filter(parts, lambda p: (p["type"] != "text") | (F.length(p["value"]) > 0))
