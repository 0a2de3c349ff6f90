"""Chat rows to text. Everything is string concatenation of template pieces, so one expression serves a literal template
and a template joined from the catalogue table."""

from pyspark.sql import Column, DataFrame, functions as F

from prefmill.functions.jsontext import field, is_json, items, quoted, spaced
from prefmill.functions.numeric import let
from prefmill.functions.text import replace_first
from prefmill.operators.templates import TEMPLATES
from prefmill.operators.tools import FORMATS, TOOL_PROMPTS, by_format, literal, render_function, tool_prompt


def _filled(tpl, role: str, content: Column) -> Column:
    return F.concat(tpl[f"{role}_head"], content, tpl[f"{role}_tail"])


def _tools_text(tools: Column, fmt: str, date: str) -> Column:
    return F.concat(F.lit("<|tool|>"), tools, F.lit("<|/tool|>")) if fmt == "verbatim" else tool_prompt(tools, fmt, date)


def system_text(system: Column, tools: Column | None, tpl, fmt: str | None, date: str = "") -> Column:
    """System block of the first turn; empty when there is neither a system text nor tools."""
    base = F.when(F.length(system) > 0, system).otherwise(tpl["default_system"])
    told, wanted = F.lit(""), F.length(base) > 0
    if tools is not None:
        if fmt is not None:
            shown = _tools_text(tools, fmt, date)
        else:
            shown = by_format(tpl["tool_format"], [*FORMATS, "verbatim"], lambda f: _tools_text(tools, f, date))
        told = F.when(F.length(tools) > 0, shown).otherwise("")
        wanted = wanted | (F.length(tools) > 0)
    return F.when(wanted, _filled(tpl, "system", F.concat(base, told))).otherwise("")


def render_turns(messages: Column, system: Column, tpl, tools: Column | None = None, name: str | None = None,
                 date: str = "", formats=FORMATS) -> Column:
    """One string per message. ``name`` selects the tool syntax when the template is known at plan time; otherwise the
    syntax named in the template row is used, out of ``formats`` (pass none for chats without function turns)."""
    row = TEMPLATES.get(name) if name else None
    block = system_text(system, tools, tpl, row.tool_format if row else None, date)
    fused = tpl["kind"] == "system_in_user"

    def one(m, i):
        content = m["content"]
        asked = F.when(fused & (i == 0), F.concat(block, content)).otherwise(content)
        asked = _filled(tpl, "user", asked)
        asked = F.when(fused, asked).otherwise(replace_first(asked, "{{idx}}", F.floor(i / 2).cast("string")))
        words = ((tpl["thought_open"], tpl["thought_close"]), (tpl["call_open"], tpl["call_close"]))
        if row:
            call = render_function(content, row.call_format, *words)
        else:
            call = by_format(tpl["call_format"], formats, lambda f: render_function(content, f, *words))
        body = (F.when(m["role"] == "user", asked)
                .when(m["role"] == "assistant", _filled(tpl, "assistant", content))
                .when(m["role"] == "observation", _filled(tpl, "observation", content))
                .when(m["role"] == "function", _filled(tpl, "function", call)))
        lead = F.concat(tpl["prefix"], F.when(fused, "").otherwise(block))
        return F.when(i == 0, F.concat(lead, body)).otherwise(body)

    return F.transform(messages, one)


def render_chat(df: DataFrame, templates: DataFrame, on: str = "template", messages: str = "messages",
                system: str = "system", tools: str | None = None, date: str = "", formats=FORMATS) -> DataFrame:
    """Adds ``turns`` and ``text``; the template of each row is looked up in a broadcast catalogue table."""
    named = templates.withColumnRenamed("name", on)
    joined = df.join(F.broadcast(named), on)
    tpl = {c: F.col(c) for c in named.columns}
    out = joined.withColumn("turns", render_turns(F.col(messages), F.col(system), tpl, F.col(tools) if tools else None, date=date, formats=formats))
    return out.withColumn("text", F.array_join("turns", "")).select(*df.columns, "turns", "text")


# ---- reasoning ------------------------------------------------------------------------------------------------------

def empty_thought(name: str) -> str:
    row = TEMPLATES[name]
    return row.thought_close if row.kind == "closing" else row.thought_open + row.thought_close


def remove_thought(content: Column, name: str) -> Column:
    row = TEMPLATES[name]
    pattern = f"(?s){literal(row.thought_open)}(.*?){literal(row.thought_close)}"
    return F.ltrim(F.regexp_replace(content, pattern, ""), F.lit("\n"))


def _has_thought(content: Column, name: str) -> Column:
    row = TEMPLATES[name]
    return content.contains(row.thought_open.strip()) | content.contains(row.thought_close.strip())


def _strip_at(messages: Column, name: str, where) -> Column:
    return F.transform(messages, lambda m, i: F.struct(m["role"].alias("role"), F.when(
        where(i), remove_thought(m["content"], name)).otherwise(m["content"]).alias("content")))


def render_pairs(messages: Column, system: Column, name: str, tpl, thinking: bool | None = True,
                 tools: Column | None = None) -> Column:
    """Array of (prompt, response) texts, one per question and answer."""
    reasons = TEMPLATES[name].kind in ("reasoning", "closing")
    if reasons and thinking is False:
        messages = _strip_at(messages, name, lambda i: i % 2 == 1)
    def pairs(z):
        told, turns = z["messages"], z["turns"]

        def pair(i):
            prompt, response = F.get(turns, i), F.get(turns, i + 1)
            if reasons:
                bare = ~_has_thought(F.get(told, i + 1)["content"], name)
                if thinking:
                    response = F.when(bare, F.concat(F.lit(empty_thought(name)), response)).otherwise(response)
                else:
                    prompt = F.when(bare, F.concat(prompt, F.lit(empty_thought(name)))).otherwise(prompt)
            return F.struct(prompt.alias("prompt"), response.alias("response"))

        places = F.filter(F.transform(told, lambda m, i: F.when(i % 2 == 0, i)), lambda i: i.isNotNull())
        return F.transform(places, pair)

    turns = render_turns(messages, system, tpl, tools, name)
    return let(F.struct(messages.alias("messages"), turns.alias("turns")), pairs)


def render_oneturn(messages: Column, system: Column, name: str, tpl, thinking: bool | None = True,
                   tools: Column | None = None) -> Column:
    """Struct (prompt, response): everything up to the last message, and the last message. Earlier answers lose their
    thoughts."""
    reasons = TEMPLATES[name].kind in ("reasoning", "closing")
    last = F.size(messages) - 1
    if reasons:
        messages = _strip_at(messages, name, lambda i: ((i % 2 == 1) & (i < last - 1)) |
                             ((i == last) & F.lit(thinking is False)))
    def both(turns):
        prompt = F.array_join(F.slice(turns, F.lit(1), F.greatest(last, F.lit(0))), "")
        response = F.get(turns, last)
        if reasons:
            bare = ~_has_thought(F.get(messages, last)["content"], name)
            if thinking:
                response = F.when(bare, F.concat(F.lit(empty_thought(name)), response)).otherwise(response)
            else:
                prompt = F.when(bare, F.concat(prompt, F.lit(empty_thought(name)))).otherwise(prompt)
        return F.struct(prompt.alias("prompt"), response.alias("response"))

    return let(render_turns(messages, system, tpl, tools, name), both)


# ---- messages with typed parts --------------------------------------------------------------------------------------

IM_OPEN, IM_CLOSE = "<|im_start|>", "<|im_end|>\n"
_QWEN_BEFORE, _QWEN_AFTER = TOOL_PROMPTS["qwen"]


def segment(text: Column, weight: Column) -> Column:
    return F.struct(text.alias("text"), weight.cast("double").alias("weight"))


def _texts(message: Column) -> Column:
    return F.array_join(F.transform(message["content"], lambda p: p["value"]), "")


def _weight(message: Column) -> Column:
    return F.coalesce(message["loss_weight"], F.when(message["role"] == "assistant", 1.0).otherwise(0.0))


def render_chatml_v1(messages: Column, generate: bool = False) -> Column:
    """Segments (text, weight), one per message; text parts only."""
    out = F.transform(messages, lambda m: segment(
        F.concat(F.lit(IM_OPEN), m["role"], F.lit("\n"), _texts(m), F.lit(IM_CLOSE)), _weight(m)))
    return F.concat(out, F.array(segment(F.lit(f"{IM_OPEN}assistant\n"), F.lit(0.0)))) if generate else out


def _assistant_parts(message: Column) -> Column:
    parts = message["content"]

    def one(p, i):
        value = p["value"]
        before = F.get(parts, i - 1)["type"]
        gap = F.when((i > 0) & before.isin("text", "tool_call"), "\n").otherwise("")
        arguments = F.when(F.schema_of_variant(F.try_variant_get(F.try_parse_json(value), "$.arguments", "variant")) == "STRING",
                           quoted(field(value, "arguments"))).otherwise(spaced(field(value, "arguments")))
        call = F.concat(gap, F.lit('<tool_call>\n{"name": "'), field(value, "name"), F.lit('", "arguments": '),
                        arguments, F.lit("}\n</tool_call>"))
        return (F.when(p["type"] == "text", value)
                .when(p["type"] == "reasoning", F.concat(F.lit("<thinking>\n"), value, F.lit("\n</thinking>\n\n")))
                .when((p["type"] == "tool_call") & is_json(value), call))

    return F.array_join(F.transform(parts, one), "")


def render_v1_tools(messages: Column, tools: Column | None = None, generate: bool = False) -> Column:
    """Segments (text, weight) with a tools block, tagged calls, and runs of tool results inside one user turn."""
    count = F.size(messages)

    def one(m, i):
        role = m["role"]
        first = (i == 0) | (F.get(messages, i - 1)["role"] != "tool")
        last = (i == count - 1) | (F.get(messages, i + 1)["role"] != "tool")
        plain = F.concat(F.lit(IM_OPEN), role, F.lit("\n"), _texts(m), F.lit(IM_CLOSE))
        answer = F.concat(F.lit(IM_OPEN), role, F.lit("\n"), _assistant_parts(m), F.lit(IM_CLOSE))
        result = F.concat(F.when(first, IM_OPEN + "user").otherwise(""), F.lit("\n<tool_response>\n"), _texts(m),
                          F.lit("\n</tool_response>"), F.when(last, IM_CLOSE).otherwise(""))
        text = (F.when((role == "user") | ((role == "system") & (i > 0)), plain).when(role == "assistant", answer)
                .when(role == "tool", result).otherwise(""))
        weight = F.coalesce(m["loss_weight"], F.when(role == "assistant", 1.0).otherwise(0.0))
        return segment(text, weight)

    lead = F.get(messages, F.lit(0))
    has_system = lead["role"] == "system"
    own = F.when(has_system, _texts(lead)).otherwise("")
    head = F.when(has_system, F.concat(F.lit(IM_OPEN + "system\n"), own, F.lit(IM_CLOSE))).otherwise("")
    if tools is not None:
        listed = F.array_join(F.transform(items(tools), lambda t: F.concat(F.lit("\n"), spaced(t))), "")
        told = F.concat(F.lit(IM_OPEN + "system\n"), F.when(has_system, F.concat(own, F.lit("\n\n"))).otherwise(""),
                        F.lit(_QWEN_BEFORE.lstrip("\n")), listed, F.lit(_QWEN_AFTER + IM_CLOSE))
        head = F.when(F.length(tools) > 0, told).otherwise(head)
    weight = F.when(has_system, F.coalesce(lead["loss_weight"], F.lit(0.0))).otherwise(0.0)
    out = F.concat(F.array(segment(head, weight)), F.transform(messages, one))
    if generate:
        out = F.concat(out, F.array(segment(F.lit(f"{IM_OPEN}assistant\n"), F.lit(0.0))))
    return F.filter(out, lambda s: F.length(s["text"]) > 0)


def segments_to_ids(segments: Column, tokenize) -> tuple[Column, Column, Column]:
    """(input ids, labels, loss weights) of rendered segments; positions without weight are masked."""
    def one(s):
        return let(tokenize(s["text"]), lambda t: F.struct(
            t.alias("ids"), F.when(s["weight"] > 1e-6, t).otherwise(F.array_repeat(F.lit(-100), F.size(t))).alias("labels"),
            F.array_repeat(s["weight"], F.size(t)).alias("weights")))
    cells = F.transform(segments, one)
    return tuple(F.flatten(cells[name]) for name in ("ids", "labels", "weights"))


def join_pair(chosen: Column, rejected: Column) -> tuple[Column, Column]:
    """Chosen ids followed by rejected ids, and side marks 1 and 2."""
    marks = F.concat(F.array_repeat(F.lit(1), F.size(chosen)), F.array_repeat(F.lit(2), F.size(rejected)))
    return F.concat(chosen, rejected), marks
