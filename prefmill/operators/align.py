"""Raw instruction, chat and preference rows to the hub schema. All aligners are stateless column expressions and run
unchanged on batch and streaming DataFrames."""

from pyspark.sql import Column, DataFrame, functions as F

from prefmill.functions.jsontext import is_json, items, quoted, spaced
from prefmill.functions.text import truthy
from prefmill.schemas import MESSAGES, PARTS, RICH_MESSAGES
from prefmill.sources.registry import DatasetSpec

TOOL_RESULT_JOINT = "\n</tool_response>\n<tool_response>\n"
SHORT_SYSTEM = "detailed thinking off"
ALIGNERS = {}
CONVERTERS = {}


def register_aligner(name: str):
    """Add an aligner ``(df, spec, keep) -> df`` under a name; a name can be taken once."""
    def add(fn):
        if name in ALIGNERS:
            raise ValueError(f"aligner {name} already exists")
        ALIGNERS[name] = fn
        return fn
    return add


def register_converter(name: str):
    """Add a converter ``(df, keep) -> df`` to messages with typed parts under a name; a name can be taken once."""
    def add(fn):
        if name in CONVERTERS:
            raise ValueError(f"converter {name} already exists")
        CONVERTERS[name] = fn
        return fn
    return add


def align(df: DataFrame, spec: DatasetSpec, keep: list[str] = ()) -> DataFrame:
    if spec.formatting not in ALIGNERS:
        raise ValueError(f"aligner {spec.formatting} not found")
    return ALIGNERS[spec.formatting](df, spec, list(keep))


def message(role, content: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(role.cast("string").alias("role"), content.cast("string").alias("content"))


def no_messages() -> Column:
    return F.array().cast(MESSAGES)


def _named(name: str | None, default: str) -> Column:
    return F.col(name) if name else F.lit(default)


def _media(df: DataFrame, name: str | None) -> Column:
    if not name:
        return F.lit(None).cast("array<string>")
    column = F.col(name)
    return F.when(F.size(column) > 0, column)


def _hub(df: DataFrame, spec: DatasetSpec, keep, prompt: Column, response: Column, system: Column,
         tools: Column) -> DataFrame:
    return df.select(*keep, prompt.cast(MESSAGES).alias("_prompt"), response.cast(MESSAGES).alias("_response"),
                     system.alias("_system"), tools.alias("_tools"),
                     _media(df, spec.images).alias("_images"), _media(df, spec.videos).alias("_videos"),
                     _media(df, spec.audios).alias("_audios"))


def _feedback(tag: Column, answer: Column) -> Column:
    """Desired answers come first, undesired ones second; the other slot is an empty answer."""
    empty = F.array(message("assistant", F.lit("")))
    return F.when(tag, F.concat(answer, empty)).otherwise(F.concat(empty, answer))


@register_aligner("alpaca")
def align_alpaca(df: DataFrame, spec: DatasetSpec, keep=()) -> DataFrame:
    parts = [truthy(F.col(c)) for c in (spec.prompt, spec.query) if c]
    user = F.array(message("user", F.concat_ws("\n", *parts) if parts else F.lit("")))
    if spec.history:
        turns = F.flatten(F.transform(spec.history, lambda h: F.array(message("user", h[0]), message("assistant", h[1]))))
        prompt = F.concat(F.coalesce(turns, no_messages()), user)
    else:
        prompt = user
    answer = F.col(spec.response) if spec.response else F.lit(None).cast("string")
    response = F.when(answer.isNotNull(), F.array(message("assistant", answer))).otherwise(no_messages())
    if spec.ranking:
        good, bad = F.col(spec.chosen), F.col(spec.rejected)
        response = F.when(good.isNotNull() & bad.isNotNull(),
                          F.array(message("assistant", good), message("assistant", bad))).otherwise(response)
    if spec.kto_tag:
        tag = F.col(spec.kto_tag)
        response = F.when(tag.isNotNull(), _feedback(tag, F.array(message("assistant", answer)))).otherwise(response)
    return _hub(df, spec, keep, prompt, response, _named(spec.system, ""), _named(spec.tools, ""))


def _roles(spec: DatasetSpec) -> list[tuple[str, str]]:
    return [(spec.user_tag, "user"), (spec.assistant_tag, "assistant"), (spec.observation_tag, "observation"),
            (spec.function_tag, "function"), (spec.system_tag, "system")]


def _role_of(tag: Column, spec: DatasetSpec) -> Column:
    out = F.lit(None).cast("string")
    for raw, role in reversed(_roles(spec)):
        if raw:
            out = F.when(tag == raw, role).otherwise(out)
    return out


def _split_system(spec: DatasetSpec) -> tuple[Column, Column]:
    """(system text, messages without a leading system message)."""
    messages = F.col(spec.messages)
    fallback = _named(spec.system, "")
    if not spec.system_tag:
        return fallback, messages
    leads = (F.size(messages) > 0) & (F.get(messages, F.lit(0))[spec.role_tag] == spec.system_tag)
    system = F.when(leads, F.get(messages, F.lit(0))[spec.content_tag]).otherwise(fallback)
    rest = F.when(leads, F.slice(messages, F.lit(2), F.greatest(F.size(messages) - 1, F.lit(0)))).otherwise(messages)
    return system, rest


def alternates(messages: Column) -> Column:
    """True when even positions are asked (user, observation) and odd positions answered (assistant, function)."""
    ok = F.transform(messages, lambda m, i: F.coalesce(
        F.when(i % 2 == 0, m["role"].isin("user", "observation")).otherwise(m["role"].isin("assistant", "function")),
        F.lit(False)))
    return F.forall(ok, lambda x: x)


def _conversation(df: DataFrame, spec: DatasetSpec, keep, turns: Column, system: Column, tools: Column) -> DataFrame:
    """Shared tail of the chat layouts: validity, then feedback, pair or last-turn response."""
    wide = df.withColumn("_turns", turns.cast(MESSAGES))
    turns = F.col("_turns")
    parity = F.size(turns) % 2 == (1 if spec.ranking else 0)
    valid = alternates(turns) & parity
    last = F.slice(turns, F.greatest(F.size(turns), F.lit(1)), F.lit(1))
    head = F.slice(turns, F.lit(1), F.greatest(F.size(turns) - 1, F.lit(0)))
    prompt, response = head, last
    if spec.ranking:
        good, bad = F.col(spec.chosen), F.col(spec.rejected)
        has_pair = good.isNotNull() & bad.isNotNull()
        pair = F.array(*[message(_role_of(s[spec.role_tag], spec), s[spec.content_tag]) for s in (good, bad)])
        prompt = F.when(has_pair, turns).otherwise(prompt)
        response = F.when(has_pair, pair).otherwise(response)
    if spec.kto_tag:
        tag = F.col(spec.kto_tag)
        prompt = F.when(tag.isNotNull(), head).otherwise(prompt)
        response = F.when(tag.isNotNull(), _feedback(tag, last)).otherwise(response)
    return _hub(wide, spec, keep, F.when(valid, prompt).otherwise(no_messages()),
                F.when(valid, response).otherwise(no_messages()), system, tools)


@register_aligner("sharegpt")
def align_sharegpt(df: DataFrame, spec: DatasetSpec, keep=()) -> DataFrame:
    system, rest = _split_system(spec)
    turns = F.transform(rest, lambda m: message(_role_of(m[spec.role_tag], spec), m[spec.content_tag]))
    return _conversation(df, spec, keep, turns, system, _named(spec.tools, ""))


def merge_tool_results(messages: Column) -> Column:
    """Fold runs of tool results into one observation; a run at the very end is never closed and is dropped."""
    empty = F.array().cast("array<string>")
    start = F.struct(no_messages().alias("done"), empty.alias("open"))

    def step(acc, m):
        flushed = F.when(F.size(acc["open"]) > 0, F.array_append(
            acc["done"], message("observation", F.array_join(acc["open"], TOOL_RESULT_JOINT)))).otherwise(acc["done"])
        waits = m["role"] == "observation"
        return F.struct(F.when(waits, acc["done"]).otherwise(F.array_append(flushed, m)).alias("done"),
                        F.when(waits, F.array_append(acc["open"], m["content"])).otherwise(empty).alias("open"))

    return F.aggregate(messages, start, step, lambda acc: acc["done"])


def calls_as_json(calls: Column) -> Column:
    """``[{"name": ..., "arguments": "..."}]`` from an array of structs with a ``function`` field."""
    return F.concat(F.lit("["), F.array_join(F.transform(calls, lambda c: F.concat(
        F.lit('{"name": '), quoted(c["function"]["name"]), F.lit(', "arguments": '),
        quoted(c["function"]["arguments"]), F.lit("}"))), ", "), F.lit("]"))


@register_aligner("openai")
def align_openai(df: DataFrame, spec: DatasetSpec, keep=()) -> DataFrame:
    system, rest = _split_system(spec)

    def convert(m):
        role = _role_of(m[spec.role_tag], spec)
        calls = role.isin("assistant", "function") & (F.size(m["tool_calls"]) > 0)
        return message(F.when(calls, "function").otherwise(role),
                       F.when(calls, calls_as_json(m["tool_calls"])).otherwise(m[spec.content_tag]))

    turns = merge_tool_results(F.transform(rest, convert))
    tools = F.coalesce(_named(spec.tools, ""), F.lit(""))
    system = F.coalesce(system, F.lit(""))
    has_tools = F.length(tools) > 0
    noted = system.contains("detailed thinking on") | system.contains(SHORT_SYSTEM)
    system = (F.when((F.length(system) == 0) & ~has_tools, SHORT_SYSTEM)
              .when(F.length(system) == 0, "")
              .when(has_tools, F.concat(system, F.lit("\n")))
              .when(noted, system)
              .otherwise(F.concat(system, F.lit("\n" + SHORT_SYSTEM))))
    return _conversation(df, spec, keep, turns, system, tools)


# ---- message lists with typed content parts and loss weights --------------------------------------------------------

def part(kind: str, value: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), value.cast("string").alias("value"))


def rich(role, parts: Column, weight) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    weight = F.lit(float(weight)) if not isinstance(weight, Column) else weight
    return F.struct(role.alias("role"), parts.cast(PARTS).alias("content"), weight.cast("double").alias("loss_weight"))


@register_converter("alpaca")
def align_v1_alpaca(df: DataFrame, keep=()) -> DataFrame:
    """Instruction and input are concatenated without a separator."""
    have = set(df.columns)
    out = []
    if "system" in have:
        out.append(F.when(F.col("system").isNotNull(), rich("system", F.array(part("text", F.col("system"))), 0)))
    asked = [F.coalesce(F.col(c), F.lit("")) for c in ("instruction", "input") if c in have]
    if asked:
        out.append(rich("user", F.array(part("text", F.concat(*asked))), 0))
    if "output" in have:
        out.append(F.when(F.col("output").isNotNull(), rich("assistant", F.array(part("text", F.col("output"))), 1)))
    return df.select(*keep, F.array_compact(F.array(*out)).cast(RICH_MESSAGES).alias("messages"))


def _call_parts(text: Column) -> Column:
    return F.transform(items(text), lambda c: part("tool_call", spaced(c)))


def _valid_tools(df: DataFrame) -> list[Column]:
    if "tools" not in df.columns:
        return []
    return [F.when((F.length("tools") > 0) & is_json(F.col("tools")), spaced(F.col("tools"))).alias("tools")]


@register_converter("sharegpt")
def align_v1_sharegpt(df: DataFrame, keep=()) -> DataFrame:
    """Unknown tags and calls whose JSON does not parse are left out; a list of calls gives one part per call."""
    def convert(m):
        tag, value = m["from"], m["value"]
        text = F.array(part("text", value))
        return (F.when((tag == "function_call") & is_json(value), rich("assistant", _call_parts(value), 1))
                .when(tag == "system", rich("system", text, 0)).when(tag == "human", rich("user", text, 0))
                .when(tag == "gpt", rich("assistant", text, 1)).when(tag == "observation", rich("tool", text, 0)))
    messages = F.array_compact(F.transform("conversations", convert)).cast(RICH_MESSAGES)
    return df.select(*keep, messages.alias("messages"), *_valid_tools(df))


@register_converter("pair")
def align_v1_pair(df: DataFrame, keep=()) -> DataFrame:
    """Chosen and rejected message lists; tool messages carry calls as JSON, bad ones are left out."""
    def convert(m):
        role = m["role"]
        weight = F.when(role == "assistant", 1.0).otherwise(0.0)
        return (F.when((role == "tool") & is_json(m["content"]), rich(role, _call_parts(m["content"]), weight))
                .when(role != "tool", rich(role, F.array(part("text", m["content"])), weight)))
    sides = [F.array_compact(F.transform(side, convert)).cast(RICH_MESSAGES).alias(f"{side}_messages")
             for side in ("chosen", "rejected")]
    return df.select(*keep, *sides, *_valid_tools(df))


# ---- turns and validity ---------------------------------------------------------------------------------------------

def group_turns(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """Long turn rows to one ordered message array per conversation. A conversation is one row of the data model, so
    its turns meet in one task; the tables' growth is in the number of conversations."""
    collected = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return turns.groupBy(key).agg(F.transform(collected, lambda m: F.struct(m["role"], m["content"])).alias("messages"))


def role_fault(messages: Column, ranking: bool = False) -> Column:
    """``ok``, ``order`` (a role in the wrong place) or ``parity`` (the last side is missing)."""
    return (F.when(~alternates(messages), "order")
            .when(F.size(messages) % 2 != (1 if ranking else 0), "parity").otherwise("ok"))


def usable(stage: str) -> Column:
    """Row filter per stage over hub rows."""
    odd = F.size("_prompt") % 2 == 1
    answers = F.size("_response")
    return {"sft": odd & (answers == 1), "rm": odd & (answers >= 2), "kto": odd & (answers >= 2), "ppo": odd}[stage]


def drop_invalid(aligned: DataFrame, stage: str) -> tuple[DataFrame, DataFrame]:
    """(rows the stage can train on, rejected rows)."""
    return aligned.filter(usable(stage)), aligned.filter(~usable(stage))
