"""Rendered chats to token ids and labels, with truncation. Stateless column expressions."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from prefmill.functions.numeric import IGNORE, fit_lengths
from prefmill.operators.align import usable
from prefmill.operators.render import render_oneturn, render_pairs
from prefmill.operators.rowindex import ordered_index
from prefmill.operators.templates import TEMPLATES, template
from prefmill.operators.tokens import EOS, char_ids

IDS = "array<int>"


def _cut(ids: Column, length: Column) -> Column:
    return F.slice(ids, F.lit(1), length)


def _masked(length: Column) -> Column:
    return F.array_repeat(F.lit(IGNORE), length)


def infer_seqlen(source: Column, target: Column, cutoff) -> Column:
    """Struct (source, target) of kept lengths."""
    s, t = fit_lengths(source, target, F.lit(cutoff) if isinstance(cutoff, int) else cutoff)
    return F.struct(s.alias("source"), t.alias("target"))


def turn_ids(pairs: Column, tokenize=char_ids) -> Column:
    return F.transform(pairs, lambda p: F.struct(tokenize(p["prompt"]).alias("s"), tokenize(p["response"]).alias("t")))


def with_turn_ids(df: DataFrame, pairs: str, name: str, tokenize=char_ids) -> DataFrame:
    """Adds the ids of each (prompt, response). A tokenizer with a method ``many`` gets all texts of a row in one column,
    since a Python function cannot stand inside an array expression."""
    if not hasattr(tokenize, "many"):
        return df.withColumn(name, turn_ids(F.col(pairs), tokenize))
    texts = F.flatten(F.transform(pairs, lambda p: F.array(p["prompt"], p["response"])))
    df = df.withColumn("_texts", texts).withColumn("_ids", tokenize.many(F.col("_texts")))
    both = F.transform(pairs, lambda p, i: F.struct(F.get("_ids", 2 * i).alias("s"), F.get("_ids", 2 * i + 1).alias("t")))
    return df.withColumn(name, both).drop("_texts", "_ids")


def kept_lengths(turns: Column, cutoff: int, start: int = 0) -> Column:
    """Kept (s, t) lengths per turn: each turn is cut to the budget that is left; turns after the budget is used up are
    absent. The fold carries numbers only."""
    none = F.array().cast("array<struct<s:int,t:int>>")

    def step(acc, turn):
        s, t = fit_lengths(F.size(turn["s"]), F.size(turn["t"]), F.lit(cutoff) - acc["total"])
        grown = F.struct((acc["total"] + s + t).alias("total"), F.array_append(
            acc["kept"], F.struct(s.cast("int").alias("s"), t.cast("int").alias("t"))).alias("kept"))
        return F.when(acc["total"] >= cutoff, acc).otherwise(grown)

    start_state = F.struct(F.lit(start).alias("total"), none.alias("kept"))
    return F.aggregate(turns, start_state, step, lambda acc: acc["kept"])


def sft_arrays(df: DataFrame, turns: str, cutoff: int, train_on_prompt=False, mask_history=False,
               efficient_eos=False, eos: int = EOS) -> DataFrame:
    """Adds input_ids and labels. ``mask_history`` gives the last turns the budget first and trains on the last answer
    only; ``efficient_eos`` closes the row with one end mark and labels the first token of later prompts with it (also
    when such a prompt was cut to nothing)."""
    if train_on_prompt and efficient_eos:
        raise ValueError("train_on_prompt does not go with efficient_eos")
    order = F.reverse(turns) if mask_history else F.col(turns)
    df = df.withColumn("_kept", kept_lengths(order, cutoff, 1 if efficient_eos else 0))
    order = F.reverse(F.col(turns)) if mask_history else F.col(turns)
    used = F.zip_with(F.slice(order, F.lit(1), F.size("_kept")), F.col("_kept"),
                      lambda x, k: F.struct(_cut(x["s"], k["s"]).alias("s"), _cut(x["t"], k["t"]).alias("t")))

    def source_label(x, i):
        if train_on_prompt:
            return x["s"]
        plain = _masked(F.size(x["s"]))
        if efficient_eos:
            marked = F.concat(F.array(F.lit(eos)), _masked(F.greatest(F.size(x["s"]) - 1, F.lit(0))))
            return F.when(i != 0, marked).otherwise(plain)
        return plain

    def target_label(x, i):
        return F.when(i != 0, _masked(F.size(x["t"]))).otherwise(x["t"]) if mask_history else x["t"]

    ids = F.transform("_used", lambda x: F.concat(x["s"], x["t"]))
    labels = F.transform("_used", lambda x, i: F.concat(source_label(x, i), target_label(x, i)))
    if mask_history:
        ids, labels = F.reverse(ids), F.reverse(labels)
    ids, labels = F.flatten(ids), F.flatten(labels)
    if efficient_eos:
        ids, labels = F.concat(ids, F.array(F.lit(eos))), F.concat(labels, F.array(F.lit(eos)))
    return (df.withColumn("_used", used).withColumn("input_ids", ids.cast(IDS)).withColumn("labels", labels.cast(IDS))
            .drop("_used", "_kept"))


def _messages(df: DataFrame) -> Column:
    return F.concat("_prompt", "_response")


def encode_sft(aligned: DataFrame, name: str, cutoff: int = 2048, keep: list[str] = (), tokenize=char_ids,
               train_on_prompt=False, mask_history=False, thinking: bool | None = True, tools=True) -> DataFrame:
    """keep..., input_ids, labels. Rows a supervised stage cannot use are dropped. Tools are told in the system block."""
    rows = aligned.filter(usable("sft"))
    pairs = render_pairs(_messages(rows), F.col("_system"), name, template(name), thinking, F.col("_tools") if tools else None)
    rows = with_turn_ids(rows.withColumn("_pairs", pairs), "_pairs", "_turns", tokenize)
    out = sft_arrays(rows, "_turns", cutoff, train_on_prompt, mask_history, TEMPLATES[name].efficient_eos)
    return out.select(*keep, "input_ids", "labels")


def _oneturn(prompt: Column, answer: Column, name: str, tokenize, thinking) -> tuple[Column, Column]:
    pair = render_oneturn(F.concat(prompt, F.array(answer)), F.col("_system"), name, template(name), thinking, F.col("_tools"))
    target = tokenize(pair["response"])
    if TEMPLATES[name].efficient_eos:
        target = F.concat(target, F.array(F.lit(EOS)))
    return tokenize(pair["prompt"]), target


def _two_sided(source: Column, target: Column, kept: Column) -> tuple[Column, Column]:
    s, t = _cut(source, kept["source"]), _cut(target, kept["target"])
    return F.concat(s, t).cast(IDS), F.concat(_masked(kept["source"]), t).cast(IDS)


def encode_pairwise(aligned: DataFrame, name: str, cutoff: int = 2048, keep=(), tokenize=char_ids,
                    thinking: bool | None = True) -> DataFrame:
    """chosen_/rejected_ input_ids and labels; both sides are cut by the longer answer."""
    rows = aligned.filter(usable("rm"))
    source, chosen = _oneturn(F.col("_prompt"), F.get("_response", F.lit(0)), name, tokenize, thinking)
    _, rejected = _oneturn(F.col("_prompt"), F.get("_response", F.lit(1)), name, tokenize, thinking)
    rows = rows.select(*keep, source.alias("_s"), chosen.alias("_c"), rejected.alias("_r"))
    rows = rows.withColumn("_k", infer_seqlen(F.size("_s"), F.greatest(F.size("_c"), F.size("_r")), cutoff))
    out = []
    for side, ids in (("chosen", "_c"), ("rejected", "_r")):
        both = _two_sided(F.col("_s"), F.col(ids), F.col("_k"))
        out += [c.alias(f"{side}_{n}") for c, n in zip(both, ("input_ids", "labels"))]
    return rows.select(*keep, *out)


def kl_shift(df: DataFrame, key: str, columns: list[str], batch: int = 1000) -> DataFrame:
    """Adds kl_<column>: the value of the row before inside each batch of rows; the first row gets the last one's."""
    indexed = ordered_index(df, [key]).withColumn("_batch", F.floor(F.col("idx") / batch))
    inside = Window.partitionBy("_batch").orderBy("idx")
    whole = inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    for c in columns:
        indexed = indexed.withColumn(f"kl_{c}", F.when(F.row_number().over(inside) == 1, F.last(c).over(whole)).otherwise(F.lag(c).over(inside)))
    return indexed.drop("_batch")


def encode_feedback(aligned: DataFrame, name: str, key: str, cutoff: int = 2048, batch: int = 1000, tokenize=char_ids,
                    thinking: bool | None = True) -> DataFrame:
    """Row and mismatched (KL) encodings plus kto_tags. The neighbour's answer is taken before unusable rows are
    dropped, as batches are formed first."""
    rows = kl_shift(aligned, key, ["_response"], batch).filter(usable("kto"))

    def wanted(response):
        return F.when(F.length(response[0]["content"]) > 0, response[0]).otherwise(response[1])

    sides = {"": F.col("_response"), "kl_": F.col("kl__response")}
    tag = F.length(F.col("_response")[0]["content"]) > 0
    cells = []
    for prefix, response in sides.items():
        source, target = _oneturn(F.col("_prompt"), wanted(response), name, tokenize, thinking)
        cells += [source.alias(f"{prefix}s"), target.alias(f"{prefix}t")]
    rows = rows.select(key, tag.alias("kto_tags"), *cells)
    out = []
    for prefix in sides:
        s, t = F.col(f"{prefix}s"), F.col(f"{prefix}t")
        both = _two_sided(s, t, infer_seqlen(F.size(s), F.size(t), cutoff))
        out += [c.alias(f"{prefix}{n}") for c, n in zip(both, ("input_ids", "labels"))]
    return rows.select(key, *out, "kto_tags")


def encode_prompt_only(aligned: DataFrame, name: str, cutoff: int = 2048, keep=(), tokenize=char_ids,
                       thinking: bool | None = True) -> DataFrame:
    """Prompt ids and, as labels, the ids of the answer (an empty one when there is not exactly one)."""
    rows = aligned.filter(usable("ppo"))
    empty = F.struct(F.lit("assistant").alias("role"), F.lit("").alias("content"))
    answer = F.when(F.size("_response") == 1, F.get("_response", F.lit(0))).otherwise(empty)
    source, target = _oneturn(F.col("_prompt"), answer, name, tokenize, thinking)
    rows = rows.select(*keep, source.alias("_s"), target.alias("_t"))
    kept = infer_seqlen(F.size("_s"), F.size("_t"), cutoff)
    return rows.select(*keep, _cut(F.col("_s"), kept["source"]).cast(IDS).alias("input_ids"),
                       _cut(F.col("_t"), kept["target"]).cast(IDS).alias("labels"))


def encode_pretrain(df: DataFrame, text: str, cutoff: int | None = 2048, keep=(), tokenize=char_ids,
                    bos: int | None = None, eos: int = EOS) -> DataFrame:
    """Text ids with an end mark (and a begin mark if the tokenizer adds one), cut at ``cutoff`` unless it is None."""
    ids = F.concat(*([F.array(F.lit(bos))] if bos is not None else []), tokenize(F.col(text)), F.array(F.lit(eos)))
    return df.select(*keep, (_cut(ids, F.lit(cutoff)) if cutoff else ids).cast(IDS).alias("input_ids"))


def prefix_mask(ids: Column, prompt_length: Column) -> Column:
    """Labels: ids with the first ``prompt_length`` positions masked."""
    return F.transform(ids, lambda x, i: F.when(i < prompt_length, IGNORE).otherwise(x))


def preference_type_check(encoded: DataFrame, tag: str = "kto_tags") -> DataFrame:
    """Counts per class and whether only one class is present."""
    counts = encoded.agg(F.sum(F.col(tag).cast("bigint")).alias("desirable"), F.sum((~F.col(tag)).cast("bigint")).alias("undesirable"))
    return counts.withColumn("one_sided", (F.col("desirable") == 0) | (F.col("undesirable") == 0))


# ---- generated sequences --------------------------------------------------------------------------------------------

def strip_query(ids: Column, pad: int) -> Column:
    """Without the pads on the left."""
    kept = F.filter(F.transform(ids, lambda x, i: F.when(x != pad, i)), lambda i: i.isNotNull())
    first = F.coalesce(F.get(kept, F.lit(0)), F.size(ids))
    return F.slice(ids, first + 1, F.size(ids))


def strip_response(ids: Column, pad: int, eos: int) -> Column:
    """Without the pads on the right; at least one position stays, and one more when the end mark is the pad."""
    last = F.array_max(F.transform(ids, lambda x, i: F.when(x != pad, i)))
    length = F.when(last.isNull(), 1).otherwise(last + (2 if eos == pad else 1))
    return F.slice(ids, F.lit(1), length)


def rotate_left_pad(ids: Column, pad: int) -> Column:
    """Leading pads moved to the end; masked positions count as pads."""
    filled = F.transform(ids, lambda x: F.when(x == IGNORE, pad).otherwise(x))
    lead = F.array_min(F.transform(filled, lambda x, i: F.when(x != pad, i)))
    rotated = F.concat(F.slice(filled, lead + 1, F.size(filled)), F.slice(filled, F.lit(1), lead))
    return F.when(lead.isNull(), filled).otherwise(rotated)
