"""The calls a job uses. Everything takes and returns DataFrames."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from prefmill.operators import encode as _encode, losses as _losses, packing as _packing, subspace
from prefmill.operators.align import align
from prefmill.operators.logps import logps_avg, pair_logps, seq_logps, seq_logps_ld
from prefmill.operators.mixing import mix, split
from prefmill.operators.ngrams import bleu4, rouge_l, rouge_n
from prefmill.operators.render import render_chat, render_oneturn, render_pairs, render_turns
from prefmill.operators.rewards import pref_rewards
from prefmill.operators.templates import register_template, template, template_table
from prefmill.operators.tokens import Subwords, char_ids, encode_tokens, vocab_build, with_specials
from prefmill.sources.files import load_spec, prepared
from prefmill.sources.registry import DatasetSpec, resolve
from prefmill.streaming import jobs as streaming

__all__ = ["DatasetSpec", "Subwords", "align", "char_ids", "encode", "encode_tokens", "evaluate", "load", "logps", "losses", "mix",
           "pack", "pad", "prepared", "register_template", "render", "render_chat", "render_oneturn", "render_pairs",
           "render_turns", "resolve", "rewards", "split", "streaming", "subspace", "table_losses", "template",
           "template_table", "vocab_build", "with_specials", "with_supervised_term"]

METRICS = {"bleu-4": bleu4, "rouge-1": lambda p, r: rouge_n(p, r, 1), "rouge-2": lambda p, r: rouge_n(p, r, 2), "rouge-l": rouge_l}


def load(spark: SparkSession, spec: DatasetSpec, folder: str, **options) -> DataFrame:
    """Rows of a registered dataset, sampled as its spec says."""
    return load_spec(spark, spec, folder, **options)


def render(df: DataFrame, name: str, messages: str = "messages", system: str = "system", tools: str | None = None) -> DataFrame:
    """Adds ``turns`` (one text per message) and ``text``."""
    turns = render_turns(F.col(messages), F.col(system), template(name), F.col(tools) if tools else None, name)
    return df.withColumn("turns", turns).withColumn("text", F.array_join("turns", ""))


def encode(aligned: DataFrame, stage: str, name: str, key: str, tokenize=char_ids, cutoff: int = 2048, **options) -> DataFrame:
    """Hub rows to ids and labels for a stage: pt, sft, rm, kto or ppo."""
    if stage == "pt":
        rows = aligned.select(key, F.col("_prompt")[0]["content"].alias("text"))
        return _encode.encode_pretrain(rows, "text", cutoff, [key], tokenize, **options)
    if stage == "kto":
        return _encode.encode_feedback(aligned, name, key, cutoff, tokenize=tokenize, **options)
    run = {"sft": _encode.encode_sft, "rm": _encode.encode_pairwise, "ppo": _encode.encode_prompt_only}[stage]
    return run(aligned, name, cutoff, [key], tokenize, **options)


def pack(encoded: DataFrame, key: str, cutoff: int, neat: bool = False, batch: int = _packing.BATCH) -> DataFrame:
    """Supervised rows packed into rows of ``cutoff`` positions. One position is kept free in every bin."""
    lengths = encoded.select(key, F.size("input_ids").cast("bigint").alias("length"))
    plan = _packing.pack_knapsack(lengths, key, cutoff - 1, batch)
    return _packing.pack_materialise(encoded, plan, key, cutoff - 1, neat)


def pad(encoded: DataFrame, key: str, batch: int, multiple: int = 8) -> DataFrame:
    return _packing.pad_batch(_packing.batched(encoded, key, batch), multiple=multiple)


def logps(tokens: DataFrame, alpha: float | None = None) -> DataFrame:
    """Sequence sums, counts and means; with ``alpha`` positions past the shorter side weigh less."""
    return logps_avg(seq_logps(tokens) if alpha is None else seq_logps_ld(tokens, alpha))


def rewards(pairs: DataFrame, beta: float = 0.1, reference: bool = True, wrap=None) -> DataFrame:
    """Adds chosen_reward and rejected_reward. ``wrap`` (Column, side) -> Column may change a reward, such as a penalty."""
    chosen, rejected = pref_rewards(beta, reference)
    if wrap is not None:
        chosen, rejected = wrap(chosen, "chosen"), wrap(rejected, "rejected")
    return pairs.withColumn("chosen_reward", chosen).withColumn("rejected_reward", rejected)


def losses(sequences: DataFrame, kind: str, beta: float = 0.1, **options) -> DataFrame:
    """example_id, ..., loss. ipo, orpo and simpo use mean log-probabilities, the others sums."""
    table = {"sigmoid": _losses.loss_sigmoid, "hinge": _losses.loss_hinge, "ipo": _losses.loss_ipo, "orpo": _losses.loss_orpo,
             "simpo": _losses.loss_simpo}
    if kind not in table:
        raise ValueError(f"unknown loss {kind}")
    averaged = kind in ("ipo", "orpo", "simpo")
    pairs = pair_logps(logps_avg(sequences), "logps_avg" if averaged else "logps")
    return pairs.withColumn("loss", table[kind](beta, **options))


def table_losses(rows: DataFrame, kind: str, **options) -> DataFrame:
    """Losses over other tables than pairs of log-probabilities; each function tells the columns it reads."""
    table = {"kto_pair": _losses.loss_kto_pair, "kto": _losses.loss_kto, "bco": _losses.loss_bco, "rm": _losses.loss_rm,
             "dft": _losses.loss_dft, "asft": _losses.loss_asft, "eaft": _losses.loss_eaft}
    if kind not in table:
        raise ValueError(f"unknown loss {kind}")
    return table[kind](rows, **options)


def with_supervised_term(losses_table: DataFrame, chosen_avg: Column, gamma: float) -> DataFrame:
    """The loss plus the weighted negative mean log-probability of the chosen answer."""
    return losses_table.withColumn("loss", _losses.loss_ftx(F.col("loss"), chosen_avg, gamma))


def evaluate(rows: DataFrame, predict: str = "predict", label: str = "label", metrics: dict | None = None) -> DataFrame:
    """Adds a column for each metric, a function (predict, label) -> Column; BLEU-4 and ROUGE unless others are given."""
    return rows.withColumns({name: fn(F.col(predict), F.col(label)) for name, fn in (METRICS if metrics is None else metrics).items()})
