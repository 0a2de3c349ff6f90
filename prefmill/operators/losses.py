"""Preference and token losses as column expressions and aggregates."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from prefmill.functions.numeric import IGNORE, let, log_sigmoid, log_sum_exp, sigmoid
from prefmill.operators.series import running_sums
from prefmill.session import settled


def _margin() -> Column:
    return (F.col("pc") - F.col("pr")) - (F.col("rc") - F.col("rr"))


def loss_sigmoid(beta: float = 0.1, smoothing: float = 0.0) -> Column:
    x = beta * _margin()
    return -log_sigmoid(x) * (1 - smoothing) - log_sigmoid(-x) * smoothing


def loss_hinge(beta: float = 0.1) -> Column:
    return F.greatest(1 - beta * _margin(), F.lit(0.0))


def loss_ipo(beta: float = 0.1) -> Column:
    """Over mean log-probabilities."""
    return F.pow(_margin() - 1 / (2 * beta), F.lit(2.0))


def loss_orpo(beta: float = 0.1) -> Column:
    """Over mean log-probabilities, without a reference."""
    c, r = F.col("pc"), F.col("pr")
    odds = (c - r) - (F.log1p(-F.exp(c)) - F.log1p(-F.exp(r)))
    return -c - beta * log_sigmoid(odds)


def loss_simpo(beta: float = 0.1, gamma: float = 0.5) -> Column:
    """Over mean log-probabilities, without a reference."""
    return -log_sigmoid(beta * (F.col("pc") - F.col("pr") - gamma / beta))


def loss_kto_pair(pairs: DataFrame, batch: str, beta: float = 0.1) -> DataFrame:
    """Mean loss per batch; each side is compared with the other side's mean log ratio, not below 0."""
    pairs = pairs.withColumn("_c", F.col("pc") - F.col("rc")).withColumn("_r", F.col("pr") - F.col("rr"))
    whole = Window.partitionBy(batch)
    kl_c, kl_r = [F.greatest(F.avg(x).over(whole), F.lit(0.0)) for x in ("_c", "_r")]
    rows = pairs.select(batch, (1 - sigmoid(beta * (F.col("_c") - kl_r))).alias("_lc"), (1 - sigmoid(beta * (kl_c - F.col("_r")))).alias("_lr"))
    return rows.groupBy(batch).agg((F.avg(F.col("_lc") + F.col("_lr")) / 2).alias("loss"))


def loss_kto(rows: DataFrame, batch: str, beta: float = 0.1, desirable: float = 1.0, undesirable: float = 1.0) -> DataFrame:
    """Rows (tag, logps, ref_logps, kl_logps, ref_kl_logps) to loss, reward and kl per row; kl is the batch mean of the
    mismatched log ratios, not below 0."""
    ratio = F.col("logps") - F.col("ref_logps")
    kl = F.greatest(F.avg(F.col("kl_logps") - F.col("ref_kl_logps")).over(Window.partitionBy(batch)), F.lit(0.0))
    rows = rows.withColumn("kl", kl)
    good = desirable * (1 - sigmoid(beta * (ratio - F.col("kl"))))
    bad = undesirable * (1 - sigmoid(beta * (F.col("kl") - ratio)))
    return rows.withColumn("reward", beta * ratio).withColumn("loss", F.when(F.col("tag"), good).otherwise(bad))


def loss_bco(pairs: DataFrame, index: str, batch_size: int, beta: float = 0.1, weight: float = 1.0,
             base: Column | None = None) -> DataFrame:
    """Adds delta and loss. Rows are numbered by ``index``; delta is the mean of the batch means up to and including the
    row's own batch. With a base loss the two are mixed as (base + weight * bco) / (1 + weight)."""
    c, r = beta * (F.col("pc") - F.col("rc")), beta * (F.col("pr") - F.col("rr"))
    rows = pairs.withColumn("batch", F.floor(F.col(index) / batch_size))
    means = settled(rows.groupBy("batch").agg((F.avg(c + r) / 2).alias("_mean")))
    sums = running_sums(means.withColumn("_one", F.lit(1.0)), [], "batch", ["_mean", "_one"])
    deltas = sums.select("batch", (F.col("_mean_sum") / F.col("_one_sum")).alias("delta"))
    joined = rows.join(deltas, "batch")
    bco = -log_sigmoid(c - F.col("delta")) - log_sigmoid(-(r - F.col("delta")))
    return joined.withColumn("loss", bco if base is None else (base + bco * weight) / (1 + weight))


def loss_ftx(loss: Column, chosen_avg: Column, gamma: float) -> Column:
    """Loss plus the weighted negative mean log-probability of the chosen answer."""
    return loss + gamma * -chosen_avg


def loss_rm(scores: DataFrame, key: str = "example_id") -> DataFrame:
    """Pairs from per-token scores (key, side, pos, score, mask): the score of the last unmasked position counts."""
    seen = F.when(F.col("mask") != 0, F.col("pos"))
    ends = scores.groupBy(key).agg(*[F.max_by(F.col("score"), F.when(F.col("side") == s, seen)).alias(s) for s in ("chosen", "rejected")])
    return ends.withColumn("loss", -log_sigmoid(F.col("chosen") - F.col("rejected")))


# ---- token losses over logits ---------------------------------------------------------------------------------------

def with_targets(logits: DataFrame) -> DataFrame:
    """Adds target: the label of the next position of the same example; rows without a valid target are dropped."""
    after = F.lead("label").over(Window.partitionBy("example_id").orderBy("pos"))
    return logits.withColumn("target", after).filter(F.col("target") != IGNORE)


def nll(logits: Column, target: Column) -> Column:
    return log_sum_exp(logits) - F.get(logits, target.cast("int"))


def loss_dft(logits: DataFrame) -> DataFrame:
    """One row: mean of nll * exp(-nll) over valid targets (0 when there is none)."""
    rows = with_targets(logits).select(nll(F.col("policy"), F.col("target")).alias("_n"))
    return rows.agg(F.coalesce(F.avg(F.col("_n") * F.exp(-F.col("_n"))), F.lit(0.0)).alias("loss"))


def kl_divergence(policy: Column, reference: Column) -> Column:
    """KL(reference || policy) of two logit vectors."""
    def total(z):
        cells = F.zip_with(policy, reference, lambda x, y: F.exp(y - z["q"]) * ((y - z["q"]) - (x - z["p"])))
        return F.aggregate(cells, F.lit(0.0), lambda a, x: a + x)
    return let(F.struct(log_sum_exp(policy).alias("p"), log_sum_exp(reference).alias("q")), total)


def loss_asft(logits: DataFrame, alpha: float = 0.1) -> DataFrame:
    """One row: loss_dft plus alpha times the mean divergence from the reference."""
    rows = with_targets(logits).select(nll(F.col("policy"), F.col("target")).alias("_n"),
                                       kl_divergence(F.col("policy"), F.col("ref")).alias("_k"))
    return rows.agg(F.avg(F.col("_n") * F.exp(-F.col("_n"))).alias("dft"), F.avg("_k").alias("kl")).withColumn(
        "loss", F.col("dft") + alpha * F.col("kl"))


def topk_logits(logits: Column, k: int = 20) -> Column:
    return F.slice(F.sort_array(logits, asc=False), 1, k)


def entropy(logits: Column) -> Column:
    return let(log_sum_exp(logits), lambda total: -F.aggregate(
        logits, F.lit(0.0), lambda a, x: a + F.exp(x - total) * (x - total)))


def loss_eaft(logits: DataFrame, alpha: float = 1.0, k: int = 20) -> DataFrame:
    """One row: mean of nll weighted by (entropy of the k largest logits / 3) ** alpha."""
    rows = with_targets(logits).select(nll(F.col("policy"), F.col("target")).alias("_n"), topk_logits(F.col("policy"), k).alias("_top"))
    rows = rows.select("_n", F.pow(entropy(F.col("_top")) / 3.0, F.lit(float(alpha))).alias("_w"))
    return rows.agg(F.coalesce(F.avg(F.col("_n") * F.col("_w")), F.lit(0.0)).alias("loss"))


def token_accuracy(logits: DataFrame) -> DataFrame:
    """One row: share of right most-likely tokens per example, averaged over examples."""
    best = F.array_position("policy", F.array_max("policy")) - 1
    per = with_targets(logits).groupBy("example_id").agg(F.avg((best == F.col("target")).cast("int")).alias("_a"))
    return per.agg(F.avg("_a").alias("accuracy"), F.count(F.lit(1)).alias("rows"))
