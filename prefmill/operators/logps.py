"""Token log-probabilities (example_id, side, model, pos, label, logp) to sequence sums, pairs and perplexity.

Labels are those of the input row; a label is valid when it is not masked and is not at position 0, which nothing
predicts.
"""

from pyspark.sql import DataFrame, Window, functions as F

from prefmill.functions.numeric import IGNORE

SEQUENCE = ["example_id", "side", "model"]


def _valid():
    return (F.col("label") != IGNORE) & (F.col("pos") > 0)


def seq_logps(tokens: DataFrame, keys: list[str] = SEQUENCE) -> DataFrame:
    """logps and n per sequence; a sequence without valid labels keeps its row with 0 and 0."""
    return tokens.groupBy(*keys).agg(F.sum(F.when(_valid(), F.col("logp")).otherwise(0.0)).alias("logps"),
                                     F.sum(F.when(_valid(), 1).otherwise(0)).alias("n"))


def seq_logps_ld(tokens: DataFrame, alpha: float) -> DataFrame:
    """Like seq_logps, but positions past the shorter side's number of valid labels (counted from the first valid one)
    weigh ``alpha``. One shuffle: windows and sums share the placement by (example, model)."""
    pair = Window.partitionBy("example_id", "model")
    own = Window.partitionBy("example_id", "model", "side")
    counts = [F.sum(F.when(_valid() & (F.col("side") == s), 1).otherwise(0)).over(pair) for s in ("chosen", "rejected")]
    first = F.coalesce(F.min(F.when(_valid(), F.col("pos"))).over(own), F.lit(1))
    weighed = tokens.withColumn("_edge", first + F.least(*counts)).withColumn(
        "_w", F.when(F.col("pos") < F.col("_edge"), 1.0).otherwise(alpha))
    return weighed.groupBy("example_id", "model", "side").agg(
        F.sum(F.when(_valid(), F.col("logp") * F.col("_w")).otherwise(0.0)).alias("logps"),
        F.sum(F.when(_valid(), 1).otherwise(0)).alias("n"))


def logps_avg(sequences: DataFrame) -> DataFrame:
    """Adds logps_avg; null for a sequence without valid labels."""
    return sequences.withColumn("logps_avg", F.when(F.col("n") > 0, F.col("logps") / F.col("n")))


def pair_logps(sequences: DataFrame, value: str = "logps") -> DataFrame:
    """One row per example: pc, pr (policy chosen, rejected), rc, rr (reference), nc, nr (valid labels)."""
    def cell(side, model, name):
        return F.max(F.when((F.col("side") == side) & (F.col("model") == model), F.col(name)))
    return sequences.groupBy("example_id").agg(
        cell("chosen", "policy", value).alias("pc"), cell("rejected", "policy", value).alias("pr"),
        cell("chosen", "ref", value).alias("rc"), cell("rejected", "ref", value).alias("rr"),
        cell("chosen", "policy", "n").alias("nc"), cell("rejected", "policy", "n").alias("nr"))


def join_policy_ref(policy: DataFrame, reference: DataFrame) -> DataFrame:
    """Policy sums with the reference sums of the same example and side, computed once and reused."""
    ref = reference.select("example_id", "side", F.col("logps").alias("ref_logps"))
    return policy.join(ref, ["example_id", "side"])


def ppl(sequences: DataFrame) -> DataFrame:
    """Adds ppl = exp(mean negative log-probability); null without valid labels."""
    return sequences.withColumn("ppl", F.when(F.col("n") > 0, F.exp(-F.col("logps") / F.col("n"))))


def ppl_mean(perplexities: DataFrame) -> DataFrame:
    return perplexities.agg(F.avg("ppl").alias("mean_ppl"), F.count("ppl").alias("rows"),
                            F.sum(F.col("ppl").isNull().cast("bigint")).alias("without_labels"))


def ppl_by_dataset(sequences: DataFrame, dataset: str) -> DataFrame:
    """exp(token mean loss) per evaluation set; overflow gives infinity."""
    loss = -F.sum("logps") / F.sum("n")
    return sequences.groupBy(dataset).agg(loss.alias("loss"), F.exp(loss).alias("ppl"))
