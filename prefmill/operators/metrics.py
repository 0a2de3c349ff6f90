"""Corpus statistics and training metrics."""

from pyspark.sql import DataFrame, Window, functions as F

from prefmill.functions.numeric import IGNORE

BASE_LR = 3e-4  # fixed values: reference learning rate and its batch in tokens
BASE_TOKENS = 4_000_000


def valid_count(labels):
    return F.size(F.filter(labels, lambda x: x != IGNORE))


def valid_tokens(encoded: DataFrame, batch: str) -> DataFrame:
    return encoded.groupBy(batch).agg(F.sum(valid_count(F.col("labels")).cast("bigint")).alias("valid"))


def length_cdf(lengths: DataFrame, interval: int) -> DataFrame:
    """bin, n, total, percent: rows shorter than bin + interval. The running sum runs over the bins, whose number is
    bounded by the longest row, not by the rows."""
    bins = lengths.groupBy((F.floor(F.col("length") / interval) * interval).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    run = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("n").over(run)
    return bins.select("bin", "n", total.alias("total"), (total / F.sum("n").over(whole) * 100).alias("percent"))


def valid_ratio(encoded: DataFrame, batch: str) -> DataFrame:
    """One row: valid label tokens, padded label cells and their ratio. Sizes are combined before the shuffle."""
    per = encoded.groupBy(batch).agg(F.sum(valid_count(F.col("labels")).cast("bigint")).alias("valid"),
                                     (F.max(F.size("labels")).cast("bigint") * F.count(F.lit(1))).alias("cells"))
    out = per.agg(F.sum("valid").alias("valid"), F.sum("cells").alias("cells"))
    return out.withColumn("ratio", F.col("valid") / F.col("cells"))


def suggest_lr(ratio: DataFrame, cutoff: int, batch_size: int, small: bool = False) -> DataFrame:
    """Learning rate by the square root of the effective token batch; ``small`` divides it by six."""
    tokens = F.col("ratio") * (cutoff * batch_size)
    rate = F.lit(BASE_LR) * F.sqrt(tokens / BASE_TOKENS) / (6.0 if small else 1.0)
    return ratio.withColumn("token_batch", tokens).withColumn("lr", rate)


def tokens_per_sec(encoded: DataFrame, columns: list[str], epochs: float, runtime: float, world: int = 1) -> DataFrame:
    """One row: tokens of the given id columns and tokens per second and worker."""
    tokens = sum((F.size(c) for c in columns), F.lit(0)).cast("bigint")
    out = encoded.agg(F.sum(tokens).alias("tokens"))
    return out.withColumn("tokens_per_sec", F.col("tokens") * epochs / runtime / world)
