"""Joins of predictions, labels and baselines by key, and joins in which rows are used many times."""

from pyspark.sql import Column, DataFrame, functions as F

from prefmill.operators.rowindex import ordered_index
from prefmill.session import settled


PER_COPY = 10_000  # uses that one copy of a row serves


def join_repeated(uses: DataFrame, rows: DataFrame, keys: list[str], per_row: Column | int, tell: list[str]) -> DataFrame:
    """Join where each of ``rows`` is used about ``per_row`` times (a number, or a column both sides can compute).

    A row used very often would be one hot key, so it is copied, and its uses are dealt over the copies by a hash of
    ``tell``, columns that differ between uses.
    """
    if isinstance(per_row, int):
        if per_row <= PER_COPY:
            return uses.join(rows, keys)
        per_row = F.lit(per_row)
    copies = F.greatest(F.ceil(per_row / PER_COPY), F.lit(1)).cast("bigint")
    dealt = uses.withColumn("_copy", F.pmod(F.xxhash64(*tell), copies))
    shelf = rows.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("bigint"), copies - 1)))
    return dealt.join(shelf, [*keys, "_copy"]).drop("_copy")


#: Keys that are counted as hot at most; any other key then holds less than one in so many uses.
MOST_HOT = 1 << 18


def join_measured(uses: DataFrame, rows: DataFrame, keys: list[str], tell: list[str], per_copy: int = PER_COPY, how: str = "left") -> DataFrame:
    """Join where nobody knows how often each of ``rows`` (one per key) is used: the uses are counted first.

    A key with more than ``per_copy`` uses gets a copy of its row for every ``per_copy`` of them, and the uses are dealt
    over the copies by a hash of ``tell``, columns that differ between uses. The heavy keys are a small table of known
    size that every task can hold; all other keys are joined as they are.
    """
    counts = uses.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > per_copy)
    heavy = F.broadcast(settled(counts.orderBy(F.desc("_n"), *keys).limit(MOST_HOT).select(*keys, F.ceil(F.col("_n") / per_copy).alias("_copies"))))
    copies = F.coalesce("_copies", F.lit(1).cast("bigint"))
    dealt = uses.join(heavy, keys, "left").withColumn("_copy", F.pmod(F.xxhash64(*tell), copies)).drop("_copies")
    shelf = rows.join(heavy, keys, "left").withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("bigint"), copies - 1))).drop("_copies")
    return dealt.join(shelf, [*keys, "_copy"], how).drop("_copy")


def join_pred_label(predictions: DataFrame, labels: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(predictions with their prompt and label, predictions without one)."""
    return predictions.join(labels, key), predictions.join(labels, key, "left_anti")


def join_baseline(baseline: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """Baseline answer i against new answer i, both numbered by their own key order."""
    left = ordered_index(baseline, [key]).drop(key)
    right = ordered_index(answers, [key]).drop(key)
    return right.join(left, "idx")
