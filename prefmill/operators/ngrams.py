"""Text overlap metrics between predictions and labels.

Tokens are runs of non-blank characters (BLEU: characters). ROUGE-N compares sets of n-grams, ROUGE-L the longest common
token subsequence. BLEU-4 replaces the k-th empty precision by 1 / (2^k * its denominator).
"""

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from prefmill.functions.numeric import let

EPS = 1e-8


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[^ \t\n\r\f]+"), F.lit(0))


ORDERS = (1, 2, 3, 4)


def _uses(text: Column, n: int) -> Column:
    """A text for each distinct gram of n signs: the gram, as many times as it is used."""
    grams = F.sort_array(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1)))
    return F.regexp_extract_all(F.array_join(grams, ""), F.lit(f"(?s)(.{{{n}}})\\1*+"), F.lit(0))


def matches(predict: Column, label: Column) -> Column:
    """Clipped character n-gram counts of the prediction for n = 1..4: how many uses of a gram find a use in the label.

    The uses of each gram, written out one after another, are sorted together for both texts. Grams have one length, so only
    the uses of the same gram in the other text begin with all of a text's uses: they follow it, and it is the shorter one.
    """
    def clipped(n):
        def shared(uses):
            return F.filter(uses, lambda x, i: F.get(uses, i + 1).startswith(x))
        both = let(F.sort_array(F.concat(_uses(predict, n), _uses(label, n))), shared)
        return (F.char_length(F.array_join(both, "")) / n).cast("int")
    return F.array(*[clipped(n) for n in ORDERS])


def bleu4(predict: Column, label: Column) -> Column:
    """Sentence BLEU-4 in percent, four decimals. A row is scored where it lies; nothing is shuffled, and both texts are worked
    out once, however they are made."""
    def score(z):
        found, mine, other = z["found"], z["mine"], z["other"]
        logs, misses = F.lit(0.0), F.lit(0)
        for n in ORDERS:
            hits, size = found[n - 1], F.greatest(mine - (n - 1), F.lit(1))
            misses = misses + F.when(hits == 0, 1).otherwise(0)
            logs = logs + 0.25 * F.log(F.when(hits == 0, 1 / (F.pow(F.lit(2.0), misses) * size)).otherwise(hits / size))
        brevity = F.when(mine > other, 1.0).otherwise(F.exp(1 - other / F.greatest(mine, F.lit(1))))
        return F.when((mine == 0) | (found[0] == 0), 0.0).otherwise(brevity * F.exp(logs))

    def counted(z):
        return let(F.struct(matches(z["p"], z["t"]).alias("found"), F.char_length(z["p"]).alias("mine"), F.char_length(z["t"]).alias("other")), score)
    return F.round(let(F.struct(predict.alias("p"), label.alias("t")), counted) * 100, 4)


def _runs(items: Column, n: int) -> Column:
    """Runs of n neighbours joined by blanks, by aligning n shifted copies of the list."""
    count = F.greatest(F.size(items) - n + 1, F.lit(0))
    out = F.slice(items, F.lit(1), count)
    for k in range(1, n):
        out = F.zip_with(out, F.slice(items, F.lit(k + 1), count), lambda a, b: F.concat(a, F.lit(" "), b))
    return out


def _f(hits: Column, predicted: Column, wanted: Column) -> Column:
    p, r = hits / F.greatest(predicted, F.lit(1)), hits / F.greatest(wanted, F.lit(1))
    return F.round(2 * (p * r / (p + r + EPS)) * 100, 4)


def rouge_n(predict: Column, label: Column, n: int) -> Column:
    """F score in percent over distinct n-grams; an empty side gives 0."""
    def score(z):
        return _f(F.size(F.array_intersect(z["a"], z["b"])), F.size(z["a"]), F.size(z["b"]))
    words = F.struct(tokens(predict).alias("a"), tokens(label).alias("b"))
    return let(words, lambda w: let(F.struct(F.array_distinct(_runs(w["a"], n)).alias("a"), F.array_distinct(_runs(w["b"], n)).alias("b")), score))


def common_length(a: list, b: list) -> int:
    """Length of the longest common subsequence, with one bit per position of ``a`` in an integer."""
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | (1 << i)
    mask = (1 << len(a)) - 1
    row = mask
    for x in b:
        hit = row & places.get(x, 0)
        row = ((row + hit) | (row - hit)) & mask
    return len(a) - row.bit_count()


@F.pandas_udf(T.IntegerType())
def _common(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([common_length(list(x), list(y)) for x, y in zip(a, b)], dtype="int32")


def rouge_l(predict: Column, label: Column) -> Column:
    """F score in percent over the longest common token subsequence."""
    a, b = tokens(predict), tokens(label)
    return _f(_common(a, b), F.size(a), F.size(b))


def metric_means(scores: DataFrame, metrics: list[str], runtime: float, steps: int) -> DataFrame:
    """One row: predict_<metric> means, samples and steps per second."""
    out = scores.agg(*[F.avg(m).alias(f"predict_{m}") for m in metrics], F.count(F.lit(1)).alias("samples"))
    return out.withColumn("predict_samples_per_second", F.round(F.col("samples") / runtime, 3)).withColumn(
        "predict_steps_per_second", F.round(F.lit(steps) / runtime, 3))
