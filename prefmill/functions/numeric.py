"""Numeric expressions shared by encoders, losses and reports."""

from pyspark.sql import Column, functions as F

IGNORE = -100


def let(value: Column, body) -> Column:
    """body(value) with the value computed once; plain nesting would compute it again for every array element."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def r6(value: Column) -> Column:
    """Round to six decimals; adds 0.0 so that a negative zero does not survive."""
    return F.round(value, 6) + F.lit(0.0)


def log_sigmoid(x: Column) -> Column:
    """log(1/(1+e^-x)) without overflow for large |x|."""
    return F.least(x, F.lit(0.0)) - F.log1p(F.exp(-F.abs(x)))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def log_sum_exp(xs: Column) -> Column:
    """log of the sum of exponentials over an array of doubles."""
    return let(F.array_max(xs), lambda top: top + F.log(F.aggregate(xs, F.lit(0.0), lambda a, x: a + F.exp(x - top))))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def fit_lengths(source: Column, target: Column, cutoff: Column) -> tuple[Column, Column]:
    """Lengths kept of a prompt and a response that share ``cutoff`` positions.

    A short response (under half the budget) is kept whole and the prompt pays; a short prompt is kept whole and the
    response pays; otherwise both are cut in proportion.
    """
    share = F.floor(cutoff * (target / (source + target))).cast("int")
    room = F.when(target * 2 < cutoff, cutoff).when(source * 2 < cutoff, cutoff - source).otherwise(share)
    kept_target = F.least(room, target)
    kept_source = F.least(F.greatest(cutoff - kept_target, F.lit(0)), source)
    return kept_source, kept_target
