"""Sampling, row selection and sharding. Randomness is a hash of (seed, id); order is an explicit key."""

import os

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegralType, StringType

from prefmill.functions.hashing import draw60
from prefmill.operators.joins import join_repeated
from prefmill.operators.rowindex import ordered_index, shuffled_index


def draws(spark, count: int, size: int, seed, start: int = 0) -> DataFrame:
    """draw, idx: ``count`` draws with replacement of positions 0..size-1."""
    return spark.range(start, start + count).select(
        F.col("id").alias("draw"), (draw60(seed, F.lit("draw"), F.col("id")) % size).alias("idx"))


def sample_num(df: DataFrame, key: str, target: int, seed=0, size: int | None = None) -> DataFrame:
    """``target`` rows in random order (``draw`` is the position): a permutation without replacement, topped up with
    replacement when more rows are asked for than there are."""
    size = df.count() if size is None else size
    order = shuffled_index(df, [key], seed, name="idx")
    first = order.filter(F.col("idx") < min(target, size)).withColumnRenamed("idx", "draw")
    if target > size > 0:
        more = join_repeated(draws(df.sparkSession, target - size, size, seed, start=size), order, ["idx"], -(-target // size), ["draw"])
        first = first.unionByName(more.select(*df.columns, "draw"))
    return first


def first_n(df: DataFrame, key: str, count: int) -> DataFrame:
    """The first ``count`` rows by key, nulls first. The key at the edge is looked up (``key_at``; other kinds of keys are
    sorted alone), and of the rows that share it as many as are needed are taken by a hash of the row."""
    if count <= 0:
        return df.limit(0)
    column = F.col(key)
    if isinstance(df.schema[key].dataType, (IntegralType, StringType)):
        found = key_at(df, key, count - 1)
        if found is None:
            return df
        edge, start = found
    else:
        numbered = ordered_index(df.select(key), [key])
        row = numbered.filter(F.col("idx") == count - 1).first()
        if row is None:
            return df
        edge = row[key]
        start = numbered.filter(column.eqNullSafe(F.lit(edge).cast(df.schema[key].dataType))).agg(F.min("idx")).first()[0]
    at = F.lit(edge).cast(df.schema[key].dataType)
    below = column.isNull() | (column < at) if edge is not None else F.lit(False)
    ties = ordered_index(df.filter(column.eqNullSafe(at)), [key]).filter(F.col("idx") < count - start).drop("idx")
    return df.filter(below).unionByName(ties)


def sample_max(df: DataFrame, key: str, limit: int) -> DataFrame:
    """The first ``limit`` rows by key, or all of them."""
    return first_n(df, key, limit)


def sample_weighted(df: DataFrame, key: str, size: int | None, weight: float | None, seed=0) -> DataFrame:
    """``size`` draws with replacement, then int(n * weight) draws with replacement of the result."""
    spark = df.sparkSession
    picked = ordered_index(df, [key])
    count = df.count()
    for wanted, name in ((size, "size"), (weight, "weight")):
        if wanted is not None:
            drawn = wanted if name == "size" else int(count * wanted)
            picked = join_repeated(draws(spark, drawn, count, f"{seed}:{name}"), picked, ["idx"], -(-drawn // max(count, 1)), ["draw"])
            picked = picked.select(*df.columns, F.col("draw").alias("idx"))
            count = drawn
    return picked


def select_slice(df: DataFrame, key: str, start: int | None, stop: int | None, step: int = 1) -> DataFrame:
    """Rows at positions start, start+step, ... before stop, with Python slice rules; ``out`` is the new position."""
    first, last, step = slice(start, stop, step).indices(df.count())
    indexed = ordered_index(df, [key])
    steps = (F.col("idx") - first) / step
    inside = (F.col("idx") < last) & (F.col("idx") >= first) if step > 0 else (F.col("idx") > last) & (F.col("idx") <= first)
    return indexed.filter(inside & ((F.col("idx") - first) % step == 0)).withColumn("out", steps.cast("bigint"))


def select_rows(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows at the positions listed in ``wanted`` (out, idx); order and repeats are kept, negative positions count from
    the end."""
    size = df.count()
    places = wanted.withColumn("idx", F.when(F.col("idx") < 0, F.col("idx") + size).otherwise(F.col("idx")))
    return places.join(ordered_index(df, [key]), "idx")


BUCKETS = 4096


def key_at(df: DataFrame, key: str, position: int) -> tuple[object, int] | None:
    """(key, rows before it) of the row at ``position`` by key, nulls first; None beyond the last row.

    For integers the range between the smallest and the largest key is counted in ``BUCKETS`` slices, and the slice that
    holds the position again, until one key is left: a handful of scans of the key column, with the bounds pushed down. For
    texts the slices are the next two signs after the prefix that all remaining keys share. Nothing is sorted.
    """
    kind, column = df.schema[key].dataType, F.col(key)
    head = df.agg(F.count(F.lit(1)), F.count(key)).first()
    if not 0 <= position < head[0]:
        return None
    below = head[0] - head[1]
    if position < below:
        return None, 0
    rows = df.select(key).filter(column.isNotNull())
    while True:
        low, high = rows.agg(F.min(key), F.max(key)).first()
        if low == high:
            return low, below
        if isinstance(kind, StringType):
            shared = os.path.commonprefix([low, high])
            slice_ = F.substring(key, len(shared) + 1, 2)
        else:
            width = (high - low) // BUCKETS + 1
            slice_ = F.expr(f"(cast(`{key}` AS decimal(38,0)) - cast('{low}' AS decimal(38,0))) div {width}")  # whole numbers, never rounded
        counts = rows.groupBy(slice_.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()
        for at, n in sorted(counts, key=lambda r: r["s"]):
            if position < below + n:
                break
            below += n
        if isinstance(kind, StringType):
            start = shared + at
            rows = rows.filter(column == start if len(at) < 2 else column.startswith(start))
        else:
            rows = rows.filter((column >= low + at * width) & (column <= low + (at + 1) * width - 1 if low + (at + 1) * width - 1 < high else column <= high))


def preview_page(df: DataFrame, key: str, page: int, size: int = 2) -> DataFrame:
    """Rows of one page with the total row count. For integer and text keys the keys at the page's ends are looked up, and only
    rows between them are read and numbered; other keys number the whole table."""
    first, total = page * size, df.count()
    if not isinstance(df.schema[key].dataType, (IntegralType, StringType)):
        indexed = ordered_index(df, [key], total="total")
        return indexed.filter((F.col("idx") >= first) & (F.col("idx") < first + size))
    low, high = key_at(df, key, first), key_at(df, key, min(first + size, total) - 1)
    if low is None or high is None:
        return df.limit(0).withColumns({"idx": F.lit(0).cast("bigint"), "total": F.lit(total).cast("bigint")})
    column = F.col(key)
    inside = column.isNull() if high[0] is None else column <= high[0]
    if high[0] is not None:
        inside = inside | column.isNull() if low[0] is None else inside & (column >= low[0])
    near = ordered_index(df.filter(inside), [key]).withColumn("idx", F.col("idx") + low[1])
    return near.filter((F.col("idx") >= first) & (F.col("idx") < first + size)).withColumn("total", F.lit(total).cast("bigint"))


def shard_replica(df: DataFrame, key: str, world: int, seed=0) -> DataFrame:
    """Rows in shuffled order striped over ``world`` replicas; the incomplete last stripe is dropped."""
    order = shuffled_index(df, [key], seed, total="_total")
    even = order.filter(F.col("idx") < F.floor(F.col("_total") / world) * world).drop("_total")
    return even.withColumn("replica", F.col("idx") % world)


def contiguous_shards(df: DataFrame, key: str, world: int) -> DataFrame:
    """Shard r holds positions r*ceil(n/world) .. (r+1)*ceil(n/world)-1."""
    indexed = ordered_index(df, [key], total="_total")
    width = F.ceil(F.col("_total") / world)
    return indexed.withColumn("shard", F.floor(F.col("idx") / width).cast("int")).drop("_total")


def skip_n(df: DataFrame, key: str, count: int) -> DataFrame:
    """All rows but the first ``count`` by key."""
    return ordered_index(df, [key]).filter(F.col("idx") >= count).drop("idx")
