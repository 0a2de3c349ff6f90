"""Dense row numbers without a single-partition window.

Both helpers number rows 0..n-1 inside each group. A group may hold any share of the table: its rows are spread over
many partitions and only one small row per (partition, group) is summed to get the offsets.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from prefmill.functions.hashing import SPACE, keyed
from prefmill.session import settled


def row_hash(df: DataFrame) -> Column:
    """A hash of the whole row, to order rows with equal keys. Maps are left out, as they have no order."""
    return F.xxhash64(*[F.col(f"`{n}`") for n, t in df.dtypes if "map<" not in t])


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where null equals null; the columns of ``left``, then those of ``right`` without the keys."""
    renamed = right.select(*[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    match = F.lit(True)
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"_key_{i}"))
    return left.join(renamed, match, how).drop(*[f"_key_{i}" for i in range(len(keys))])


def _offsets(spans: DataFrame, slot: str, group: list[str]) -> DataFrame:
    # One row per (slot, group); a group's rows here are at most the number of slots, never the number of data rows.
    before = Window.partitionBy(*group).orderBy(slot).rowsBetween(Window.unboundedPreceding, -1)
    return (spans.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
            .withColumn("_span_total", F.sum("_n").over(Window.partitionBy(*group))))


def ordered_index(df: DataFrame, order: list[str], group: list[str] = (), name: str = "idx",
                  total: str | None = None) -> DataFrame:
    """Number rows by ``order`` inside each group. Every row keeps its columns and gets one number: nulls come first, equal
    keys follow each other by a hash of the row, and rows with equal keys are spread over partitions.

    Rows are range partitioned, sorted and written once; nothing is joined back, so no row is lost or multiplied.
    """
    group, order = list(group), list(order)
    keys = [*group, *order]
    ranged = df.withColumn("_tie", row_hash(df)).repartitionByRange(*keys, "_tie").sortWithinPartitions(*keys, "_tie").drop("_tie")
    ranged = settled(ranged.withColumn("_at", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_slot", F.shiftright("_at", 33)).withColumn("_pos", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    spans = ranged.groupBy("_slot", *group).agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_start"))
    marked = null_safe(ranged, _offsets(spans, "_slot", group), ["_slot", *group])
    marked = marked.withColumn(name, F.col("_pos") - F.col("_start") + F.col("_before"))
    if total:
        marked = marked.withColumn(total, F.col("_span_total"))
    return marked.select(*df.columns, name, *([total] if total else []))


def bucketed_index(df: DataFrame, bucket: Column, order: list, group: list[str] = (), name: str = "idx",
                   total: str | None = None) -> DataFrame:
    """Number rows by ``order`` when ``bucket`` is a deterministic expression that never decreases along the order.

    Nothing is written: bucket sizes are counted in one pass and rows are ranked inside their bucket.
    """
    group = list(group)
    placed = df.withColumn("_slot", bucket)
    spans = placed.groupBy("_slot", *group).agg(F.count(F.lit(1)).alias("_n"))
    inner = Window.partitionBy("_slot", *group).orderBy(*order)
    out = (null_safe(placed.withColumn("_pos", F.row_number().over(inner) - 1), _offsets(spans, "_slot", group), ["_slot", *group])
           .withColumn(name, (F.col("_pos") + F.col("_before")).cast("bigint")))
    if total:
        out = out.withColumn(total, F.col("_span_total"))
    return out.drop("_slot", "_pos", "_n", "_before", "_span_total")


def shuffled_index(df: DataFrame, ids: list[str], seed, group: list[str] = (), name: str = "idx",
                   total: str | None = None, buckets: int | None = None) -> DataFrame:
    """A seeded permutation: position of each row in the order of hash(seed, ids), ties by id.

    The hash is uniform, so equal slices of its range are equal buckets whatever the key distribution is.
    """
    buckets = buckets or 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashed = df.withColumn("_hash", keyed(seed, *ids))
    slot = F.floor(F.col("_hash") * buckets / SPACE).cast("int")
    return bucketed_index(hashed, slot, ["_hash", *ids], group, name, total).drop("_hash")


def sized_buckets(df: DataFrame, rows: int) -> int:
    """Bucket width for positions 0..rows-1 so that there are a few buckets per shuffle partition."""
    slots = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-rows // slots))
