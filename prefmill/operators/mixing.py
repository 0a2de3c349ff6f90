"""Mixing member tables into one ordered table, and splitting off validation rows.

Members come as one DataFrame with a member number ``ds`` (0..k-1), an ``id`` that orders the member, and any other
columns. The result has a dense ``pos``. Rows are numbered inside their member first, so repeated and null ids are rows
like others; the plan of positions is made from (ds, rn) alone and wide columns are joined at the end.
"""

import math
from itertools import accumulate

from pyspark.sql import DataFrame, functions as F

from prefmill.functions.hashing import uniform
from prefmill.operators import joins
from prefmill.operators.rowindex import bucketed_index, ordered_index, shuffled_index, sized_buckets

CHUNK = 4096
SEARCH = 4096


def sizes_of(members: DataFrame) -> dict[int, int]:
    """Rows per member; one number per dataset reaches the driver."""
    return {r["ds"]: r["n"] for r in members.groupBy("ds").agg(F.count(F.lit(1)).alias("n")).collect()}


def _indexed(members: DataFrame) -> DataFrame:
    return ordered_index(members, ["id"], group=["ds"], name="rn")  # written there, once


def _by_member(values: dict) -> F.Column:
    return F.element_at(F.create_map(*[F.lit(x) for d, v in values.items() for x in (d, v)]), F.col("ds"))


def _use(uses: DataFrame, rows: DataFrame, keys: list[str], repeats: dict[int, int], tell: str) -> DataFrame:
    """Join on keys that include ds; ``repeats`` tells how often a row of each member is used."""
    if max(repeats.values()) <= joins.PER_COPY:
        return uses.join(rows, keys)
    return joins.join_repeated(uses, rows, keys, _by_member(repeats), [tell])


def _attach(placed: DataFrame, members: DataFrame, repeats: dict[int, int] | None = None) -> DataFrame:
    """Wide columns for (ds, rn, pos)."""
    return _use(placed, members, ["ds", "rn"], repeats or {0: 1}, "pos").drop("rn")


def mix_concat(members: DataFrame) -> DataFrame:
    return ordered_index(members, ["ds", "id"], name="pos")


def mix_interleave(members: DataFrame, stop: str) -> DataFrame:
    """Round robin. ``under`` ends with the shortest member, ``over`` with the longest (shorter ones start again),
    ``once`` takes every row exactly once."""
    sizes = sizes_of(members)
    order = sorted(sizes)
    rank = {d: i for i, d in enumerate(order)}
    indexed = _indexed(members)
    place = _by_member(rank)
    if stop == "under":
        kept = indexed.filter(F.col("rn") < min(sizes.values()))
        return _attach(kept.select("ds", "rn", (F.col("rn") * len(order) + place).alias("pos")), indexed)
    if stop == "once":
        # Rows before (rn, ds) in round-robin order: every member gives min(its size, rows it had a turn for).
        before = sum((F.least(F.lit(sizes[d]), F.col("rn") + F.when(F.lit(rank[d]) < place, 1).otherwise(0)) for d in order), F.lit(0))
        return _attach(indexed.select("ds", "rn", before.cast("bigint").alias("pos")), indexed)
    if stop == "over":
        longest = max(sizes.values())
        turns = repeat_to(indexed.select("ds", "rn"), sizes, longest)
        return _attach(turns.select("ds", "rn", (F.col("turn") * len(order) + place).alias("pos")), indexed,
                       {d: -(-longest // n) for d, n in sizes.items()})
    raise ValueError(f"unknown stop rule {stop}")


def repeat_to(indexed: DataFrame, sizes: dict[int, int], length: int) -> DataFrame:
    """Adds ``turn``: rn, rn+n, rn+2n, ... below ``length``. Long repeats are cut into chunks that are spread over the
    cluster before they are expanded, so one row of a tiny member does not expand in one task."""
    size = _by_member(sizes).cast("bigint")
    sized = indexed.withColumn("_n", size).filter(F.col("rn") < length)
    stride = F.col("_n") * CHUNK
    chunks = sized.withColumn("_from", F.explode(F.sequence(F.col("rn"), F.lit(length - 1).cast("bigint"), stride)))
    if length > CHUNK * min(sizes.values()):
        chunks = chunks.repartition("ds", "rn", "_from")
    last = F.least(F.col("_from") + stride - F.col("_n"), F.lit(length - 1))
    return chunks.withColumn("turn", F.explode(F.sequence(F.col("_from"), last, F.col("_n")))).drop("_from", "_n")


def last_draws(drawn, sizes: dict[int, int], probs: dict[int, float]) -> dict[int, int]:
    """Position of each member's draw number n, by counting draws in ever narrower ranges of positions. At most SEARCH
    counts per member reach the driver at a time."""
    horizon = 2 * math.ceil(max(sizes[d] / probs[d] for d in sizes)) + 16
    while True:
        width = -(-horizon // SEARCH)
        counts = drawn(0, horizon).groupBy("ds", F.floor(F.col("at") / width).alias("slot")).count().collect()
        per = {d: sorted((r["slot"], r["count"]) for r in counts if r["ds"] == d) for d in sizes}
        if all(sum(n for _, n in per[d]) >= sizes[d] for d in sizes):
            break
        horizon *= 2
    ends = {}
    for d, target in sizes.items():
        lo, span, left, found = 0, width, target, per[d]
        while True:
            for slot, n in found:
                if n >= left:
                    break
                left -= n
            lo += slot * span
            if span == 1:
                break
            top, span = lo + span, -(-span // SEARCH)
            inner = drawn(lo, top).filter(F.col("ds") == d)
            found = sorted(tuple(r) for r in inner.groupBy(F.floor((F.col("at") - lo) / span)).count().collect())
        ends[d] = lo
    return ends


def mix_interleave_prob(members: DataFrame, probs: dict[int, float], stop: str, seed=0) -> DataFrame:
    """Each position draws a member by its probability; the j-th draw of a member gives its row j mod n.

    ``under`` stops at the position where the first member is used up, ``over`` where the last one is, ``once`` keeps
    each row at its member's first pass and closes the gaps.
    """
    if abs(sum(probs.values()) - 1) > 1e-9:
        raise ValueError("probabilities must sum to 1")
    sizes = sizes_of(members)
    order = sorted(sizes)

    def drawn(start: int, stop_at: int) -> DataFrame:
        # Member d is drawn for u in [cum(d-1), cum(d)); positions are generated, so any range of them is cheap.
        u, pick = uniform(seed, F.lit("pos"), F.col("id")), F.lit(order[-1])
        for d, edge in reversed(list(zip(order[:-1], accumulate(probs[x] for x in order)))):
            pick = F.when(u < edge, d).otherwise(pick)
        return members.sparkSession.range(start, stop_at).select(F.col("id").alias("at"), pick.cast("int").alias("ds"))

    ends = last_draws(drawn, sizes, probs)
    cut = min(ends.values()) if stop == "under" else max(ends.values())
    width = sized_buckets(members, cut + 1)
    slot = F.floor(F.col("at") / width)
    numbered = bucketed_index(drawn(0, cut + 1), slot, ["at"], group=["ds"], name="turn")
    size = _by_member(sizes)
    indexed = _indexed(members)
    if stop == "once":
        kept = numbered.filter(F.col("turn") < size).withColumnRenamed("turn", "rn")
        closed = bucketed_index(kept.select("ds", "rn", "at"), slot, ["at"], name="pos")
        return _attach(closed.select("ds", "rn", "pos"), indexed)
    kept = numbered.withColumn("rn", F.col("turn") % size)
    # Rows of a member much smaller than the mix are used often, so they are dealt over copies.
    repeats = {d: math.ceil((cut + 1) * probs[d] / sizes[d]) for d in order}
    return _attach(kept.select("ds", "rn", F.col("at").alias("pos")), indexed, repeats)


def mix(members: DataFrame, strategy: str, probs: dict[int, float] | None = None, seed=0) -> DataFrame:
    if strategy == "concat":
        return mix_concat(members)
    if not strategy.startswith("interleave_"):
        raise ValueError(f"unknown mixing strategy {strategy}")
    stop = strategy.removeprefix("interleave_")
    return mix_interleave_prob(members, probs, stop, seed) if probs else mix_interleave(members, stop)


# ---- splitting ------------------------------------------------------------------------------------------------------

def split(df: DataFrame, key: str, val_size: float, seed=0) -> DataFrame:
    """Adds ``split``: ``validation`` for the first rows of a hashed order, else ``train``. A size above 1 is a row
    count, below 1 a share (rounded up)."""
    order = shuffled_index(df, [key], seed, total="_total")
    held = F.lit(int(val_size)) if val_size > 1 else F.ceil(F.col("_total") * val_size)
    marked = order.withColumn("split", F.when(F.col("idx") < held, "validation").otherwise("train"))
    return marked.drop("_total")


def split_named(train: DataFrame, evals: dict[str, DataFrame] | None = None, val_size: float = 0.0) -> DataFrame:
    """Training rows and named evaluation sets as one table with ``split`` = train or validation_<name>."""
    if evals and val_size > 1e-6:
        raise ValueError("val_size and evaluation sets exclude each other")
    out = train.withColumn("split", F.lit("train"))
    for name, df in (evals or {}).items():
        out = out.unionByName(df.withColumn("split", F.lit(f"validation_{name}")))
    return out


def evaluation_sets(df: DataFrame) -> DataFrame:
    """Evaluation rows with their set name; a plain ``validation`` split keeps that name."""
    return df.filter(F.col("split").startswith("validation")).withColumn(
        "name", F.when(F.col("split") == "validation", "validation").otherwise(F.regexp_replace("split", "^validation_", "")))
