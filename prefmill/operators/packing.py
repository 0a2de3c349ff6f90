"""Packing encoded rows into fixed-size blocks, and batches. A batch is a run of consecutive rows, so every group that
meets in one task has a bounded number of rows however large the table is."""

from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from prefmill.functions.numeric import IGNORE, let
from prefmill.operators.rowindex import ordered_index, shuffled_index
from prefmill.operators.tokens import PAD

BATCH = 1000


def batched(df: DataFrame, key: str, batch: int = BATCH) -> DataFrame:
    """Adds idx (row position by key) and batch."""
    return ordered_index(df, [key]).withColumn("batch", F.floor(F.col("idx") / batch))


def _streamed(df: DataFrame, key: str, batch: int) -> DataFrame:
    order = Window.partitionBy("batch").orderBy("idx")
    whole = Window.partitionBy("batch")
    return (batched(df, key, batch).withColumn("_len", F.size("input_ids").cast("bigint"))
            .withColumn("_end", F.sum("_len").over(order.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("_all", F.sum("_len").over(whole)).withColumn("_start", F.col("_end") - F.col("_len")))


def pack_blocks(df: DataFrame, key: str, size: int, batch: int = BATCH, bos: int | None = None) -> DataFrame:
    """batch, block, input_ids: the token stream of each batch cut into blocks of ``size``; the tail is dropped.

    The arrays move once (to their batch); cutting and regrouping by (batch, block) stays on that placement.
    """
    rows = _streamed(df, key, batch).filter("_len > 0")
    last = F.floor((F.col("_end") - 1) / size)
    pieces = rows.withColumn("block", F.explode(F.sequence(F.floor(F.col("_start") / size), last)))
    lo = F.greatest(F.col("_start"), F.col("block") * size)
    hi = F.least(F.col("_end"), (F.col("block") + 1) * size)
    pieces = pieces.filter((F.col("block") + 1) * size <= F.col("_all")).select(
        "batch", "block", lo.alias("at"),
        F.slice("input_ids", (lo - F.col("_start") + 1).cast("int"), (hi - lo).cast("int")).alias("piece"))
    blocks = pieces.groupBy("batch", "block").agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("_p"))
    ids = F.flatten(F.transform("_p", lambda p: p["piece"]))
    if bos is not None:
        ids = F.concat(F.array(F.lit(bos)), F.slice(ids, F.lit(2), F.lit(size)))
    return blocks.select("batch", "block", ids.alias("input_ids"))


def pack_stats(lengths: DataFrame, key: str, size: int, batch: int = BATCH) -> DataFrame:
    """Per batch: rows, tokens, blocks, dropped tail tokens and the share of tokens kept. Reads lengths only."""
    rows = batched(lengths, key, batch)
    out = rows.groupBy("batch").agg(F.count(F.lit(1)).alias("rows"), F.sum("length").alias("tokens"))
    kept = F.floor(F.col("tokens") / size)
    return out.select("batch", "rows", "tokens", kept.alias("blocks"), (F.col("tokens") - kept * size).alias("dropped"),
                      (kept * size / F.col("tokens")).alias("kept_share"))


def _fill_bins(lengths: list[int], capacity: int) -> list[list[int]]:
    """Row numbers per bin. A bin takes as many rows as fit of the longest length that fits, then goes on with shorter
    lengths; of equally long rows the latest goes first."""
    stock: dict[int, list[int]] = {}
    for row, length in enumerate(lengths):
        stock.setdefault(length, []).append(row)
    rising = sorted(stock)
    bins = []
    while rising:
        room, chosen, at = capacity, [], len(rising)
        while at := bisect_right(rising, room, 0, at):
            at -= 1
            rows = stock[rising[at]]
            take = min(len(rows), room // rising[at]) if rising[at] else len(rows)
            room -= take * rising[at]
            chosen += [rows.pop() for _ in range(take)]
            if not rows:
                rising.pop(at)
        bins.append(chosen)
    return bins


def drop_overlong(lengths: DataFrame, cutoff: int) -> tuple[DataFrame, DataFrame]:
    """(rows that fit, rows longer than the cutoff)."""
    return lengths.filter(F.col("length") <= cutoff), lengths.filter(F.col("length") > cutoff)


def pack_knapsack(lengths: DataFrame, key: str, cutoff: int, batch: int = BATCH) -> DataFrame:
    """batch, pack, slot, key, length. Rows longer than ``cutoff`` are dropped after batching. Only keys and lengths
    travel to Python, at most ``batch`` rows per group."""
    rows = batched(lengths.select(key, "length"), key, batch).filter(F.col("length") <= cutoff)
    kind = dict(lengths.dtypes)[key]

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx").reset_index(drop=True)
        bins = _fill_bins(pdf["length"].tolist(), cutoff)
        flat = [(b, s, i) for b, rows_ in enumerate(bins) for s, i in enumerate(rows_)]
        picked = pdf.iloc[[i for _, _, i in flat]]
        return pd.DataFrame({"batch": picked["batch"].values, "pack": [b for b, _, _ in flat],
                             "slot": [s for _, s, _ in flat], key: picked[key].values, "length": picked["length"].values})

    schema = f"batch bigint, pack bigint, slot bigint, {key} {kind}, length bigint"
    return rows.groupBy("batch").applyInPandas(fill, schema)


def pack_materialise(rows: DataFrame, plan: DataFrame, key: str, cutoff: int, neat: bool = False, pad: int = PAD) -> DataFrame:
    """batch, pack, input_ids, labels, position_ids, attention_mask, each cutoff+1 long.

    Positions restart at every row. Neat masks number the rows 1..k and end in 0; plain masks are all 1.
    """
    cells = plan.select("batch", "pack", "slot", key).join(rows.select(key, "input_ids", "labels"), key)
    packs = cells.groupBy("batch", "pack").agg(F.array_sort(F.collect_list(F.struct("slot", "input_ids", "labels"))).alias("_r"))
    used = F.aggregate("_r", F.lit(0), lambda n, r: n + F.size(r["input_ids"]))
    gap = F.lit(cutoff + 1) - used

    def joined(build, fill):
        return F.concat(F.flatten(F.transform("_r", build)), F.array_repeat(F.lit(fill), gap)).cast("array<int>")

    def positions(r):
        return F.transform(r["input_ids"], lambda x, i: i)

    def marks(r, i):
        return F.array_repeat((i + 1) if neat else F.lit(1), F.size(r["input_ids"]))

    return packs.select("batch", "pack", joined(lambda r: r["input_ids"], pad).alias("input_ids"),
                        joined(lambda r: r["labels"], IGNORE).alias("labels"), joined(positions, 0).alias("position_ids"),
                        joined(marks, 0 if neat else 1).alias("attention_mask"))


# ---- segments of packed rows ----------------------------------------------------------------------------------------

def segment_lengths(mask: Column) -> Column:
    """Lengths of the segments 1..k of one mask in their order, empty ones left out: the marks are sorted and every place
    where a new one begins is found in one pass."""
    def lengths(marks):
        n = F.size(marks)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(marks, i) != F.get(marks, i - 1)))
        return F.when(n > 0, let(starts, lambda s: F.transform(s, lambda at, j: F.coalesce(F.get(s, j + 1), n) - at))).otherwise(
            F.array().cast("array<int>"))
    return let(F.sort_array(F.filter(mask, lambda x: x > 0)), lengths)


def seqlens(df: DataFrame, batch: str, row: str, mask: str) -> DataFrame:
    """Per segment of a batch: row, segment, length, start (running total of the lengths before it) and the longest
    segment of the batch."""
    spread = df.select(batch, row, F.posexplode(segment_lengths(F.col(mask))).alias("segment", "length"))
    order = Window.partitionBy(batch).orderBy(row, "segment").rowsBetween(Window.unboundedPreceding, -1)
    return (spread.withColumn("start", F.coalesce(F.sum("length").over(order), F.lit(0)))
            .withColumn("longest", F.max("length").over(Window.partitionBy(batch))))


def unmasked_indices(mask: Column, row: Column) -> Column:
    """Positions of unmasked tokens in the flattened batch."""
    hits = F.transform(mask, lambda x, i: F.when(x != 0, row * F.size(mask) + i))
    return F.filter(hits, lambda i: i.isNotNull())


def attn_pairs(mask: Column) -> Column:
    """Number of visible (i, j) pairs of one packed row: same segment, j <= i, no padding."""
    return F.aggregate(segment_lengths(mask), F.lit(0).cast("bigint"), lambda n, s: n + (s.cast("bigint") * (s + 1) / 2).cast("bigint"))


# ---- batches --------------------------------------------------------------------------------------------------------

def _padded(ids: Column, width: Column, fill: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(fill), F.greatest(width - F.size(ids), F.lit(0))))


def pad_batch(df: DataFrame, batch: str = "batch", multiple: int = 8, pad: int = PAD) -> DataFrame:
    """Right padding to the longest row of the batch rounded up to ``multiple``; adds attention_mask."""
    longest = F.max(F.size("input_ids")).over(Window.partitionBy(batch))
    rows = df.withColumn("_width", (F.ceil(longest / multiple) * multiple).cast("int"))
    ones = F.transform("input_ids", lambda x: F.lit(1))
    width = F.col("_width")
    out = rows.withColumn("attention_mask", _padded(ones, width, 0)).withColumn("labels", _padded(F.col("labels"), width, IGNORE))
    return out.withColumn("input_ids", _padded(F.col("input_ids"), width, pad)).drop("_width")


def pad_truncate(df: DataFrame, cutoff: int, batch: str = "batch", arrays: list[str] = ("input_ids", "labels")) -> DataFrame:
    """Every array cut or padded to min(longest row of the batch, cutoff); label arrays are padded with the mask value,
    others with 0."""
    longest = F.max(F.size("input_ids")).over(Window.partitionBy(batch))
    rows = df.withColumn("_width", F.least(longest, F.lit(cutoff)))
    for name in arrays:
        cut = F.slice(name, F.lit(1), F.col("_width"))
        rows = rows.withColumn(name, _padded(cut, F.col("_width"), IGNORE if "label" in name else 0))
    return rows.drop("_width")


def stack_pairs(df: DataFrame, key: str, batch: int) -> DataFrame:
    """batch, slot, key, side, input_ids, labels: the chosen rows of a batch, then its rejected rows."""
    rows = ordered_index(df, [key], total="_total")
    rows = rows.withColumn("batch", F.floor(F.col("idx") / batch))
    height = F.least(F.lit(batch).cast("bigint"), F.col("_total") - F.col("batch") * batch)
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.lit(i).alias("_second"), F.col(f"{s}_input_ids").alias("input_ids"),
                               F.col(f"{s}_labels").alias("labels")) for i, s in enumerate(("chosen", "rejected"))])
    spread = rows.withColumn("_height", height).withColumn("_s", F.explode(sides))
    slot = F.col("idx") % batch + F.col("_s._second") * F.col("_height")
    return spread.select("batch", slot.alias("slot"), key, "_s.side", "_s.input_ids", "_s.labels")


def micro_batches(df: DataFrame, key: str, world: int, micro: int, global_batch: int | None = None, seed=0) -> DataFrame:
    """key, replica, step, micro, slot over the shuffled, striped rows; the last incomplete step is dropped."""
    per_step = global_batch or world * micro
    if per_step % (world * micro):
        raise ValueError("global batch must be a multiple of replicas times micro batch")
    share = per_step // world
    order = shuffled_index(df.select(key), [key], seed, total="_total")
    local = F.floor(F.col("idx") / world)
    steps = F.floor(F.floor(F.col("_total") / world) / share)
    out = order.select(key, (F.col("idx") % world).alias("replica"), F.floor(local / share).alias("step"), steps.alias("_steps"),
                       F.floor((local % share) / micro).alias("micro"), (local % micro).alias("slot"))
    return out.filter(F.col("step") < F.col("_steps")).drop("_steps")
