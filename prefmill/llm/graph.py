"""Connected components as Spark jobs, and all pairs of a group in bounded blocks."""

from pyspark.sql import Column, DataFrame, functions as F

from prefmill.session import gathered, settled

#: Rounds double the distance a label travels, so this is far beyond what any graph needs.
MOST_ROUNDS = 60


#: A key with more than 1/HOT_KEYS of all rows (and more than HOT_ROWS) is joined by broadcast: so fewer than HOT_KEYS keys are.
HOT_KEYS, HOT_ROWS = 10_000, 256


def met_by_key(rows: DataFrame, side: DataFrame, key: str, uses: str = "_uses") -> DataFrame:
    """``rows`` joined with ``side``, which has one row for each key of theirs and in ``uses`` the number of them. Rows of a
    frequent key stay where they are and meet a broadcast row; the shares of keys add up to one, which bounds how many
    such keys there are. All other keys are shuffled, none of them with more than a small share of the rows. Rows with a
    null key are left out; ``uses`` is dropped."""
    total = side.agg(F.coalesce(F.sum(uses), F.lit(0)).alias("n")).first()["n"]
    hot = F.col(uses) > max(HOT_ROWS, total // HOT_KEYS)
    frequent = side.filter(hot).drop(uses)
    usual = rows.join(F.broadcast(frequent.select(key)), key, "left_anti")
    return (rows.join(F.broadcast(frequent), key)
            .unionByName(usual.join(side.filter(~hot).drop(uses).hint("merge"), key)))


def beside(rows: DataFrame, key: str, *aggregates: Column) -> DataFrame:
    """``rows`` with aggregates over the rows of their key, without a task for the whole group."""
    return met_by_key(rows, settled(gathered(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_uses"), *aggregates))), key)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = beside(both, "a", F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
    return low.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = beside(down, "a", F.min("b").alias("m"))
    return low.select(F.when(F.col("b") != F.col("m"), F.col("b")).otherwise(F.col("a")).alias("a"), F.col("m").alias("b")).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node is the upper end of one edge at most, and then not the lower end of any (``a > b``): each lower end
    is the smallest of its component, and no round would change anything."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("upper"), F.lit(0).alias("lower")),
                                          F.struct(F.col("b").alias("node"), F.lit(0).alias("upper"), F.lit(1).alias("lower")))).alias("e"))
    return ends.groupBy("e.node").agg((F.sum("e.upper") + F.max("e.lower")).alias("n")).filter("n > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of ``edges`` (a, b); the root is the smallest node that can be reached.

    Large-star and small-star operations in turn until only stars are left. Each round is written to the shared folder, so
    a lost executor never repeats an earlier round. Neighbours of a hub are never dealt to one task. Edges from a node to itself are ignored.
    """
    now = settled(gathered(edges.select("a", "b").filter("a != b").distinct()))
    for _ in range(MOST_ROUNDS):
        now = settled(gathered(_small_star(settled(gathered(_large_star(now))))))
        if _stars(now):
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def block_pairs(rows: DataFrame, blocks: Column, ident: str) -> DataFrame:
    """Adds lo, hi: each row once for each pair of blocks its own block is in, so that every two rows of a group meet in
    some (group, lo, hi) and none holds more than two blocks. A group of one block is copied once."""
    own = F.pmod(F.xxhash64(ident), blocks)
    return (rows.withColumn("_own", own).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
            .withColumn("lo", F.least("_own", "_k")).withColumn("hi", F.greatest("_own", "_k")).drop("_own", "_k"))


def forest(n: int, similar):
    """Edges (i, j) of a spanning forest over 0..n-1. ``similar(i, rest)`` tells which of the numbers ``rest`` are linked
    with i. Rows that are already reached are never compared again."""
    import numpy as np
    left = np.arange(n)
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            hit = similar(i, left)
            for j in left[hit]:
                yield i, int(j)
            queue.extend(map(int, left[hit]))
            left = left[~hit]
