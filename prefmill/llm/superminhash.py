"""Near duplicates by SuperMinHash, banding, exact verification and union-find grouping.

1. Every whole text becomes a set of hashed word shingles. Equal sets are one class; only its smallest id goes on.
2. SuperMinHash: each element walks through its own random permutation of the signature's places. At step j it offers
   j + u (u uniform) to the j-th place of its permutation. A document stops at the first step after which all its places
   hold values below j + 1, as later offers cannot be lower; large sets stop after one step.
3. Bands of four values; their number follows from the threshold so that a pair at the threshold is missed with
   probability below ``MISS``. Sets that share a band are compared by whole signatures inside the band's group (blocks
   of bounded size, paired) and joined into families when the estimate is at most ``SLACK`` standard deviations low.
4. Inside each family (again in blocks of bounded size) full sets are compared exactly. Only edges of a spanning forest
   leave a task, never all pairs. Large-star/small-star union-find gives the components.

Defined results: null, empty or blank texts have no shingle, are linked with nothing and form their own component.
With fewer words than a shingle, the whole sequence is the only shingle. Repeated ids with different texts are separate
documents; a component's id is the smallest id in it, null only if it has no other. An empty table gives an empty result.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from prefmill.llm.base import map_steps
from prefmill.llm.graph import beside, block_pairs, components, forest, met_by_key
from prefmill.llm.shingles import digest, mix, shingle_set, word_lists
from prefmill.session import gathered, settled

ROWS = 4
MISS = 1e-6
SLACK = 5
#: Members of a band's group, and shingles of a family, that meet in one block. Larger groups are split, none is cut.
BAND_BLOCK = 20_000
SET_BLOCK = 1_000_000

_FRACTION = 24  # bits of the random part of a signature value; the step stands above them


def bands(percent: int) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** ROWS))


def signatures(sets: list[np.ndarray], m: int) -> np.ndarray:
    """One row of m values for each set (not empty)."""
    n = len(sets)
    low = np.full(n * m, np.iinfo(np.uint32).max, np.uint32)
    items = np.concatenate(sets) if n else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    order = None
    for j in range(m):
        if not len(items):
            break
        draw = mix(items + np.uint64((j + 1) * 0xA24BAED4963EE407 % (1 << 64)))
        swap = j + ((draw >> np.uint64(40)) * np.uint64(m - j) >> np.uint64(24)).astype(np.int64)
        if order is None:
            place = swap
        else:
            rows = np.arange(len(items))
            place = order[rows, swap].astype(np.int64)
            order[rows, swap] = order[:, j]
        value = (draw & np.uint64((1 << _FRACTION) - 1)).astype(np.uint32) + np.uint32(j << _FRACTION)
        np.minimum.at(low, owner * m + place, value)
        active = low.reshape(n, m).max(1) >= np.uint32((j + 1) << _FRACTION) if j + 1 < m else np.zeros(n, bool)
        going = active[owner]
        items, owner = items[going], owner[going]
        if order is None:
            order = np.tile(np.arange(m, dtype=np.uint8), (len(items), 1))
            order[np.arange(len(items)), swap[going]] = 0  # the first step moved place 0 there
        else:
            order = order[going]
    return low.reshape(n, m)


def sets_of(values, k: int) -> list[np.ndarray]:
    return [shingle_set(w, k) for w in word_lists([v.as_buffer().to_pybytes() if v.is_valid else b"" for v in values])]


def signed(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, cls (names the set; null if empty), sig (a byte of each value), keys (one
    for each band)."""
    count = bands(percent)
    m = ROWS * count
    factor = mix(np.arange(ROWS, dtype=np.uint64)) | np.uint64(1)

    def step(batch):
        sets = sets_of(batch.column("text"), k)
        full = [i for i, s in enumerate(sets) if len(s)]
        values = signatures([sets[i] for i in full], m)
        keys = mix((values.reshape(-1, count, ROWS).astype(np.uint64) * factor).sum(2) + np.arange(count, dtype=np.uint64) * np.uint64(0x9E6C63D0676A9A99))
        keys = keys.view(np.int64)
        small = (values & np.uint32(255)).astype(np.uint8)
        row = dict(zip(full, range(len(full))))
        return [batch.column("doc_id"), batch.column("th"), [len(s) for s in sets], [digest(s) if len(s) else None for s in sets],
                [small[row[i]].tobytes() if i in row else None for i in range(len(sets))],
                [keys[row[i]] if i in row else None for i in range(len(sets))]]

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_steps(docs.select("doc_id", "text", F.xxhash64("text").alias("th")),
                     f"doc_id {kind}, th long, n_shingles long, cls binary, sig binary, keys array<long>", step)


def _groups(batches, key: list[str]):
    """Runs of rows with equal keys in a sorted partition, whole."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        change = np.zeros(table.num_rows - 1, bool)
        for name in key:
            column = table.column(name).to_numpy()
            change |= column[1:] != column[:-1]
        cuts = np.flatnonzero(change) + 1
        start = 0
        for cut in cuts:
            if cut - start > 1:
                yield table.slice(start, cut - start)
            start = cut
        held = table.slice(start).combine_chunks()
    if held is not None and held.num_rows > 1:
        yield held


def _band_edges(need: int):
    def run(batches):
        for group in _groups(batches, ["key", "lo", "hi"]):
            names = group.column("cls").to_pylist()
            sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint8).reshape(len(names), -1)
            pairs = list(forest(len(names), lambda i, rest: (sig[rest] == sig[i]).sum(1) >= need))
            if pairs:
                yield pa.RecordBatch.from_pydict({"a": [names[i] for i, _ in pairs], "b": [names[j] for _, j in pairs]})
    return run


def _exact(sets: list[np.ndarray], percent: int):
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    values, dense = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(values), np.int32)

    def similar(i, rest):
        own = dense[starts[i]:starts[i] + sizes[i]]
        hit = np.zeros(len(rest), bool)
        near = (100 * np.minimum(sizes[rest], sizes[i]) >= percent * np.maximum(sizes[rest], sizes[i]))
        rest = rest[near]
        if not len(rest):
            return hit
        mark[own] = 1
        lens = sizes[rest]
        ends = np.cumsum(lens)
        flat = np.arange(ends[-1]) + np.repeat(starts[rest] - (ends - lens), lens)
        common = np.add.reduceat(mark[dense[flat]], ends - lens)
        mark[own] = 0
        hit[near] = 100 * common >= percent * (lens + sizes[i] - common)
        return hit

    return list(forest(len(sets), similar))


def _set_edges(k: int, percent: int):
    def run(batches):
        def hashed():
            for batch in batches:  # texts become sets at once, so a group holds hashes only
                sets = sets_of(batch.column("text"), k)
                names = batch.column("cls").to_pylist()
                keep = pa.array([digest(s) == c for s, c in zip(sets, names)])  # other texts under a repeated id
                yield pa.RecordBatch.from_pydict({
                    **{c: batch.column(c) for c in ("family", "lo", "hi", "cls")},
                    "set": pa.array([s.tobytes() for s in sets], pa.binary())}).filter(keep)

        for group in _groups(hashed(), ["family", "lo", "hi"]):
            seen = dict(zip(group.column("cls").to_pylist(), group.column("set").to_pylist()))  # equal rows once
            names = list(seen)
            pairs = _exact([np.frombuffer(s, np.uint64) for s in seen.values()], percent)
            if pairs:
                yield pa.RecordBatch.from_pydict({"a": [names[i] for i, _ in pairs], "b": [names[j] for _, j in pairs]})
    return run


def classes_and_links(docs: DataFrame, rows: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The class table (cls, doc_id, uses) and a spanning forest (a, b) of the links between classes. ``rows``: signed()."""
    count = bands(percent)
    m = ROWS * count
    share = percent / 100
    need = math.floor(m * share - SLACK * math.sqrt(m * share * (1 - share)))
    named = rows.filter("cls IS NOT NULL")
    classes = settled(gathered(named.groupBy("cls").agg(F.count(F.lit(1)).alias("uses"),
                                                       F.min(F.struct(F.isnull("doc_id").alias("_null"), "doc_id", "n_shingles", "sig", "keys")).alias("r"))
                      .select("cls", "uses", "r.*").drop("_null")))
    keyed = classes.select("cls", F.explode("keys").alias("key"))
    met = settled(gathered(beside(keyed, "key", F.count(F.lit(1)).alias("_n")).filter("_n > 1")))
    met = met.join(classes.select("cls", "sig"), "cls")
    met = block_pairs(met, F.ceil(F.col("_n") / BAND_BLOCK), "cls").drop("_n")
    near = (met.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
            .select("key", "lo", "hi", "cls", "sig").mapInArrow(_band_edges(need), "a binary, b binary"))
    family = settled(gathered(components(near).select(F.col("node").alias("cls"), F.col("root").alias("family"))
                              .join(classes.select("cls", "doc_id", "n_shingles"), "cls")))
    placed = block_pairs(beside(family, "family", F.sum("n_shingles").alias("_w")), F.ceil(F.col("_w") / SET_BLOCK), "cls")
    placed = placed.select(F.xxhash64("family").alias("family"), "lo", "hi", "cls", "doc_id")
    # The members grow with the documents, so they are never broadcast, however few they are.
    members = placed.withColumnRenamed("doc_id", "_id").hint("merge")
    texts = (docs.select("doc_id", "text").join(members, F.col("doc_id").eqNullSafe(F.col("_id")))
             .select("family", "lo", "hi", "cls", "text"))
    links = (texts.repartition("family", "lo", "hi").sortWithinPartitions("family", "lo", "hi")
             .mapInArrow(_set_edges(k, percent), "a binary, b binary"))
    return classes.select("cls", "doc_id", "uses"), links


def placed(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, th, n_shingles, cls, component_id, first (whether the row's class holds the component's smallest id)."""
    rows = settled(gathered(signed(docs, k, percent)))
    classes, links = classes_and_links(docs, rows, k, percent)
    joined = classes.join(components(links).withColumnRenamed("node", "cls"), "cls", "left")
    joined = joined.withColumn("root", F.coalesce("root", "cls"))
    joined = beside(settled(gathered(joined)), "root", F.min(F.struct(F.isnull("doc_id").alias("_null"), "doc_id", "cls")).alias("low"))
    named = joined.select("cls", "uses", F.col("low.doc_id").alias("component_id"), (F.col("low.cls") == F.col("cls")).alias("first"))
    rows = rows.select("cls", "doc_id", "th", "n_shingles")
    blank = rows.filter("cls IS NULL").withColumns({"component_id": F.lit(None).cast(rows.schema["doc_id"].dataType),
                                                    "first": F.lit(None).cast("boolean")})
    return met_by_key(rows, settled(gathered(named)), "cls", "uses").unionByName(blank)


def grouped(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``."""
    own = F.coalesce("component_id", "doc_id")
    return placed(docs, k, percent).select("doc_id", "n_shingles", own.alias("component_id"), own.eqNullSafe(F.col("doc_id")).alias("kept"))


def deduplicated(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, all columns: one of each component, and every row without a shingle. Of rows that
    share the smallest id of a component, one with its class and the smallest text hash stays."""
    found = placed(docs, k, percent)
    best = found.filter(F.col("first") & F.col("component_id").eqNullSafe(F.col("doc_id")))
    best = best.groupBy("doc_id", "cls", "th").agg(F.count(F.lit(1)).alias("n"))
    best = settled(gathered(best.groupBy("doc_id", "cls").agg(F.min(F.struct("th", "n")).alias("b")).select("doc_id", "b.th", "b.n")))
    blank = found.filter("cls IS NULL").select("doc_id", "th").distinct()

    def of(ids):
        d, i = F.col("d.doc_id"), F.col("k.doc_id")
        return docs.alias("d").join(ids.alias("k"), d.eqNullSafe(i) & F.xxhash64("d.text").eqNullSafe(F.col("k.th")), "left_semi")

    once = of(best.filter("n = 1").select("doc_id", "th").unionByName(blank))
    again = best.filter("n > 1")
    return once if again.isEmpty() else once.unionByName(of(again).dropDuplicates(["doc_id", "text"]))
