"""Periodic runs of words: branching tandem repeats from an enhanced suffix array.

A run is a stretch of consecutive words with smallest period q whose words q apart are identical, at least max(6, 4 * q) words
long, that no neighbouring word extends. Per text:

1. Suffix array of word numbers by prefix doubling (only groups that are still tied are sorted again), and the common prefix
   length (LCP) of neighbours from the ranks of the doubling rounds.
2. Every LCP interval is a stretch of the suffix array that shares ``depth`` words. In all but its largest child, suffix i is
   tested with the inverse array: when i + depth or i - depth lies in the same interval but in another child, the two
   suffixes part after exactly ``depth`` words, so a square of period ``depth`` starts there and cannot move right.
3. Such a square is rotated left as long as the words agree. Squares that end up as the same stretch are one run; the
   smallest period counts.

All steps work on arrays over the texts of a step (about a million bytes; a longer text is a step of its own): no tree
nodes. Texts without any repeated four words hold no run and leave after one sort. Work is n log n and memory n log r
for n words and a longest repeat of r words in a step.

Defined cases: null, empty and blank texts hold no words and no runs; repeated rows are worked out each on their own; an
empty table gives no rows; extra columns are ignored.
"""

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from prefmill.functions.numeric import let
from prefmill.llm.base import map_steps

LEAST, EXPONENT = 6, 4
WORD = r"[^\x20\x09-\x0D]+"
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def suffix_array(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Order of all suffixes, and (h, ranks by the first h words) for h = 1, 2, 4 ... ``ends`` holds for every position
    the end of its text. Words of different texts must have different numbers."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    key = ids[order]
    at = np.arange(n)
    rank = np.empty(n, np.int64)
    h, levels = 1, []
    while True:
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        rank[order[at]] = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        levels.append((h, rank.astype(np.int32 if n < 2**31 else np.int64)))
        alone = new & np.append(new[1:], True)
        at = at[~alone]
        if not len(at):
            return order, levels
        place = order[at]
        after = place + h
        inside = after < ends[place]
        key = rank[place] * (n + 1) + np.where(inside, rank[np.where(inside, after, 0)] + 1, 0)
        sort = np.argsort(key, kind="stable")
        order[at], key = place[sort], key[sort]
        h *= 2


def neighbour_prefixes(order: np.ndarray, levels, ends: np.ndarray) -> np.ndarray:
    """lcp[j]: words shared by the suffixes at j - 1 and j; lcp[0] and lcp[n] are -1."""
    n = len(order)
    x, y = order[:-1], order[1:]
    same = np.zeros(n - 1, np.int64)
    for h, rank in reversed(levels):
        a, b = x + same, y + same
        inside = (a < ends[x]) & (b < ends[y])
        hit = inside & (rank[np.where(inside, a, 0)] == rank[np.where(inside, b, 0)])
        same += h * hit
    return np.concatenate(([-1], same, [-1]))


def _bounds(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every j the last place before it and the first one after it with a smaller value, in one pass over a stack."""
    values = lcp.tolist()
    left, right = [0] * len(values), [0] * len(values)
    stack = [0]
    for j, v in enumerate(values[1:], 1):
        while values[stack[-1]] > v:
            right[stack.pop()] = j
        top = stack[-1]
        left[j] = left[top] if values[top] == v else top
        stack.append(j)
    return np.array(left), np.array(right)


def branching_squares(order: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods of all squares whose second half is not followed by its own first word."""
    n = len(order)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    inner = np.flatnonzero(lcp > 0)
    left, right = _bounds(lcp)
    left, right, depth = left[inner], right[inner] - 1, lcp[inner]
    # Borders of one interval stand together; an interval with m borders has m + 1 children.
    sort = np.lexsort((inner, right, left))
    inner, left, right, depth = inner[sort], left[sort], right[sort], depth[sort]
    first = np.ones(len(inner), bool)
    first[1:] = (left[1:] != left[:-1]) | (right[1:] != right[:-1])
    heads = np.flatnonzero(first)
    low = np.concatenate((left[heads], inner))
    high = np.concatenate((inner[heads] - 1, np.where(np.append(first[1:], True), right, np.append(inner[1:], 0) - 1)))
    owner = np.concatenate((np.arange(len(heads)), np.cumsum(first) - 1))
    left, right, depth = left[heads], right[heads], depth[heads]
    # All children but the largest of their interval.
    size = high - low + 1
    sort = np.lexsort((size, owner))
    small = np.ones(len(sort), bool)
    small[sort[np.append(owner[sort][1:] != owner[sort][:-1], True)]] = False
    low, high, owner, size = low[small], high[small], owner[small], size[small]
    row = np.repeat(np.arange(len(low)), size)
    suffix = order[np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + low[row]]
    step = depth[owner[row]]

    def meets(other):
        inside = (other >= 0) & (other < n)
        at = place[np.where(inside, other, 0)]
        return inside & (at >= left[owner[row]]) & (at <= right[owner[row]]) & ((at < low[row]) | (at > high[row]))
    ahead, back = meets(suffix + step), meets(suffix - step)
    starts = np.concatenate((suffix[ahead], suffix[back] - step[back]))
    pairs = np.unique(np.stack((starts, np.concatenate((step[ahead], step[back])))), axis=1)
    return pairs[0], pairs[1]


def _agreeing(ids: np.ndarray, at: int, floor: int, period: int) -> int:
    """How many words before ``at`` equal the word ``period`` after them, without a gap and not below ``floor``."""
    done, width = 0, 64
    while at - done > floor:
        low = max(floor, at - done - width)
        differ = np.flatnonzero(ids[low:at - done] != ids[low + period:at - done + period])
        if len(differ):
            return at - (low + int(differ[-1]) + 1)
        done, width = at - low, width * 4
    return done


def runs_of(texts: list[list]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each list of words, by start, then period."""
    out: list[list] = [[] for _ in texts]
    sizes = np.array([len(t) for t in texts], np.int64)
    numbers: dict = {}
    number = count()
    words = np.fromiter((x for t in texts for x in map(numbers.setdefault, t, number)), np.int64, sizes.sum())
    text = np.repeat(np.arange(len(texts)), sizes)
    kept = _repeating(words, text, len(texts))[text]
    words, text = words[kept], text[kept]
    if not len(words):
        return out
    starts = np.searchsorted(text, np.arange(len(texts)))
    ends = np.searchsorted(text, np.arange(len(texts)), "right")
    end = ends[text]
    _, words = np.unique(words, return_inverse=True)
    ids = text * (int(words.max()) + 1) + words
    order, levels = suffix_array(ids, end)
    at, period = branching_squares(order, neighbour_prefixes(order, levels, end))
    # What a run needs at least: so many steps to the left, checked at both ends before any rotation.
    floor, need = starts[text[at]], np.maximum((EXPONENT - 2) * period, LEAST - 2 * period)
    far = at - need
    fits = far >= floor
    fits[fits] = (ids[far[fits]] == ids[far[fits] + period[fits]]) & (ids[at[fits] - 1] == ids[at[fits] - 1 + period[fits]])
    at, period, floor = at[fits], period[fits], floor[fits]
    best: dict[tuple[int, int], int] = {}
    by_end: dict[int, list[tuple[int, int]]] = {}
    for i in np.lexsort((period, at + 2 * period)).tolist():
        q, e = int(period[i]), int(at[i] + 2 * period[i])
        if any(q % known == 0 and e - s >= 2 * q for s, known in by_end.get(e, ())):
            continue  # a square of a run already found, several periods at once
        s = int(at[i]) - _agreeing(ids, int(at[i]), int(floor[i]), q)
        if e - s >= max(LEAST, EXPONENT * q) and best.setdefault((s, e), q) == q:
            by_end.setdefault(e, []).append((s, q))
    for (s, e), q in sorted(best.items(), key=lambda r: (r[0][0], r[1])):
        t = int(text[s])
        out[t].append((s - int(starts[t]), e - s, q))
    return out


def _repeating(words: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    """Which texts may hold the same four words twice (by a hash, so a few more than do)."""
    repeats = np.zeros(texts, bool)
    if len(words) < LEAST:
        return repeats
    key = text[:-3].astype(np.uint64)
    with np.errstate(over="ignore"):
        for k in range(4):
            key = (key ^ words[k:len(words) - 3 + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
    order = np.argsort(key)
    again = key[order][1:] == key[order][:-1]
    repeats[text[order[1:][again]]] = True
    repeats[text[order[:-1][again]]] = True
    return repeats


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """Words without those that lie in a run after its first period."""
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period:start + length] = False
    return [w for w, k in zip(words, keep.tolist()) if k]


def word_runs(docs: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """key, runs (array of start, length, period by start, then period; word numbers from 0), collapsed (the text's words
    joined by blanks, without those in a run after its first period)."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def step(batch):
        # bytes.split() parts at exactly blank and 0x09 to 0x0D.
        texts = [(t or b"").split() for t in batch.column(column).cast(pa.binary()).to_pylist()]
        found = runs_of(texts)
        kept = [b" ".join(collapsed(t, r) if r else t) for t, r in zip(texts, found)]
        cells = [[dict(zip(("start", "length", "period"), r)) for r in runs] for runs in found]
        return [batch.column(key), pa.array(cells, kind), pa.array(kept, pa.binary()).cast(pa.string())]

    return map_steps(docs.select(key, column), f"`{key}` {docs.schema[key].dataType.simpleString()}, runs {RUNS}, collapsed string",
                     step, column)


def planted(text: Column, key: Column) -> Column:
    """The text with its end made periodic for a tenth of the keys: from word a on, word i is word a + (i - a) % p."""
    h = F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)

    def periodic(words):
        n = F.size(words).cast("long")
        a = F.pmod(g, F.greatest(n, F.lit(1)))
        at = F.struct(a.alias("a"), (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).alias("p"), n.alias("n"))
        return let(at, lambda v: F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(v["n"], F.lit(1)) - 1), lambda i: F.get(
            words, F.when(i < v["a"], i).otherwise(v["a"] + F.pmod(i - v["a"], v["p"])).cast("int"))), " "))
    return F.when(F.pmod(h, F.lit(10)) == 0, let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), periodic)).otherwise(text)


def digests(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_runs, start, length, period, exponent_milli of the longest run (ties: first start, then period), digests."""
    found = word_runs(docs.select(key, planted(F.col("text"), F.col(key)).alias("text")), key)
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.array_join(F.transform(lines, lambda line: F.concat(line, F.lit("\n"))), "")
    out = found.select(key, F.size("runs").cast("long").alias("n_runs"), longest.alias("top"), F.sha2(lines, 256).alias("runs_sha256"),
                       F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length = -F.col("top.l")
    return out.select(key, "n_runs", F.col("top.s").alias("start"), length.alias("length"), F.col("top.p").alias("period"),
                      F.floor(1000 * length / F.col("top.p")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
