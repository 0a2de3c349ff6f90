"""Mixture-controlled packing: a deficit round-robin over source queues fills every window to target token shares.

Every window each queue earns its share of the window on top of its deficit, sends the whole tokens it is owed, and the
tokens still missing come from the queues owed most. What is owed stays in the deficit. With shares in whole tokens per
``CYCLE`` windows all deficits are zero again after a cycle, so the state at any window follows from its number: tasks
start anywhere with the right deficits and none waits for another. When a queue runs dry, one window shares out what is
missing and a new phase goes on with the queues left. There are at most two phases for each queue.

Where targets are given, every source with one has a queue of its own, however many there are, so when one runs dry all
others take over its share. The driver's plan has a row for each queue and phase: two times the square of the number of
targets. Without targets shares are those of all tokens, so no source runs dry before the end; the ``QUEUES - 1`` sources
with most tokens have a queue each, and all others, of which there may be as many as documents, lie in one joint queue in
rounds of as many tokens as a window owes them: a round holds what each source is owed by its own share so far, in whole
tokens, less what earlier rounds held. A source owed less than one token a window sends ``RUN`` tokens whenever it is owed
so many. Sources without a target, where targets are given, have a joint queue of the same kind. A null source is a source.
Documents are cut freely; every token lies in exactly one piece. Only the last window may be short.
Null and empty texts have the end id alone. An empty table gives no pieces. The order inside a queue is that of the
partitions in which the documents were tokenised; it is written once, so a lost executor changes nothing.
"""

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from prefmill.llm.base import map_steps
from prefmill.llm.tokenizing import pieces_of
from prefmill.session import settled

QUEUES = 64
CYCLE = 256
RUN = 16  # tokens that a source owed less than one token a window sends at once
KEPT = 8  # phases whose tables a task keeps
END = 1
TEXT = 8_000_000  # bytes of text whose distinct words are encoded at once


def shares(weights: np.ndarray, active: np.ndarray, total: int) -> np.ndarray:
    """Whole numbers that add up to ``total`` in proportion to the weights of the active queues, at least one each."""
    w = np.where(active, np.maximum(weights, 0.0), 0.0)
    if w.sum() <= 0:
        w = active.astype(float)
    free = total - int(active.sum())
    exact = w / w.sum() * free
    out = np.floor(exact).astype(np.int64)
    rest = np.argsort(-(exact - out), kind="stable")[:free - int(out.sum())]
    out[rest] += 1
    return out + active


def cycle(quanta: np.ndarray, size: int) -> np.ndarray:
    """Tokens each queue has sent before window 0..CYCLE of a cycle; queue q sends quanta[q] in all."""
    owed = np.zeros(len(quanta), np.int64)  # deficits, in 1/CYCLE token
    sent = np.zeros((CYCLE + 1, len(quanta)), np.int64)
    for w in range(CYCLE):
        owed += quanta
        take = np.maximum(owed // CYCLE, 0)
        owed -= take * CYCLE
        missing = size - int(take.sum())
        if missing > 0:
            more = np.argsort(-owed, kind="stable")[:missing]
            take[more] += 1
            owed[more] -= CYCLE
        elif missing < 0:
            able = np.flatnonzero(take > 0)
            less = able[np.argsort(owed[able], kind="stable")][:-missing]
            take[less] -= 1
            owed[less] += CYCLE
        sent[w + 1] = sent[w] + take
    return sent


def _topped(take: np.ndarray, left: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    """One window: what each queue can send of ``take``; the rest comes from queues that have more, by weight."""
    take = np.minimum(take, left)
    while (missing := min(size, int(left.sum())) - int(take.sum())) > 0:
        able = left > take
        more = shares(weights, able, max(missing, int(able.sum())))
        if int(able.sum()) > missing:
            more = np.where(able & (np.cumsum(able) <= missing), 1, 0)
        take = take + np.minimum(more, left - take)
    return take


def phases(totals: list[int], weights: list[float], size: int) -> list[dict]:
    """first window, number of windows, tokens of each queue sent before, and the quanta of a cycle (or of one window)."""
    left, weights = np.array(totals, np.int64), np.array(weights, float)
    used, first, out = np.zeros_like(left), 0, []
    while left.sum() > 0:
        active = left > 0
        quanta = shares(weights, active, size * CYCLE)
        sent = cycle(quanta, size)
        full = int((left[active] // quanta[active]).min())
        part = int((sent <= left - full * quanta).all(1).sum()) - 1
        count = full * CYCLE + part
        if count:
            out.append({"first": first, "count": count, "used": used.copy(), "quanta": quanta})
            gone = full * quanta + sent[part]
            used, left, first = used + gone, left - gone, first + count
        if left.sum() > 0:
            at = count % CYCLE
            take = _topped(sent[at + 1] - sent[at], left, weights, size)
            out.append({"first": first, "count": 1, "used": used.copy(), "quanta": None, "take": take})
            used, left, first = used + take, left - take, first + 1
    return out


class Plan:
    """Places of queue ranges in windows, from the phases."""

    def __init__(self, found: list[dict], size: int):
        self.found, self.size, self.tables = found, size, {}
        self.used = np.stack([p["used"] for p in found], 1) if found else np.zeros((0, 0), np.int64)

    def _table(self, k: int):
        if k not in self.tables:
            if len(self.tables) == KEPT:
                self.tables.pop(next(iter(self.tables)))
            p = self.found[k]
            sent = cycle(p["quanta"], self.size) if p["quanta"] is not None else np.vstack([np.zeros_like(p["take"]), p["take"]])
            take = np.diff(sent, axis=0)
            self.tables[k] = sent, np.cumsum(take, axis=1) - take
        return self.tables[k]

    def _met(self, queue: np.ndarray, start: np.ndarray, end: np.ndarray):
        """row, phase of the phases in which each range is sent; a phase that sends nothing of a queue meets none."""
        first, last = np.empty(len(queue), np.int64), np.empty(len(queue), np.int64)
        for q in np.unique(queue):
            rows = np.flatnonzero(queue == q)
            first[rows] = np.searchsorted(self.used[q], start[rows], side="right") - 1
            last[rows] = np.searchsorted(self.used[q], end[rows] - 1, side="right") - 1
        n = last - first + 1
        row = np.repeat(np.arange(len(queue)), n)
        return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + first[row]

    def pieces(self, queue: np.ndarray, start: np.ndarray, end: np.ndarray):
        """row, start, length, window and offset of the pieces of the ranges [start, end), each of its queue."""
        some = np.flatnonzero(end > start)
        row, phase = self._met(queue[some], start[some], end[some])
        row, out = some[row], [np.empty((5, 0), np.int64)]
        order = np.argsort(phase, kind="stable")
        bounds = np.flatnonzero(np.diff(phase[order], prepend=-1, append=-1))
        for a, b in zip(bounds[:-1], bounds[1:]):
            k, rows = int(phase[order[a]]), row[order[a:b]]
            sent, before = self._table(k)
            span, q = len(sent) - 1, queue[rows]
            each, begin = sent[-1][q], self.used[q, k]
            close = self.used[q, k + 1] if k + 1 < len(self.found) else end[rows]
            lo, hi = np.maximum(start[rows], begin) - begin, np.minimum(end[rows], close) - begin
            rows, q, each, begin, lo, hi = (x[hi > lo] for x in (rows, q, each, begin, lo, hi))
            w0, w1 = (x // each * span for x in (lo, hi - 1))
            for one in np.unique(q):
                at = np.flatnonzero(q == one)
                w0[at] += np.searchsorted(sent[1:, one], lo[at] % each[at], side="right")
                w1[at] += np.searchsorted(sent[1:, one], (hi[at] - 1) % each[at], side="right")
            n = w1 - w0 + 1
            at = np.repeat(np.arange(len(rows)), n)
            w = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + w0[at]
            base = w // span * each[at] + sent[w % span, q[at]]
            after = (w + 1) // span * each[at] + sent[(w + 1) % span, q[at]]
            s, e = np.maximum(lo[at], base), np.minimum(hi[at], after)
            offset = before[w % span, q[at]] + s - base
            out.append(np.stack([rows[at], s + begin[at], e - s, w + self.found[k]["first"], offset])[:, e > s])
        return np.concatenate(out, 1)


def tokenised(docs: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """key, part, queue_key, before (tokens of the same source earlier in the partition), n, ids."""
    state = {}

    def step(batch):
        if state.get("part") != (part := (TaskContext.get().partitionId(), TaskContext.get().taskAttemptId())):
            state["part"], state["sent"] = part, {}
        pieces, sent = pieces_of(path), state["sent"]
        end = END.to_bytes(2 if pieces.code == "H" else 4, "little")
        ids = pieces.column(pc.fill_null(batch.column("text").cast(pa.string()), ""), end)
        names = batch.column("queue_key").to_pylist()
        lengths = (pc.binary_length(ids).to_numpy() // len(end)).tolist()
        before = []
        for name, n in zip(names, lengths):
            before.append(sent.get(name, 0))
            sent[name] = before[-1] + n
        return [batch.column(key), [part[0]] * len(ids), names, before, lengths, [len(end)] * len(ids), ids]

    kind = docs.schema[key].dataType.simpleString()
    named = docs.select(key, "text", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-")).alias("queue_key"))
    return map_steps(named, f"`{key}` {kind}, part int, queue_key string, before long, n long, width int, ids binary", step, limit=TEXT)


def _in_rounds(placed: DataFrame, key: str) -> DataFrame:
    """Documents of joint queues, cut where their source's rounds end and laid out round by round: the columns that
    ``packed`` reads, ``start`` being the place in the queue. Runs are range partitioned and written once; a row for each
    partition and queue gives the offsets."""
    kind = placed.schema[key].dataType.simpleString()

    def runs(batch):
        starts, lengths, rates, widths = (batch.column(c).to_numpy() for c in ("start", "n", "rate", "width"))
        bodies, names = batch.column("ids"), batch.column("queue_key").to_pylist()
        row, at, n, rounds, parts = [], [], [], [], []
        for i, (start, length, rate) in enumerate(zip(starts.tolist(), lengths.tolist(), rates.tolist())):
            lead = zlib.crc32(names[i].encode()) / (1 << 32)  # sources take their roundings in different rounds
            places = np.arange(start, start + length)
            if rate < 1:
                turn = ((places // RUN + lead) * (RUN / rate)).astype(np.int64)
            else:
                turn = ((places + lead) / rate).astype(np.int64)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(turn)) + 1])
            ends = np.append(cuts[1:], length)
            body = bodies[i].as_buffer()
            row.append(np.full(len(cuts), i))
            at.append(cuts)
            n.append(ends - cuts)
            rounds.append(turn[cuts])
            parts += [body[a * int(widths[i]):b * int(widths[i])].to_pybytes() for a, b in zip(cuts.tolist(), ends.tolist())]
        row, at, n, rounds = map(np.concatenate, (row, at, n, rounds))
        index = _index(row)
        return [batch.column(key).take(index), batch.column("queue").take(index), rounds, batch.column("queue_key").take(index),
                starts[row] + at, n, at, lengths[row], widths[row], parts]

    cut = map_steps(placed.select(key, "start", "n", "queue", "rate", "width", "queue_key", "ids"),
                    f"`{key}` {kind}, queue int, _round long, queue_key string, place long, n long, at long, doc_tokens long, width int, ids binary",
                    runs, "ids")
    order = ["queue", "_round", "_tie", "queue_key", "place"]
    cut = cut.withColumn("_tie", F.xxhash64("queue_key")).repartitionByRange(*order).sortWithinPartitions(*order)
    state = {}

    def numbered(batch):
        if state.get("part") != (part := (TaskContext.get().partitionId(), TaskContext.get().taskAttemptId())):
            state["part"], state["sent"] = part, {}
        sent, before = state["sent"], []
        for queue, n in zip(batch.column("queue").to_pylist(), batch.column("n").to_pylist()):
            before.append(sent.get(queue, 0))
            sent[queue] = before[-1] + n
        same = ("queue", "width", "queue_key", "at", "doc_tokens", "n", "ids")
        return [batch.column(key), [part[0]] * len(before), before, *(batch.column(c) for c in same)]

    laid = settled(map_steps(cut, f"`{key}` {kind}, part int, before long, queue int, width int, queue_key string, at long, doc_tokens long, "
                                  "n long, ids binary", numbered, "ids"))
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (laid.groupBy("part", "queue").agg(F.sum("n").alias("n"))
               .select("part", "queue", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    return laid.join(offsets, ["part", "queue"]).select(key, (F.col("base") + F.col("before")).alias("start"), "n", "queue", "width",
                                                       "queue_key", "at", "doc_tokens", "ids")


def packed(docs: DataFrame, path: str, size: int = 2048, targets: dict[str, float] | None = None,
           key: str = "doc_id") -> DataFrame:
    """Pieces: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, source.

    ``targets`` gives the share of a source in every window; without it a source's share of all tokens is its target.
    """
    tokens = settled(tokenised(docs, path, key))
    spans = settled(tokens.groupBy("part", "queue_key").agg(F.sum("n").alias("n")))
    sources = spans.groupBy("queue_key").agg(F.sum("n").alias("total"))
    if targets:
        wanted = [(f"={k}" if k is not None else "-", float(v)) for k, v in targets.items()]
        wanted = docs.sparkSession.createDataFrame(wanted, "queue_key string, weight double")
        sources = sources.join(wanted, "queue_key", "left").na.fill(0.0, ["weight"])
    else:
        sources = sources.withColumn("weight", F.col("total").cast("double"))
    sources = settled(sources)
    # Targets are a table of the caller's, so each has a queue; sources without targets have as many as QUEUES allows.
    own = sources.filter("weight > 0") if targets else sources
    top = own.orderBy(F.desc("weight"), F.desc("total"), "queue_key").limit(len(targets) if targets else QUEUES - 1).collect()
    names = [r["queue_key"] for r in top]
    listed = docs.sparkSession.createDataFrame(list(zip(names, range(len(names)))), "queue_key string, queue int")
    sources = sources.join(F.broadcast(listed), "queue_key", "left").withColumn(
        "queue", F.coalesce("queue", F.lit(len(names)) + (F.col("weight") <= 0).cast("int")))
    joint = {r["queue"] - len(names): r for r in sources.filter(F.col("queue") >= len(names)).groupBy("queue")
             .agg(F.sum("total").alias("total"), F.sum("weight").alias("weight")).collect()}
    totals = [r["total"] for r in top] + [joint[k]["total"] if k in joint else 0 for k in (0, 1)]
    weights = [r["weight"] for r in top] + [joint[0]["weight"] if 0 in joint else 0.0, 0.0]
    plan = Plan(phases(totals, weights if targets else totals, size), size)
    # A row for each partition and source; the rows of one source are as many as partitions, not documents.
    order = Window.partitionBy("queue_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    rate = F.when(F.col("weight") > 0, F.col("weight") / max(sum(weights), 1e-300)).otherwise(F.col("total") / max(totals[-1], 1)) * size
    spans = settled(spans.withColumn("base", F.coalesce(F.sum("n").over(order), F.lit(0)))
                    .join(sources.select("queue_key", "queue", rate.alias("rate")), "queue_key")
                    .select("part", "queue_key", "queue", "rate", "base"))
    placed = tokens.join(spans, ["part", "queue_key"]).withColumn("start", F.col("base") + F.col("before"))
    fields = [key, "start", "n", "queue", "width", "queue_key", F.lit(0).cast("long").alias("at"), F.col("n").alias("doc_tokens"), "ids"]
    rows = placed.select(*fields)
    if joint:
        rows = (placed.filter(F.col("queue") < len(names)).select(*fields)
                .unionByName(_in_rounds(placed.filter(F.col("queue") >= len(names)), key)))

    def step(batch):
        starts, lengths, queues = (batch.column(c).to_numpy() for c in ("start", "n", "queue"))
        row, start, length, window, offset = plan.pieces(queues, starts, starts + lengths)
        order = np.argsort(row, kind="stable")
        row, start, length, window, offset = (x[order] for x in (row, start, length, window, offset))
        start = start - starts[row]
        at = batch.column("at").to_numpy()[row]
        sums, last, ids = [], -1, None
        bodies, widths = batch.column("ids"), batch.column("width").to_numpy()
        for r, s, n in zip(row.tolist(), start.tolist(), length.tolist()):
            if r != last:
                ids = np.frombuffer(bodies[r].as_buffer(), f"<u{widths[r]}").astype("<u4")
                last = r
            sums.append(zlib.crc32(ids[s:s + n].data))
        return [batch.column(key).take(_index(row)), start + at, length, sums, batch.column("doc_tokens").to_numpy()[row], window, offset,
                batch.column("queue_key").take(_index(row))]

    kind = docs.schema[key].dataType.simpleString()
    out = map_steps(rows, f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, _q string", step, "ids")
    return out.select(key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset",
                      F.when(F.col("_q") != "-", F.expr("substring(_q, 2)")).alias("source"))


def _index(rows: np.ndarray):
    return pa.array(rows)
