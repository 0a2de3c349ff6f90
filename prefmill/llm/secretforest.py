"""Secret scan: candidate strings, and a random forest that removes false positives.

A candidate is a run of at least ``SHORTEST`` characters of ``[A-Za-z0-9_+/=-]``, or what is assigned to a named
credential: non-blank characters of any kind and number, up to the closing quote or the next blank. Of a run that overlaps
such a value only what lies outside is a candidate. Its features, all over the whole candidate: length; entropy and kinds of
characters; how likely its character transitions are in the corpus; how much of it the corpus's common letter trigrams
cover (a dictionary that needs no word list); the document's path; and the words and signs before it. Transitions and
trigrams are counted over all documents. The forest (numpy, on the driver) is trained on at most ``SAMPLE`` labelled
findings of each class, chosen by hash; half of them lose their neighbouring words, so that a secret without a cue is
recognised too. Labelled findings may be given as a table (key, start, end, label): the forest is then trained from them
alone, each with the features of its own stretch of its document. Without them assignments to a named credential count as
secrets and strings of letters or of digits alone, or with common transitions, as false positives if no cue stands
before them.

Defined results: null and empty texts have no candidate; findings of no document, outside their text or with a null label
are ignored, and the same stretch labelled twice counts once for each label. Without findings of both classes the score of a candidate is 1
if a credential is named before it, else 0. Texts are read whole; repeated rows are scored alike.
"""

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from prefmill.llm.base import map_steps, steps
from prefmill.session import settled

SHORTEST = 16
SAMPLE = 3000
TREES, DEPTH, LEAF, CUTS = 25, 7, 5, 12
CUT = 0.5
COMMON = 2e-5  # share of all trigrams from which one is common
STEP = 1 << 16  # characters of a candidate that are looked at together

_CANDIDATE = re.compile(rf"[A-Za-z0-9_+/=-]{{{SHORTEST},}}")
#: Words that name a credential, words that name a harmless digest, and words of harmless paths.
SECRET_WORDS = ("key", "token", "secret", "passw", "pwd", "credential", "auth", "bearer", "private", "api")
DIGEST_WORDS = ("sha", "md5", "commit", "checksum", "hash", "uuid", "revision", "etag", "digest", "integrity")
HARMLESS_PATHS = ("test", "example", "sample", "fixture", "mock", "doc", "vendor", "lock")
_ASSIGNED = re.compile(r"(?:" + "|".join(SECRET_WORDS) + r")[\w.-]{0,20}[\"']?\s*(?:=|:|=>|:=)\s*[\"']?$", re.I)
_NAMED = re.compile(r"(?:" + "|".join(SECRET_WORDS) + r")[\w.-]{0,20}[\"']?\s*$", re.I)
_SIGN = re.compile(r"(?<![=!<>:])(?::=|=>|=(?!=)|:)\s*")
_QUOTED = {q: re.compile(rf"[^\s{q}]+(?={q})") for q in "\"'`"}
_PLAIN = re.compile(r"[A-Za-z0-9_+/=-]+")
_BARE = re.compile(r"[^\s\"'`]+")

_CODE = np.zeros(256, np.int64)  # 0: anything else, then letters without case, then digits
for _i, _c in enumerate(b"abcdefghijklmnopqrstuvwxyz0123456789"):
    _CODE[_c] = _i + 1
for _c in range(65, 91):
    _CODE[_c] = _CODE[_c + 32]
SIGNS = 37
FEATURES = 22


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of character trigrams over all texts, by code; a task hands on one row for each trigram."""
    def run(batches):
        total = np.zeros(SIGNS ** 3, np.int64)
        for batch in batches:
            for part in steps(batch):
                for text in part.column("text"):
                    if text.is_valid:
                        data = np.frombuffer(text.as_buffer(), np.uint8)
                        for at in range(0, max(0, len(data) - 2), 1 << 20):
                            c = _CODE[data[at:at + (1 << 20) + 2]]
                            total += np.bincount((c[:-2] * SIGNS + c[1:-1]) * SIGNS + c[2:], minlength=SIGNS ** 3)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"code": seen, "n": total[seen]})

    out = np.zeros(SIGNS ** 3, np.int64)
    for r in docs.select("text").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():
        out[r["code"]] = r["n"]
    return out


class Corpus:
    def __init__(self, counts: np.ndarray):
        pairs = counts.reshape(-1, SIGNS).sum(1)
        self.chance = np.log((counts + 0.5) / (np.repeat(pairs, SIGNS) + 0.5 * SIGNS)).astype(np.float32)
        self.common = counts >= COMMON * max(1, counts.sum())

    def _read(self, found: str):
        """Bytes, counts of byte values, of capitals, small letters, digits, hexadecimal digits, of changes of kind and of
        repeats, and sum, least and number of the trigrams' chances and number of common ones; in bounded steps."""
        counts, sums = np.zeros(256, np.int64), np.zeros(6)
        chance, least, tris, common = 0.0, 0.0, 0, 0
        last = b""
        for at in range(0, len(found), STEP):
            data = np.frombuffer(last + found[at:at + STEP].encode("utf-8", "replace"), np.uint8)
            new = data[len(last):]
            counts += np.bincount(new, minlength=256)
            upper, lower, digit = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122), (data >= 48) & (data <= 57)
            kind = upper * 1 + lower * 2 + digit * 3
            hexadecimal = digit | ((data | 32) >= 97) & ((data | 32) <= 102) & (upper | lower)
            own = slice(len(last), None)
            pair = slice(max(len(last) - 1, 0), None)  # pairs that end in this step
            sums += [upper[own].sum(), lower[own].sum(), digit[own].sum(), hexadecimal[own].sum(),
                     (kind[1:] != kind[:-1])[pair].sum(), (data[1:] == data[:-1])[pair].sum()]
            code = _CODE[data]
            tri = (code[:-2] * SIGNS + code[1:-1]) * SIGNS + code[2:]
            if len(tri):
                chances = self.chance[tri]
                chance, least = chance + float(chances.sum(dtype=float)), min(least, float(chances.min()))
                tris, common = tris + len(tri), common + int(self.common[tri].sum())
            last = data[-2:].tobytes()
        return counts, sums, chance, least, tris, common

    def features(self, text: str, start: int, end: int, path: str, hide: bool = False) -> list[float]:
        counts, sums, chance, least, tris, common = self._read(text[start:end])
        n = int(counts.sum())
        used = counts[counts > 0] / n
        upper, lower, digit, hexadecimal = sums[:4] / n
        changes, repeats = sums[4:] / max(1, n - 1)
        before = "" if hide else text[max(0, start - 40):start].lower()
        after = "" if hide else text[end:end + 1]
        place = path.lower()
        return [end - start, -(used * np.log2(used)).sum(), upper, lower, digit, hexadecimal,
                1 - upper - lower - digit, changes, repeats, len(used) / n,
                chance / tris if tris else -np.log(SIGNS), least if tris else -np.log(SIGNS), common / max(1, tris), (end - start) % 8 == 0,
                any(w in before for w in SECRET_WORDS), any(w in before for w in DIGEST_WORDS),
                before.rstrip(" \"'").endswith(("=", ":", ">")), before[-1:] in ("\"", "'") and before[-1:] == after,
                before[-1:] in ("/", ".", "@"), place.count("/"), any(w in place for w in HARMLESS_PATHS), "." in place[-6:]]

    def weak_label(self, text: str, start: int, end: int) -> int | None:
        """1: assigned to a named credential; 0: letters or digits alone, or common transitions, without a cue; None: undecided."""
        before, found = text[max(0, start - 40):start], text[start:end]
        digits = any(c.isdigit() for c in found)
        assigned = _ASSIGNED.search(before)
        if digits and assigned:
            return 1
        if assigned and not _PLAIN.fullmatch(found):
            return None  # signs without digits may be a password
        if not digits or not any(c.isalpha() for c in found) and not any(w in before.lower() for w in SECRET_WORDS):
            return 0
        _, _, _, _, tris, common = self._read(found)
        return 0 if common > 0.5 * tris and not any(w in before.lower() for w in SECRET_WORDS) else None


def spans_of(text: str) -> list[tuple[int, int]]:
    """Start and end of the candidates of a text, in order."""
    values, stop = [], 0
    for m in _SIGN.finditer(text):
        if not _NAMED.search(text[max(0, m.start() - 60):m.start()]):
            continue
        start = m.end()
        if (quote := text[start:start + 1]) in _QUOTED:
            found = _QUOTED[quote].match(text, start + 1)
            if not found:
                continue
            start, end = found.span()
        else:
            if start >= stop:
                found = _BARE.match(text, start)
                stop = found.end() if found else start
            end = stop
            while end > start and text[end - 1] in ",;.)]}":
                end -= 1
        if values and start < values[-1][1]:  # an assignment inside the value of another
            values.pop()
        if end > start:
            values.append((start, end))
    out, k = [], 0
    for m in _CANDIDATE.finditer(text):
        start, end = m.span()
        while k < len(values) and values[k][1] <= start:
            out.append(values[k])
            k += 1
        while k < len(values) and values[k][0] < end:
            if values[k][0] - start >= SHORTEST:
                out.append((start, values[k][0]))
            start = max(start, values[k][1])
            if values[k][1] > end:  # it may meet the next run too
                break
            out.append(values[k])
            k += 1
        if end - start >= SHORTEST:
            out.append((start, end))
    return out + values[k:]


class Forest:
    """Trees as arrays: feature (-1: leaf), cut, child to the left (the other is the next one) and share of secrets."""

    def __init__(self):
        self.trees: list[tuple[np.ndarray, ...]] = []

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 3):
        rng = np.random.default_rng(seed)
        for _ in range(TREES):
            rows = rng.integers(0, len(y), len(y))
            self.trees.append(self._grow(x[rows], y[rows], rng))
        return self

    def _grow(self, x, y, rng):
        feature, cut, left, value = [-1], [0.0], [0], [float(y.mean())]
        todo = [(0, np.arange(len(y)), 0)]
        while todo:
            node, rows, depth = todo.pop()
            p = y[rows].mean()
            if depth == DEPTH or len(rows) < 2 * LEAF or p in (0.0, 1.0):
                continue
            best = (2 * p * (1 - p) * len(rows) - 1e-9, -1, 0.0)
            for f in rng.choice(x.shape[1], max(1, int(np.sqrt(x.shape[1]))), replace=False):
                column = x[rows, f]
                for c in np.unique(np.quantile(column, np.linspace(0.04, 0.96, CUTS))):
                    low = column <= c
                    n = int(low.sum())
                    if LEAF <= n <= len(rows) - LEAF:
                        a, b = y[rows][low].mean(), y[rows][~low].mean()
                        impurity = 2 * a * (1 - a) * n + 2 * b * (1 - b) * (len(rows) - n)
                        best = min(best, (impurity, int(f), float(c)))
            if best[1] < 0:
                continue
            low = x[rows, best[1]] <= best[2]
            feature[node], cut[node], left[node] = best[1], best[2], len(feature)
            for part in (rows[low], rows[~low]):
                todo.append((len(feature), part, depth + 1))
                feature.append(-1)
                cut.append(0.0)
                left.append(0)
                value.append(float(y[part].mean()))
        return tuple(map(np.array, (feature, cut, left, value)))

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, cut, left, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                f = feature[at]
                go = f >= 0
                right = x[np.arange(len(x)), np.maximum(f, 0)] > cut[at]
                at = np.where(go, left[at] + right, at)
            total += value[at]
        return total / max(1, len(self.trees))


def candidates(docs: DataFrame, corpus: Corpus, findings: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """label, features and ordering hash of every labelled candidate. ``findings``: key, start, end (code points, end
    exclusive), label; each document gets its own by a join on the key, so no document and no finding is read alone. Without
    findings the labels are weak ones."""
    given = findings is not None
    rows = docs.select("text", _path(docs))
    if given:
        # One row for each finding: a document with very many of them is spread over tasks like any other rows.
        marks = findings.select(key, F.col("start").cast("long"), F.col("end").cast("long").alias("stop"), F.col("label").cast("int").alias("label"))
        marks = marks.filter("label IN (0, 1) AND start >= 0 AND stop > start").distinct()
        rows = docs.select(key, "text", _path(docs)).join(marks, key).filter("stop <= char_length(text)").select("text", "path", "start", "stop", "label")
    shared = docs.sparkSession.sparkContext.broadcast(corpus)  # two numbers for each of SIGNS^3 trigrams

    def run(batches):
        corpus = shared.value
        for batch in batches:
            label, order, values = [], [], []
            marked = zip(*(batch.column(c).to_pylist() for c in ("start", "stop", "label"))) if given else None
            for text, path in zip(batch.column("text").to_pylist(), batch.column("path").to_pylist()):
                if given:
                    start, end, known = next(marked)
                    found = [(start, end, known)]
                else:
                    found = [(start, end, corpus.weak_label(text, start, end)) for start, end in spans_of(text or "")]
                for start, end, known in found:
                    if known is not None:
                        place = zlib.crc32(text[max(0, start - 40):end].encode())
                        # The most even hashes only: each task hands on what could be among the first SAMPLE.
                        label.append(known)
                        order.append(place)
                        values.append((text, (start, end), path, place))
            keep = [i for k in (0, 1) for i in sorted((i for i, y in enumerate(label) if y == k), key=order.__getitem__)[:SAMPLE]]
            rows = [corpus.features(values[i][0], *values[i][1], values[i][2], hide=values[i][3] % 2 == 0) for i in keep]
            yield pa.RecordBatch.from_pydict({
                "label": pa.array([label[i] for i in keep], pa.int32()), "place": pa.array([order[i] for i in keep], pa.int64()),
                "x": pa.array([[float(v) for v in r] for r in rows], pa.list_(pa.float64()))})

    return rows.mapInArrow(run, "label int, place long, x array<double>")


def _path(docs: DataFrame):
    return F.coalesce(F.col("source").cast("string"), F.lit("")).alias("path") if "source" in docs.columns else F.lit("").alias("path")


def train(docs: DataFrame, corpus: Corpus, findings: DataFrame | None = None, key: str = "doc_id") -> Forest | None:
    """A forest from the labelled findings with the smallest hashes; copies of one finding count once. The hash is uniform, so a
    bound on it leaves about twice the sample, however many tasks there are, and only that meets on the driver."""
    found = settled(candidates(docs, corpus, findings, key).groupBy("label", "place").agg(F.min("x").alias("x")))
    sizes = {r["label"]: r["n"] for r in found.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = []
    for y, n in sorted(sizes.items()):
        near = found.filter((F.col("label") == y) & (F.col("place") <= int((1 << 32) * min(1.0, 2 * SAMPLE / n))))
        rows += near.orderBy("place", "x").limit(SAMPLE).collect()
    y = np.array([r["label"] for r in rows])
    if not len(y) or y.all() or not y.any():
        return None
    return Forest().fit(np.array([r["x"] for r in rows]), y.astype(float))


def scan(docs: DataFrame, key: str = "doc_id", findings: DataFrame | None = None) -> DataFrame:
    """key, n_candidates, n_secrets, score (of the likeliest; 0 without candidates), spans (start:end, comma-joined).
    ``findings``: labelled stretches (key, start, end, label) to train from instead of weak labels."""
    corpus = Corpus(trigram_counts(docs))
    forest = train(docs, corpus, findings, key)
    shared = docs.sparkSession.sparkContext.broadcast((corpus, forest))

    def step(batch):
        corpus, forest = shared.value
        spans, x, owner, cued = [], [], [], []
        for i, (text, path) in enumerate(zip(batch.column("text").to_pylist(), batch.column("path").to_pylist())):
            for start, end in spans_of(text or ""):
                spans.append((start, end))
                owner.append(i)
                x.append(corpus.features(text, start, end, path))
                cued.append(float(bool(_ASSIGNED.search(text[max(0, start - 40):start]))))
        n = batch.num_rows
        x = np.array(x, float).reshape(-1, FEATURES)
        score = forest.scores(x) if forest else np.array(cued)
        owner = np.array(owner, np.int64)
        hit = score >= CUT
        best = np.zeros(n)
        np.maximum.at(best, owner, score)
        told = [[] for _ in range(n)]
        for i in np.flatnonzero(hit):
            told[owner[i]].append(f"{spans[i][0]}:{spans[i][1]}")
        return [batch.column(key), np.bincount(owner, minlength=n), np.bincount(owner[hit], minlength=n), best, [",".join(t) for t in told]]

    kind = docs.schema[key].dataType.simpleString()
    return map_steps(docs.select(key, "text", _path(docs)),
                     f"`{key}` {kind}, n_candidates long, n_secrets long, score double, spans string", step)
