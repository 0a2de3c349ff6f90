"""Toxicity: character n-gram embeddings averaged into a linear softmax, trained jointly in numpy.

A text is lower-cased, punctuation becomes white space, and every word with its borders gives its 3- to 6-byte grams,
hashed to buckets. A passage is two neighbouring blocks of four words, in which a word that repeats the one before counts
once; its vector is the mean of its gram vectors, filled up to ``FEWEST`` with neutral ones. As
the softmax is linear, a passage's score is the mean of one number per gram, so scoring reads one table and holds one
number per byte. A document scores as its most toxic passage, calibrated on training documents; an unseen misspelling
still shares most grams with the word it stands for.

Training (in numpy, on the driver) sees at most ``SAMPLE`` labelled documents of each class, chosen by hash of the id,
and every passage of each. An epoch goes through the documents in random order, ``CHUNK`` characters at a time, and makes
their grams anew, so only texts and a few numbers for each passage stay in memory. Passages of a toxic document share its
label by how toxic they seem so far; toxic documents in which nothing seems so are label noise and lose their weight.

Defined results: null, empty or blank texts score as a document without any toxic sign. Without labels of both classes
every score is the share of toxic labels (0 without labels). Repeated labels of one id: toxic if any says so.
"""

import numpy as np
from pyspark.sql import DataFrame, functions as F

from prefmill.llm.base import fold, map_steps
from prefmill.llm.learning import platt, sampled, sigmoid
from prefmill.llm.shingles import words

SAMPLE = 1500
CHUNK = 500_000
#: Characters scored at once; their grams take about a hundred bytes each.
SCORED = 250_000
BLOCK = 4
FEWEST = 100  # a passage with fewer grams is averaged as if neutral ones filled it up
GRAMS = range(3, 7)
BUCKETS = 1 << 17
DIMENSIONS = 8
EPOCHS = 6
RATE = 0.3
CUT = 0.7
#: Characters often put in the place of a letter.
LOOKALIKES = {"a": "4", "e": "3", "i": "1", "o": "0", "s": "5", "t": "7"}

_PUNCTUATION = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))
_TO_BLANK = bytes.maketrans(_PUNCTUATION + bytes(range(32)) + b"\x7f", b" " * (len(_PUNCTUATION) + 33))
_PLACE = np.random.default_rng(7).integers(0, 1 << 32, (GRAMS[-1], 256), dtype=np.uint32)


class Grams:
    """Gram buckets of several texts at once. ``ids`` has a row per byte and a column per gram length; 0 is no gram.
    Blocks are runs of at most BLOCK words of one text; block b covers the rows starts[b] to starts[b + 1]."""

    def __init__(self, texts: list[str]):
        data = [b" " + t.lower().encode("utf-8", "replace").translate(_TO_BLANK) for t in texts]
        buf = np.frombuffer(b"".join(data) + b" " * GRAMS[-1], np.uint8)
        ends = np.cumsum([len(d) for d in data])
        n = int(ends[-1]) if len(ends) else 0
        letter = buf != 32
        self.ids = np.zeros((n, len(GRAMS)), np.int32)
        code = _PLACE[0][buf[:n]]
        inner = np.ones(n, bool)
        for size in range(2, GRAMS[-1] + 1):
            code = code + _PLACE[size - 1][buf[size - 1:n + size - 1]]
            if size > 2:
                inner &= letter[size - 2:n + size - 2]
            if size in GRAMS:
                bucket = ((code + np.uint32(size)) * np.uint32(0x9E3779B1)) >> np.uint32(15)
                self.ids[:, size - GRAMS[0]] = np.where(inner, np.maximum(bucket, 1), 0)
        hashes, first = words(buf[:n].tobytes())
        first -= 1  # the blank before each word
        owner = np.searchsorted(ends, first, side="right")
        again = np.zeros(len(first), bool)  # a word that repeats the one before counts once
        again[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
        spans = np.diff(np.append(first, n))
        self.ids[first[0] if len(first) else n:][np.repeat(again, spans)] = 0
        first, owner = first[~again], owner[~again]
        counts = np.bincount(owner, minlength=len(data))
        rank = np.arange(len(first)) - np.repeat(np.cumsum(counts) - counts, counts)
        head = rank % BLOCK == 0
        self.starts, self.owner, self.rows = first[head], owner[head], n
        self.blocks = np.bincount(self.owner, minlength=len(data))

    def passages(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and last block (inclusive) and text of each passage."""
        number = np.arange(len(self.starts))
        same = np.append(self.owner[1:] == self.owner[:-1], False) if len(number) else np.zeros(0, bool)
        alone = same.copy()
        if len(number):
            alone[1:] |= same[:-1]
        return np.concatenate([number[same], number[~alone]]), np.concatenate([number[same] + 1, number[~alone]]), \
            np.concatenate([self.owner[same], self.owner[~alone]])


class Model:
    def __init__(self, table: np.ndarray, bias: float, scale: tuple[float, float], prior: float):
        self.table, self.bias, self.scale, self.prior = table, bias, scale, prior

    def margins(self, texts: list[str]) -> np.ndarray:
        """The largest passage margin of each text; minus infinity without words."""
        out = np.full(len(texts), -np.inf)
        grams = Grams(texts)
        if not len(grams.starts):
            return out
        value = self.table[grams.ids].sum(1)
        number = (grams.ids != 0).sum(1)
        totals = np.add.reduceat(value, grams.starts)
        numbers = np.add.reduceat(number, grams.starts)
        a, b, owner = grams.passages()
        both = a != b
        total = totals[a] + np.where(both, totals[b], 0)
        margin = total / np.maximum(numbers[a] + np.where(both, numbers[b], 0), FEWEST) + self.bias
        np.maximum.at(out, owner, margin)
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.scale is None:
            return np.full(len(texts), self.prior)
        return sigmoid(self.scale[0] * np.maximum(self.margins(texts), -30) + self.scale[1])


def misspelt(text: str, rng: np.random.Generator) -> str:
    """Every word of five or more characters with one letter doubled, dropped, swapped with the next or swapped for a
    look-alike, so that training sees what evasive spelling does to the grams of words of either class."""
    out = []
    words = text.split()
    for word, kind, where in zip(words, rng.integers(0, 4, len(words)), rng.random(len(words))):
        i = 1 + int(where * (len(word) - 2)) if len(word) > 4 else 0
        if i and kind == 0:
            word = word[:i] + word[i] + word[i:]
        elif i and kind == 1:
            word = word[:i] + word[i + 1:]
        elif i and kind == 2:
            word = word[:i] + word[i:i + 2][::-1] + word[i + 2:]
        elif i:
            word = word[:i] + LOOKALIKES.get(word[i], word[i]) + word[i + 1:]
        out.append(word)
    return " ".join(out)


def _ranges(starts, ends):
    n = ends - starts
    return np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(int(n.sum())), n


def _chunks(order: np.ndarray, sizes: np.ndarray):
    """``order`` in consecutive parts whose sizes add up to about CHUNK; a longer document is a part of its own."""
    at, held = 0, 0
    for i, size in enumerate(sizes[order]):
        if held and held + size > CHUNK:
            yield order[at:i]
            at, held = i, 0
        held += size
    if at < len(order):
        yield order[at:]


def train(texts: list[str], toxic: np.ndarray, class_sizes: tuple[int, int], seed: int = 11) -> Model:
    """``class_sizes``: labelled documents without and with the label, of which the texts are samples."""
    n0, n1 = class_sizes
    prior = n1 / max(1, n0 + n1)
    if toxic.all() or not toxic.any():
        return Model(np.zeros(BUCKETS, np.float32), 0.0, None, prior)
    rng = np.random.default_rng(seed)
    real, real_toxic = texts, toxic
    kept = np.zeros(len(real), bool)  # for calibration: every fifth document of each class, if there are five
    for c in (False, True):
        kept[np.flatnonzero(toxic == c)[4::5]] = True
    if not all((toxic[kept] == c).any() for c in (False, True)):
        kept[:] = False
    texts, toxic = [t for t, k in zip(texts, kept) if not k], toxic[~kept]
    texts = [*texts, *(misspelt(t, rng) for t in texts)]
    total = len(texts)
    toxic = np.concatenate([toxic, toxic])
    sizes = np.array([len(t) for t in texts])
    blocks = np.concatenate([Grams([texts[i] for i in part]).blocks for part in _chunks(np.arange(total), sizes)])
    per_doc = np.where(blocks > 0, np.maximum(blocks - 1, 1), 0)
    first = np.cumsum(per_doc) - per_doc
    owner = np.repeat(np.arange(total, dtype=np.int32), per_doc)
    sharpness = 4 + np.log(np.maximum(per_doc / 12, 1)).astype(np.float32)  # one passage outweighs any number of others
    y = toxic[owner].astype(np.float32)
    vectors = rng.uniform(-0.5, 0.5, (BUCKETS, DIMENSIONS)).astype(np.float32)
    vectors[0] = 0
    out, bias = rng.normal(0, 1, DIMENSIONS).astype(np.float32), 0.0
    seen_v, seen_o, seen_b = np.full((BUCKETS, DIMENSIONS), 1e-6, np.float32), np.full(DIMENSIONS, 1e-6, np.float32), 1e-6
    weight = (1.0 / per_doc[owner]).astype(np.float32)
    margin = np.zeros(len(owner), np.float32)
    for epoch in range(EPOCHS):
        if epoch:
            belief = sigmoid(margin)
            most = np.zeros(total, np.float32)
            np.maximum.at(most, owner, belief)
            share = np.exp(sharpness[owner] * (belief - most[owner]))
            share /= np.bincount(owner, share, total)[owner]
            noise = most[owner] < 0.3 if epoch > 1 else np.zeros(len(owner), bool)
            weight = np.where(y > 0, np.where(noise, 0.0, share), 0.5 / per_doc[owner] + 0.5 * share).astype(np.float32)
        for w in (0, 1):  # both classes weigh the same
            weight[y == w] /= max(weight[y == w].sum(dtype=float) / (len(owner) / 2), 1e-9)
        for docs in _chunks(rng.permutation(total), sizes):
            grams = Grams([texts[i] for i in docs])
            a, b, own = grams.passages()
            order = np.lexsort((a, own))
            a, b, own = a[order], b[order], own[order]
            place, _ = _ranges(first[docs], first[docs] + per_doc[docs])  # of each passage among all
            begin, end = grams.starts[a], np.append(grams.starts, grams.rows)[b + 1]
            mixed = rng.permutation(len(place))
            for part in np.array_split(mixed, max(1, len(mixed) // 512)) if len(mixed) else ():
                at = place[part]
                rows, n = _ranges(begin[part], end[part])
                found = grams.ids[rows]
                heads = np.cumsum(n) - n
                number = np.maximum(np.add.reduceat((found != 0).sum(1), heads), FEWEST)
                mean = np.add.reduceat(vectors[found].sum(1), heads, axis=0) / number[:, None]
                margin[at] = mean @ out + bias
                error = (sigmoid(margin[at]) - y[at]) * weight[at] / len(part)
                grad_o, grad_b = mean.T @ error, float(error.sum())
                grad = np.bincount(found.ravel(), np.repeat(error / number, n * len(GRAMS)), BUCKETS)
                grad[0] = 0  # no gram
                touched = np.flatnonzero(grad)
                g = (grad[touched, None] * out).astype(np.float32)
                seen_v[touched] += g * g
                vectors[touched] -= RATE * g / np.sqrt(seen_v[touched])
                seen_o += grad_o.astype(np.float32) ** 2
                out -= (0.1 * grad_o / np.sqrt(seen_o)).astype(np.float32)
                seen_b += grad_b ** 2
                bias -= 0.1 * grad_b / np.sqrt(seen_b)
    model = Model((vectors @ out).astype(np.float32), bias, (1.0, 0.0), prior)
    model.table[0] = 0
    if kept.any():  # margins of documents it was trained on would flatter the model
        real, real_toxic = [t for t, k in zip(real, kept) if k], real_toxic[kept]
    sizes = np.array([len(t) for t in real])
    x = np.concatenate([model.margins([real[i] for i in part]) for part in _chunks(np.arange(len(real)), sizes)])
    known = np.isfinite(x)
    w = np.where(real_toxic, n1 / real_toxic.sum(), n0 / (~real_toxic).sum()) / (n0 + n1) * len(real)
    model.scale = platt(x[known], real_toxic[known].astype(float), w[known]) if known.any() else None
    return model


def fitted(docs: DataFrame, labels: DataFrame, train_rows) -> Model:
    return train(*sampled(docs, labels, "toxic", train_rows, SAMPLE))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers, half a megabyte

    def step(batch):
        return [batch.column("doc_id"), shared.value.scores([t or "" for t in batch.column("text").to_pylist()])]

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_steps(docs.select("doc_id", "text"), f"doc_id {kind}, score double", step, limit=SCORED)


def predictions(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = fitted(docs, labels, fold("doc_id", folds) != held)
    return scored(docs, model).select("doc_id", (fold("doc_id", folds) == held).alias("held_out"), "score",
                                      (F.col("score") >= CUT).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """The rows of ``docs`` that are not predicted to be toxic, all columns."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, fold("doc_id", folds) != held))

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd
        values = [t or "" for t in texts]
        out, at = [], 0
        while at < len(values):  # bounded steps, as in map_steps
            size, end = 0, at
            while end < len(values) and (end == at or size + len(values[end]) <= SCORED):
                size += len(values[end])
                end += 1
            out.append(shared.value.scores(values[at:end]))
            at = end
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return docs.filter(score("text") < CUT)
