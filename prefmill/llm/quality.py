"""Quality by a factorisation machine over hashed words, structure statistics and the text's length.

score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]): the second part is all pairwise
interactions of low rank, in time linear in the features that occur.

Features: distinct words hashed to buckets, weighted by the root of their count and scaled to unit length; and statistics
of the text's structure (kinds of characters, word lengths, repetition, length), standardised on the training sample.
Training (numpy, Adagrad, on the driver) sees at most ``SAMPLE`` labelled documents of each class, chosen by hash of the
id; scores are then calibrated to the class sizes of all training labels.

Defined results: null, empty and blank texts have zero words and the statistics of an empty text. Without labels of both
classes every score is the share of label 1 (1 without labels). Repeated labels of one id: 1 if any says so.
"""

import numpy as np
from pyspark.sql import DataFrame, functions as F

from prefmill.llm.base import fold, map_steps
from prefmill.llm.learning import platt, sampled, sigmoid
from prefmill.llm.shingles import word_lists

SAMPLE = 3000
BITS = 15
RANK = 6
EPOCHS = 8
RATE, DECAY = 0.1, 1e-4
CUT = 0.3

_KINDS = np.zeros((256, 9), np.float32)  # upper, lower, digit, blank, line end, stop, mark, other sign, beyond ASCII
for _c in range(256):
    _ch = chr(_c)
    _KINDS[_c, 8 if _c > 127 else 0 if _ch.isupper() else 1 if _ch.islower() else 2 if _ch.isdigit() else 4 if _ch == "\n"
           else 3 if _ch.isspace() else 5 if _ch in ".,;:" else 6 if _ch in "!?\"'()-" else 7] = 1
STATISTICS = 9 + 8


def statistics(data: bytes, words: np.ndarray, distinct: np.ndarray, number: np.ndarray) -> np.ndarray:
    n, w = len(data) + 1.0, len(words) + 1.0
    kinds = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _KINDS
    top = np.sort(number)[-5:]
    return np.array([*np.sqrt(kinds / n), np.log(n), np.log(w), n / w, len(distinct) / w, top.max(initial=0) / w, top.sum() / w,
                     np.count_nonzero(words[1:] == words[:-1]) / w, np.log1p(kinds[4]) - np.log1p(kinds[5])], np.float32)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets and weights of all words, the number of them in each text, and the statistics of each text."""
    ids, weights, sizes, stats = [], [], [], np.zeros((len(texts), STATISTICS), np.float32)
    for i, words in enumerate(word_lists(texts)):
        distinct, number = np.unique(words, return_counts=True)
        stats[i] = statistics(texts[i], words, distinct, number)
        weight = np.sqrt(number).astype(np.float32)
        ids.append((distinct >> np.uint64(64 - BITS)).astype(np.int32))
        weights.append(weight / max(np.linalg.norm(weight), 1.0))
        sizes.append(len(distinct))
    return (np.concatenate(ids) if ids else np.empty(0, np.int32), np.concatenate(weights) if ids else np.empty(0, np.float32),
            np.array(sizes, np.int64), stats)


class Machine:
    """Weights of buckets and, after them, of statistics. ``factors`` has RANK numbers for each."""

    def __init__(self, rng: np.random.Generator):
        self.bias = 0.0
        self.weights = np.zeros((1 << BITS) + STATISTICS, np.float32)
        self.factors = rng.normal(0, 0.05, (len(self.weights), RANK)).astype(np.float32)
        self.mean, self.spread = np.zeros(STATISTICS, np.float32), np.ones(STATISTICS, np.float32)
        self.scale, self.prior = None, 1.0

    def joined(self, found):
        """All features of all texts as (text, feature, value)."""
        ids, weights, sizes, stats = found
        z = np.clip((stats - self.mean) / self.spread, -4, 4) / 2
        n = len(sizes)
        owner = np.concatenate([np.repeat(np.arange(n), sizes), np.repeat(np.arange(n), STATISTICS)])
        feature = np.concatenate([ids, np.tile(np.arange(STATISTICS, dtype=np.int32) + (1 << BITS), n)])
        return owner, feature, np.concatenate([weights, z.ravel()]), n

    def margins(self, found) -> tuple[np.ndarray, np.ndarray]:
        owner, feature, value, n = self.joined(found)
        linear = np.bincount(owner, self.weights[feature] * value, n)
        mixed = self.factors[feature] * value[:, None]
        total = np.stack([np.bincount(owner, mixed[:, f], n) for f in range(RANK)], 1)
        squares = np.bincount(owner, (mixed * mixed).sum(1), n)
        return self.bias + linear + 0.5 * ((total * total).sum(1) - squares), total

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.scale is None:
            return np.full(len(texts), self.prior)
        return sigmoid(self.scale[0] * self.margins(features(texts))[0] + self.scale[1])


def train(texts: list[str], good: np.ndarray, class_sizes: tuple[int, int], seed: int = 17) -> Machine:
    rng = np.random.default_rng(seed)
    model = Machine(rng)
    n0, n1 = class_sizes
    model.prior = n1 / (n0 + n1) if n0 + n1 else 1.0
    if not len(good) or good.all() or not good.any():
        return model
    data = [t.encode("utf-8", "replace") for t in texts]
    parts = [features(data[i:i + 200]) for i in range(0, len(data), 200)]
    ids, weights, sizes, stats = (np.concatenate([p[k] for p in parts]) for k in range(4))
    starts = np.cumsum(sizes) - sizes
    model.mean, model.spread = stats.mean(0), np.maximum(stats.std(0), 1e-3)
    y = good.astype(np.float64)
    balance = np.where(good, 0.5 / good.mean(), 0.5 / (1 - good.mean()))
    seen_w, seen_v, seen_b = np.full(len(model.weights), 1e-3, np.float32), np.full(model.factors.shape, 1e-3, np.float32), 1e-3
    for _ in range(EPOCHS):
        for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // 64)):
            take = np.concatenate([np.arange(starts[r], starts[r] + sizes[r]) for r in rows])
            found = ids[take], weights[take], sizes[rows], stats[rows]
            margin, total = model.margins(found)
            error = (sigmoid(margin) - y[rows]) * balance[rows] / len(rows)
            owner, feature, value, _ = model.joined(found)
            slope = error[owner] * value
            touched, where = np.unique(feature, return_inverse=True)
            grad = np.bincount(where, slope, len(touched)) + DECAY * model.weights[touched]
            seen_w[touched] += grad.astype(np.float32) ** 2
            model.weights[touched] -= (RATE * grad / np.sqrt(seen_w[touched])).astype(np.float32)
            pull = slope[:, None] * (total[owner] - model.factors[feature] * value[:, None])
            grad = np.stack([np.bincount(where, pull[:, f], len(touched)) for f in range(RANK)], 1) + DECAY * model.factors[touched]
            seen_v[touched] += grad.astype(np.float32) ** 2
            model.factors[touched] -= (RATE * grad / np.sqrt(seen_v[touched])).astype(np.float32)
            seen_b += float(error.sum()) ** 2
            model.bias -= RATE * float(error.sum()) / np.sqrt(seen_b)
    margin = np.concatenate([model.margins(p)[0] for p in parts])
    w = np.where(good, n1 / good.sum(), n0 / (~good).sum()) / (n0 + n1) * len(good)
    model.scale = platt(margin, y, w)
    return model


def fitted(docs: DataFrame, labels: DataFrame, train_rows) -> Machine:
    return train(*sampled(docs, labels, "quality", train_rows, SAMPLE))


def predictions(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, fold("doc_id", folds) != held))  # under 2 MB

    def step(batch):
        texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column("text")]
        return [batch.column("doc_id"), shared.value.scores(texts)]

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = map_steps(docs.select("doc_id", "text"), f"doc_id {kind}, score double", step)
    return out.select("doc_id", (fold("doc_id", folds) == held).alias("held_out"), "score",
                      (F.col("score") >= CUT).cast("int").alias("predicted"))
