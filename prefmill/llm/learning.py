"""Samples of labelled documents, and the last step of two-class models."""

import numpy as np
from pyspark.sql import DataFrame, functions as F


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def platt(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a weighted logistic fit by Newton steps."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * x + b)
        g, h = w * (p - y), np.maximum(w * p * (1 - p), 1e-9)
        m = np.array([[np.sum(h * x * x) + 1e-3, np.sum(h * x)], [np.sum(h * x), np.sum(h) + 1e-3]])
        step = np.linalg.solve(m, [np.sum(g * x) + 1e-3 * (a - 1), np.sum(g)])
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -2, 2))
    return max(a, 1e-3), b


def sampled(docs: DataFrame, labels: DataFrame, label: str, train_rows, per_class: int):
    """Texts and labels of at most ``per_class`` documents of each class, by hash of the id, and the class sizes."""
    marked = (labels.filter(train_rows & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
              .groupBy("doc_id").agg((F.max(label) > 0).alias("_y")))
    sizes = {r["_y"]: r["n"] for r in marked.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    ids = [marked.filter(F.col("_y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (False, True)]
    ids = F.broadcast(ids[0].unionByName(ids[1]))  # at most 2 * per_class rows
    rows = docs.select("doc_id", "text").join(ids, "doc_id").groupBy("doc_id", "_y").agg(F.min("text").alias("text"))
    found = sorted(rows.collect(), key=lambda r: r["doc_id"])
    return [r["text"] or "" for r in found], np.array([r["_y"] for r in found], bool), (sizes.get(False, 0), sizes.get(True, 0))
