"""Language by rank-order profiles: a document's most frequent character n-grams against those of each language.

A text is lower-cased; letters stay, everything else separates words, and a word's n-grams of one to three code points
take in its borders. The profile of a language is its ``PROFILE`` most frequent n-grams over all training documents. The
out-of-place distance adds up how far each of a document's n-grams stands from its place in the profile; one that is not
there costs ``PROFILE``. Equally frequent n-grams share their mean place. The nearest language wins, ties by name.

Defined results: a null text or one without a letter is ``und`` with score 0, and so is every text when there is nothing
to learn from. Null languages are not learned. Texts are read whole, in parts of bounded size.
"""

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from prefmill.llm.base import fold, map_steps, steps

PROFILE = 400
LONGEST = 3
PART = 1 << 20
UNKNOWN = "und"
BORDER = np.uint64((1 << 21) - 1)  # beyond every code point


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _part(text: str, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n-grams that end in ``text``, packed with 21 bits a code point, and the last code points to carry on."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    points = np.where(_letters()[points], points, BORDER).astype(np.uint64)
    points = np.concatenate([before, points])
    new = len(before)
    keep = np.ones(len(points), bool)  # one border between two words
    keep[new:] = (points[new:] != BORDER) | (points[new - 1:-1] != BORDER)
    points = points[keep]
    found = []
    for n in range(1, LONGEST + 1):
        first = max(0, new - n + 1)
        count = len(points) - first - n + 1
        if count <= 0:
            continue
        code, ok = np.zeros(count, np.uint64), np.ones(count, bool)
        for j in range(n):
            here = points[first + j:first + j + count]
            code = (code << np.uint64(21)) | here
            if n == 1 or 0 < j < n - 1:
                ok &= here != BORDER
        found.append(code[ok])
    return (np.concatenate(found) if found else np.empty(0, np.uint64)), points[-(LONGEST - 1):]


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text, ascending, and how often each occurs."""
    grams, number, carry = np.empty(0, np.uint64), np.empty(0, np.int64), np.array([BORDER])
    for at in range(0, len(text), PART):
        part = text[at:at + PART] + (" " if at + PART >= len(text) else "")
        more, carry = _part(part, carry)
        unique, n = np.unique(more, return_counts=True)
        grams, number = (unique, n) if not at else merged([grams, unique], [number, n])
    return grams, number


def merged(grams: list[np.ndarray], numbers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    unique, where = np.unique(np.concatenate(grams), return_inverse=True)
    return unique, np.bincount(where, np.concatenate(numbers), len(unique)).astype(np.int64)


def ranks(grams: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The PROFILE most frequent n-grams (ties by code) and their places; equal counts share the mean place."""
    top = np.argsort(-number, kind="stable")[:PROFILE]
    n = number[top]
    first = np.flatnonzero(np.concatenate([[True], n[1:] != n[:-1]]))
    size = np.diff(np.append(first, len(n)))
    return grams[top], np.repeat(first + (size - 1) / 2, size)


class Profiles:
    def __init__(self, rows: list[tuple[str, int, int]]):
        """(language, n-gram, count), the n-grams of each language."""
        self.names = sorted({r[0] for r in rows})
        self.tables = []
        for name in self.names:
            own = sorted((r[1], r[2]) for r in rows if r[0] == name)
            grams, place = ranks(np.array([g for g, _ in own], np.uint64), np.array([n for _, n in own]))
            order = np.argsort(grams)
            self.tables.append((grams[order], place[order]))

    def predict(self, text: str) -> tuple[str, float]:
        grams, number = counts(text)
        if not len(grams) or not self.names:
            return UNKNOWN, 0.0
        grams, place = ranks(grams, number)
        far = []
        for known, where in self.tables:
            at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
            far.append(np.where(known[at] == grams, np.abs(where[at] - place), PROFILE).sum() / (PROFILE * len(grams)))
        best = int(np.argmin(far))
        return self.names[best], float(min(1.0, max(0.0, 1 - far[best])))


def gram_counts(docs: DataFrame) -> DataFrame:
    """lang, gram, n over all rows; a task hands on one row for each language and n-gram it has seen."""
    def run(batches):
        held: dict[str, tuple] = {}
        for batch in batches:
            for part in steps(batch):
                by: dict[str, list] = {}
                for text, lang in zip(part.column("text").to_pylist(), part.column("lang").to_pylist()):
                    by.setdefault(lang, []).append(counts(text))
                for lang, found in by.items():
                    found = found + ([held[lang]] if lang in held else [])
                    held[lang] = merged([g for g, _ in found], [n for _, n in found])
        for lang, (grams, n) in held.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(grams), pa.string()), "gram": grams.view(np.int64), "n": n})

    return docs.select("text", "lang").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learned(docs: DataFrame, train_rows) -> Profiles:
    """Profiles from all rows with a text and a language; a row for each language and place reaches the driver."""
    counted = gram_counts(docs.filter(train_rows & F.col("text").isNotNull() & F.col("lang").isNotNull()))
    # A language has as many n-grams as its alphabet allows, however many documents there are.
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counted.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= PROFILE)
    return Profiles([(r["lang"], r["gram"], r["n"]) for r in top.collect()])


def predictions(docs: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(learned(docs, fold("doc_id", folds) != held))

    def step(batch):
        found = [shared.value.predict(t or "") for t in batch.column("text").to_pylist()]
        return [batch.column("doc_id"), [f[0] for f in found], [f[1] for f in found]]

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = map_steps(docs.select("doc_id", "text"), f"doc_id {kind}, lang_pred string, score double", step)
    return out.select("doc_id", (fold("doc_id", folds) == held).alias("held_out"), "lang_pred", "score")
