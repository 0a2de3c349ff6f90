"""Benchmark decontamination by latent semantic retrieval.

1. Words are lower-cased runs between white space and ASCII punctuation; the vocabulary is that of the benchmark. Every
   text is written once as word numbers (0: no benchmark word). A word's weight is the inverse of the share of passages
   expected to hold it, from its count in all documents; so many copies of one text do not make its words common.
2. Passages are ``PASSAGE`` words every ``STRIDE`` words; an item up to that long is one passage. A randomised SVD of the
   TF-IDF passages (range finder, power step, Rayleigh-Ritz) gives a latent space, whitened by the singular values. Its
   sums run as Spark tasks over all passages of the benchmark and of every document: one pass adds up the products of all
   pairs of terms; of more than ``GRAM_TERMS`` terms, each of the three steps is a pass that adds up its own product.
3. Every passage of every document is projected and compared with the item passages; those with a cosine of at least
   ``COSINE`` are candidates.
4. A candidate is checked around its place: enough of the item's weight must be there, then the longest common
   subsequence of words with the item must reach ``SHARE`` of it, or ``LOOSE`` if the answer (the item's last sentence)
   is there too, so that paraphrases of a question with its answer count.

A large benchmark is taken in slices of ``ITEMS`` items, so what is broadcast is bounded. Defined results: null and empty
texts and items match nothing; an empty benchmark matches nothing; repeated items are reported under each id, repeated
documents once for each id. No word of a text is left out.
"""

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from prefmill.llm.base import map_steps
from prefmill.session import gathered, settled

PASSAGE, STRIDE = 32, 16
RANK, OVERSAMPLE = 256, 32
ITEMS = 2_000
COSINE = 0.45
#: A word expected in more than this share of passages has no weight, unless an item would keep less than half its words.
COMMON = 0.2
COVER = 0.6
SHARE, LOOSE = 0.8, 0.65
ANSWER = 0.8
#: Words taken at once, blocks of STRIDE words in one part of a long text, and rows or pairs of terms handed on at once.
WORDS, PART, TERM_BLOCK, PAIR_BLOCK = 1 << 15, 1 << 10, 4096, 1 << 18
#: Blocks of STRIDE words that are projected and compared at once, of any number of texts.
BLOCKS = 1 << 9
#: Up to so many terms a task holds the sums of all their pairs (144 MB).
GRAM_TERMS = 6_000

_PUNCTUATION = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))
_TO_BLANK = bytes.maketrans(_PUNCTUATION, b" " * len(_PUNCTUATION))
_SENTENCE = re.compile(r"[.!?:\n]+\s*(?=\S)")


def words(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(_TO_BLANK).split()


def answer(text: str) -> list[bytes]:
    """The words of the last sentence, or of all if there is one sentence only."""
    parts = [w for w in map(words, _SENTENCE.split(text)) if w]
    return parts[-1] if parts else []


def windows(n: int, length: int = PASSAGE, stride: int = STRIDE) -> list[tuple[int, int]]:
    """Places of the passages of an item of n words; the last ends with it."""
    if n <= length:
        return [(0, n)]
    return [(s, s + length) for s in range(0, n - length, stride)] + [(n - length, n)]


def lcs(item: list[int], region: list[int]) -> int:
    """Length of the longest common subsequence; each bit of ``row`` is a place of the item."""
    masks: dict[int, int] = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    row = full
    for w in region:
        if (m := masks.get(w)):
            hit = row & m
            row = ((row + hit) | (row - hit)) & full
    return len(item) - row.bit_count()


def block_sums(ids: np.ndarray, block: np.ndarray, blocks: int, vectors: np.ndarray) -> np.ndarray:
    """Sums of the vectors of the words of each block; ``block``, the number of a word's block, ascends."""
    count = np.bincount(block, minlength=blocks)
    order = np.argsort(-count, kind="stable")  # blocks with most words first: those with another word are the first ones
    first, count = (np.cumsum(count) - count)[order], count[order]
    sums = np.zeros((blocks, vectors.shape[1]), np.float32)
    for j in range(count.max(initial=0)):
        more = first[:np.searchsorted(-count, -j)]
        sums[:len(more)] += vectors[ids[more + j]]
    out = np.empty_like(sums)
    out[order] = sums
    return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class Index:
    """Item words, weights and latent vectors: all a task needs. Its size follows from the items of one slice."""

    def __init__(self, items: list[tuple]):
        self.names = [i for i, _ in items]
        texts = [words(t) for _, t in items]
        found = sorted({w for t in texts for w in t})
        self.number = {w: i + 1 for i, w in enumerate(found)}
        self.items = [[self.number[w] for w in t] for t in texts]
        self.answers = [[self.number[w] for w in answer(t)] for _, t in items]
        self.spans = [(i, a, b) for i, t in enumerate(self.items) for a, b in windows(len(t))]
        self.idf = np.zeros(len(found) + 1, np.float32)

    def weigh(self, counts: np.ndarray, total: int):
        """``counts``: of each word in the corpus; ``total``: of all words there."""
        share = 1 - (1 - np.minimum(counts + 1, total + 1) / (total + 2)) ** PASSAGE
        self.idf = (0.1 - np.log(share)).astype(np.float32)
        drop = share > COMMON
        for own in (np.unique(t) for t in self.items):
            if 2 * drop[own].sum() > len(own):
                drop[own] = False
        self.idf[drop] = 0
        self.idf[0] = 0
        self.mass = [float(self.idf[list(set(t))].sum()) for t in self.items]

    def project(self, basis: np.ndarray):
        self.vectors = (self.idf[:, None] * basis).astype(np.float32)
        self.queries = unit(np.stack([self.vectors[self.items[i][a:b]].sum(0) for i, a, b in self.spans])).T.copy()

    def candidates(self, texts: list[np.ndarray]) -> list[dict[tuple[int, int], float]]:
        """For each text, the items near one of its passages, where they would start, and the best cosine."""
        out: list[dict[tuple[int, int], float]] = [{} for _ in texts]
        sizes, ids = np.array([len(t) for t in texts]), np.concatenate(texts)
        starts, blocks = np.cumsum(sizes) - sizes, -(-sizes // STRIDE)
        base, owner = np.cumsum(blocks) - blocks, np.repeat(np.arange(len(texts)), blocks)
        at = np.flatnonzero(self.idf[ids] > 0)
        text = np.repeat(np.arange(len(texts)), sizes)[at]
        block = base[text] + (at - starts[text]) // STRIDE
        # A passage is a block and the next one of its text; one block alone if there is no other.
        joined = np.append(owner[1:] == owner[:-1], False)
        begins = joined | (blocks[owner] == 1)
        for s in range(0, len(owner), BLOCKS):
            e = min(s + BLOCKS, len(owner))
            lo, hi = np.searchsorted(block, [s, e + 1])
            sums = block_sums(ids[at[lo:hi]], block[lo:hi] - s, e + 1 - s, self.vectors)
            near = sums[:-1] + sums[1:] * joined[s:e, None]
            rows = np.flatnonzero(begins[s:e])
            cosine = unit(near[rows]) @ self.queries
            for place in np.flatnonzero(cosine >= COSINE):
                row, column = divmod(int(place), cosine.shape[1])
                item, a, _ = self.spans[column]
                own = int(owner[s + rows[row]])
                key = (item, int(s + rows[row] - base[own]) * STRIDE - a)  # where the item would start
                out[own][key] = max(out[own].get(key, 0.0), float(cosine[row, column]))
        return out

    def matches(self, texts: list[np.ndarray]) -> list[list[tuple[int, float, float, float]]]:
        """For each text: item, best cosine, share of the item and share of its answer, for every item found in it."""
        return [self._checked(ids, near) for ids, near in zip(texts, self.candidates(texts))] if texts else []

    def _checked(self, ids: np.ndarray, candidates: dict[tuple[int, int], float]) -> list[tuple[int, float, float, float]]:
        best: dict[int, tuple[int, float, float, float]] = {}
        for (item, at), cosine in candidates.items():
            own = self.items[item]
            region = ids[max(0, at - PASSAGE):at + len(own) + 2 * PASSAGE]
            shared = set(own).intersection(region.tolist())
            if not shared or self.idf[list(shared)].sum() < COVER * self.mass[item]:
                continue
            region = region.tolist()
            share = lcs(own, region) / len(own)
            told = lcs(self.answers[item], region) / max(1, len(self.answers[item]))
            if share >= SHARE or share >= LOOSE and told >= ANSWER:
                found = (item, cosine, share, told)
                best[item] = max(best.get(item, found), found, key=lambda f: (f[2], f[1]))
        return [best[i] for i in sorted(best)]


def numbered(docs: DataFrame, index: Index) -> DataFrame:
    """doc_id, ids: the text as little-endian 32-bit word numbers."""
    number = index.number

    def step(batch):
        get = number.get
        ids = [np.fromiter(map(get, words(t or ""), repeat(0)), np.int32).tobytes() for t in batch.column("text").to_pylist()]
        return [batch.column("doc_id"), ids]

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_steps(docs.select("doc_id", "text"), f"doc_id {kind}, ids binary", step)


def word_counts(texts: DataFrame, terms: int) -> tuple[np.ndarray, int, int]:
    """How often each term occurs in all texts, and the numbers of words and texts; partial counts meet in Spark."""
    def run(batches):
        count, documents = np.zeros(terms, np.int64), 0
        for batch in batches:
            for ids in batch.column("ids"):
                count += np.bincount(np.frombuffer(ids.as_buffer(), np.int32), minlength=terms)
            documents += batch.num_rows
        seen = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"term": np.append(seen, -1), "n": np.append(count[seen], documents)})

    counted = texts.select("ids").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = {r["term"]: r["n"] for r in counted.collect()}  # a row for each benchmark word, never for each document
    documents = found.pop(-1, 0)
    out = np.zeros(terms, np.int64)
    out[list(found)] = list(found.values())
    return out, int(out.sum()), documents


def _parts(ids: list[np.ndarray], weights: list[float]):
    """Lists of about WORDS words: the texts with their weights, long ones in parts whose passages are those of the text."""
    group, size = [], 0
    for text, weight in zip(ids, weights):
        for p in range(0, max(1, -(-len(text) // STRIDE) - 1), PART):
            group.append((text[p * STRIDE:(p + PART + 1) * STRIDE], weight))
            if (size := size + len(group[-1][0])) >= WORDS:
                yield group
                group, size = [], 0
    if group:
        yield group


def passage_entries(ids: list[np.ndarray], weights: list[float], idf: np.ndarray):
    """passage, term, value of the unit TF-IDF passages of the texts, by passage and term, for some texts at once. Values
    are times the root of the text's weight."""
    for group in _parts(ids, weights):
        sizes, words_here = np.array([len(t) for t, _ in group]), np.concatenate([t for t, _ in group]).astype(np.int64)
        at = np.flatnonzero(idf[words_here])
        text, term = np.repeat(np.arange(len(group)), sizes)[at], words_here[at]
        blocks = -(-sizes // STRIDE)
        base = np.cumsum(blocks) - blocks
        block = (at - (np.cumsum(sizes) - sizes)[text]) // STRIDE
        # A block is in the passage that it begins and in the one before; the last begins none, unless it is alone.
        begins = (block < blocks[text] - 1) | (blocks[text] == 1)
        key = (base[text] + block) * len(idf) + term
        key, count = np.unique(np.concatenate([key[begins], key[block > 0] - len(idf)]), return_counts=True)
        passage, term = np.divmod(key, len(idf))
        value = count * idf[term].astype(np.float64)
        norm = np.sqrt(np.bincount(passage, value * value, int(blocks.sum())))
        root = np.repeat(np.sqrt([w for _, w in group]), blocks)
        if len(key):
            yield passage, term, value * (root[passage] / norm[passage])


def _summed(rows: DataFrame, total, add_batch, block: int):
    """block, sum: ``total()`` filled by ``add_batch(total, ids, weights)`` in each task, then added up by blocks of its rows."""
    def run(batches):
        out = total()
        for batch in batches:
            ids = [np.frombuffer(i.as_buffer(), np.int32) for i in batch.column("ids")]
            add_batch(out, ids, batch.column("weight").to_pylist())
        for b in range(0, len(out), block):
            yield pa.RecordBatch.from_pydict({"block": [b], "part": [out[b:b + block].astype(np.float32).tobytes()]})

    def add(table: pa.Table) -> pa.Table:
        out = 0.0
        for p in table.column("part"):
            out = out + np.frombuffer(p.as_buffer(), np.float32).astype(np.float64)
        return pa.table({"block": table.column("block").slice(0, 1), "part": [out.astype(np.float32).tobytes()]})

    found = rows.mapInArrow(run, "block long, part binary").groupBy("block").applyInArrow(add, "block long, part binary")
    return [(r["block"], np.frombuffer(r["part"], np.float32)) for r in found.collect()]


def gram_product(rows: DataFrame, idf: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The sum over all passages a of a (a' right), added up in tasks and then by blocks of terms."""
    terms, width = right.shape
    shared = rows.sparkSession.sparkContext.broadcast((idf, right.astype(np.float32)))

    def add_batch(total, ids, weights):
        idf, right = shared.value
        for passage, term, value in passage_entries(ids, weights, idf):
            value = value.astype(np.float32)[:, None]
            first = np.flatnonzero(np.diff(passage, prepend=-1))
            sums = np.add.reduceat(value * right[term], first)  # a' right
            by_term = np.argsort(term, kind="stable")
            row = np.repeat(np.arange(len(first)), np.diff(first, append=len(passage)))[by_term]
            first = np.flatnonzero(np.diff(term[by_term], prepend=-1))
            total[term[by_term][first]] += np.add.reduceat(value[by_term] * sums[row], first)

    out = np.zeros((terms, width))
    for b, part in _summed(rows, lambda: np.zeros((terms, width)), add_batch, TERM_BLOCK):
        out[b:b + TERM_BLOCK] = part.reshape(-1, width)
    return out


def gram_matrix(rows: DataFrame, idf: np.ndarray) -> np.ndarray:
    """The sum over all passages a of a a', of which tasks add up the lower triangle."""
    terms = len(idf)
    shared = rows.sparkSession.sparkContext.broadcast(idf)

    def add_batch(total, ids, weights):
        for passage, term, value in passage_entries(ids, weights, shared.value):
            at, apart = np.arange(len(term)), 0
            while len(at):  # entries and those so many places after them in the same passage
                later = at + apart
                np.add.at(total, term[later] * (term[later] + 1) // 2 + term[at], value[later] * value[at])
                apart += 1
                at = at[:np.searchsorted(at, len(term) - apart)]
                at = at[passage[at] == passage[at + apart]]

    pairs = terms * (terms + 1) // 2  # what runs in tasks holds this number only
    parts = _summed(rows, lambda: np.zeros(pairs), add_batch, PAIR_BLOCK)
    flat = np.zeros(pairs, np.float32)
    for b, part in parts:
        flat[b:b + PAIR_BLOCK] = part
    out = np.zeros((terms, terms))
    low = np.tri(terms, dtype=bool)
    out[low] = flat
    out.T[low] = flat
    return out


def latent_basis(texts: DataFrame, index: Index, documents: int) -> np.ndarray:
    """Leading right singular vectors of the TF-IDF passages over their singular values, a row per term."""
    spark = texts.sparkSession
    # Item passages weigh as much as all documents' passages together, so that the space spans them.
    items = [(np.array(index.items[i][a:b], np.int32).tobytes(), max(1.0, documents / len(index.spans))) for i, a, b in index.spans]
    rows = texts.select("ids", F.lit(1.0).alias("weight")).unionByName(spark.createDataFrame(items, "ids binary, weight double"))
    # A task hands on sums of a fixed size however much it reads, so there is one for each core.
    rows = rows.coalesce(spark.sparkContext.defaultParallelism)
    if len(index.idf) <= GRAM_TERMS:
        gram = gram_matrix(rows, index.idf)
        product_with = gram.__matmul__
    else:
        def product_with(right):
            return gram_product(rows, index.idf, right)
    width = min(RANK + OVERSAMPLE, len(index.idf))
    start = np.random.default_rng(5).standard_normal((len(index.idf), width))
    q, _ = np.linalg.qr(product_with(start))
    q, _ = np.linalg.qr(product_with(q))
    product = product_with(q)
    small = q.T @ product
    value, turn = np.linalg.eigh((small + small.T) / 2)
    top = np.argsort(-value)[:RANK]
    top = top[value[top] > 1e-6 * value[top[0]]]
    return q @ (turn[:, top] / np.sqrt(value[top]))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine, lcs_share, answer_share: one row for each document and item found in it."""
    spark = docs.sparkSession
    kinds = {t: s.schema[c].dataType.simpleString() for t, s, c in (("d", docs, "doc_id"), ("i", benchmark, "item_id"))}
    schema = f"doc_id {kinds['d']}, item_id {kinds['i']}, cosine double, lcs_share double, answer_share double"
    items = benchmark.select("item_id", "text").filter("text IS NOT NULL").distinct()
    slices = -(-items.count() // ITEMS)
    out = spark.createDataFrame([], schema)
    for k in range(slices):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k).orderBy("item_id", "text").collect()
        part = [(r["item_id"], r["text"]) for r in part if words(r["text"])]
        if part:
            out = out.unionByName(_slice_leaks(docs, Index(part), schema))
    return out.groupBy("doc_id", "item_id").agg(F.max(F.struct("lcs_share", "cosine", "answer_share")).alias("b")).select(
        "doc_id", "item_id", "b.cosine", "b.lcs_share", "b.answer_share")


def _slice_leaks(docs: DataFrame, index: Index, schema: str) -> DataFrame:
    texts = settled(gathered(numbered(docs, index)))
    counts, total, documents = word_counts(texts, len(index.idf))
    index.weigh(counts, total)
    index.project(latent_basis(texts, index, documents))
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def step(batch):
        row, found = [], []
        texts = [np.frombuffer(ids.as_buffer(), np.int32) for ids in batch.column("ids")]
        for i, matches in enumerate(shared.value.matches(texts)):
            row += [i] * len(matches)
            found += matches
        item, cosine, share, told = zip(*found) if found else ((), (), (), ())
        return [batch.column("doc_id").take(pa.array(row, pa.int64())), [shared.value.names[i] for i in item], cosine, share, told]

    return map_steps(texts, schema, step, "ids")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no item was found, all columns."""
    bad = settled(gathered(leaks(docs, benchmark).select("doc_id").distinct()))
    return docs.alias("d").join(bad.alias("k"), F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")), "left_anti")
