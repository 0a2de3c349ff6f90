import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import documents

from prefmill.llm import mixpack
from prefmill.llm.base import tokenizer_path
from prefmill.llm.tokenizing import Pieces


@pytest.mark.parametrize("seed", range(25))
def test_windows_are_full_and_hold_their_shares(seed):
    rng = np.random.default_rng(seed)
    queues, size = int(rng.integers(1, 12)), int(rng.choice([8, 64, 2048]))
    totals = [int(x) for x in rng.integers(0, rng.choice([5, 300, 60000]), queues)]
    weights = totals if seed % 2 else [float(x) for x in rng.random(queues)]
    plan = mixpack.Plan(mixpack.phases(totals, weights, size), size)
    windows = {}
    for q in range(queues):
        cuts = np.unique(np.concatenate([[0, totals[q]], rng.integers(0, totals[q] + 1, 6)]))
        row, start, length, window, offset = plan.pieces(np.full(len(cuts) - 1, q), cuts[:-1], cuts[1:])
        assert length.sum() == totals[q]
        for w, o, n in zip(window, offset, length):
            windows.setdefault(int(w), []).append((int(o), int(n)))
    for w, parts in windows.items():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at == size or w == max(windows)
    assert len(windows) == -(-sum(totals) // size)


def test_a_thousand_queues_share_every_window_and_what_dry_ones_leave():
    """Every window is within a token or two of each queue's share among the queues that are not dry."""
    rng = np.random.default_rng(5)
    queues, size = 1000, 2048
    totals, weights = rng.integers(1, 4000, queues), rng.random(queues) + 0.05
    plan = mixpack.Plan(mixpack.phases(totals.tolist(), weights.tolist(), size), size)
    row, start, length, window, offset = plan.pieces(np.arange(queues), np.zeros(queues, np.int64), totals)
    sent = np.zeros((int(window.max()) + 1, queues), np.int64)
    np.add.at(sent, (window, row), length)
    assert (sent.sum(0) == totals).all() and (sent[:-1].sum(1) == size).all()
    for w in np.unique(window):
        at = np.flatnonzero(window == w)
        at = at[np.argsort(offset[at])]
        assert (offset[at] == np.concatenate([[0], np.cumsum(length[at])[:-1]])).all()
    gone = np.cumsum(sent, 0)
    for w in range(len(sent) - 1):
        left = totals - (gone[w - 1] if w else 0)
        if (np.flatnonzero(left > 0).size > 1) and not ((gone[w] == totals) & (left > 0)).any():
            share = np.where(left > 0, weights, 0) / weights[left > 0].sum() * size
            assert np.abs(sent[w] - share).max() <= 2


def test_deficits_return_to_zero_and_stay_small():
    quanta = mixpack.shares(np.array([5.0, 3.0, 0.01, 1.0]), np.ones(4, bool), 64 * mixpack.CYCLE)
    sent = mixpack.cycle(quanta, 64)
    assert (sent[-1] == quanta).all() and (np.diff(sent, axis=0).sum(1) == 64).all() and (np.diff(sent, axis=0) >= 0).all()
    owed = np.arange(mixpack.CYCLE + 1)[:, None] * quanta / mixpack.CYCLE - sent
    assert np.abs(owed).max() < 2


def test_pieces_of_words_are_the_tokenizers_ids():
    pieces = Pieces(tokenizer_path())
    texts = ["", " ", "a", " a", "a  b", "a\n b", "don't stop, it's fine.\nNew line", "x\n\ny z", "tab\t end ", "...!! ##a b's 12.5% ²³ é̀ ß",
             "word *** word*** (word) <|endoftext|> end", "a b  c", "1,000 2'th", "end.\n\nThe  'quoted' \n"]
    for _ in range(2):  # from the memory the second time
        for got, text in zip(pieces.encode(texts), texts):
            want = pieces.tokenizer.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(got, "<u2").tolist() == want, text


def test_a_column_encodes_each_word_once_without_python_objects_for_words(monkeypatch):
    pieces = Pieces(tokenizer_path())
    texts = ["Élève à l'école.\nNaïve, again ", "one two's\nthree\n", "", " lead", "a\n\nb c", "x\ny é\nß ÿ", "ab <|endoftext|> cd", "tab\tin two", "日本 語 word",
             "soft\u00adhyphen next", "no\u00a0break it", "", "line\u2028end \u0085 x", "ends\n"]
    column = pa.array(["cut off", *texts * 3])[1:]
    end = np.array([1], "<u2").tobytes()
    for _ in range(2):  # from the memory the second time
        for got, text in zip(pieces.column(column, end).to_pylist(), texts * 3, strict=True):
            assert np.frombuffer(got, "<u2").tolist() == pieces.tokenizer.encode(text, add_special_tokens=False).ids + [1], text
    assert pieces.column(pa.array([], pa.string())).to_pylist() == [] and pieces.column(pa.array(["", ""]), end).to_pylist() == [end, end]
    seen = []
    ranked = pieces._ranked
    monkeypatch.setattr(pieces, "_words", None)
    monkeypatch.setattr(pieces, "_ranked", lambda text, sizes: seen.append(text) or ranked(text, sizes))
    pieces.column(pa.array(["the déjà vu, vu\nthe déjà"] * 50))
    assert [sorted(t.split(" ")) for t in seen] == [sorted(["", "the", "déjà", "vu,", "vu\nthe"])]


def packs(df):
    return df.orderBy("sequence_id", "offset").collect()


def check(rows, texts, size):
    plain = Pieces(tokenizer_path()).tokenizer
    at = {}
    for r in rows:
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(n == size for s, n in at.items() if s != max(at))
    for key, text in texts.items():
        ids = np.array(plain.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        own = sorted((r for r in rows if r["doc_id"] == key), key=lambda r: r["start"])
        assert [r["start"] for r in own] == [0, *np.cumsum([r["length"] for r in own])[:-1]] and sum(r["length"] for r in own) == len(ids)
        for r in own:
            assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[r["start"]:r["start"] + r["length"]].tobytes())


def test_round_trip(spark):
    rows = [(i, " ".join(f"word{(i * j) % 97}" for j in range(i * 3)), "en", ["a", "b", None][i % 3]) for i in range(60)]
    rows += [(100, None, "en", "a"), (101, "", "en", None), (102, "long " * 30000, "en", "hot")]
    docs = documents(spark, rows)
    check(packs(mixpack.packed(docs, tokenizer_path(), 256)), {r[0]: r[1] for r in rows}, 256)
    assert mixpack.packed(docs.limit(0), tokenizer_path()).count() == 0


def test_targets_hold_in_every_window_until_a_source_is_dry(spark):
    rows = [(i, "alpha beta gamma " * 40, "en", "ab"[i % 2]) for i in range(200)]
    out = packs(mixpack.packed(documents(spark, rows), tokenizer_path(), 128, {"a": 3.0, "b": 1.0}))
    share = {}
    for r in out:
        share.setdefault(r["sequence_id"], {}).setdefault(r["source"], 0)
        share[r["sequence_id"]][r["source"]] += r["length"]
    full = [s for s in sorted(share) if "a" in share[s]][:-1]
    assert full and all(abs(share[s]["a"] - 96) <= 1 for s in full)


def test_many_sources_share_the_last_queue(spark, monkeypatch):
    monkeypatch.setattr(mixpack, "QUEUES", 3)
    rows = [(i, f"text number {i} " * (i + 1), "en", f"s{i % 9}") for i in range(45)]
    check(packs(mixpack.packed(documents(spark, rows), tokenizer_path(), 64)), {r[0]: r[1] for r in rows}, 64)


def test_repeated_rows(spark):
    rows = [(1, "same text here"), (1, "same text here"), (2, "other")]
    out = packs(mixpack.packed(documents(spark, rows), tokenizer_path(), 16))
    total = {r["doc_id"]: r["doc_tokens"] for r in out}
    assert sum(r["length"] for r in out if r["doc_id"] == 1) == 2 * total[1]
