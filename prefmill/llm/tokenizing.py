"""Exact ids of a public byte-level tokenizer, each word of a column of texts encoded once.

The tokenizer's own splitting rule always cuts before a single blank between two characters that are not white space, and
around a single line end between such characters. So texts may be encoded piece by piece there: the distinct pieces of a
column are found and encoded, and each text's ids are taken from theirs, all in Arrow. Pieces of printable Latin
characters, where no two readings of the splitting rule can differ, are encoded from the same vocabulary as ranks, which is
faster and gives the same ids; the tokenizer itself does the rest. Pieces with other characters are remembered.
Special tokens in a text are single ids: the text between them is encoded by itself, as the tokenizer does. Texts with a
special token that takes in its surroundings go to the tokenizer whole. Texts with those or with other white space between
words are encoded one by one.
"""

import base64
import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces in the younger half of a memory. A full one becomes the older half; pieces used from there come back.
REMEMBERED = 200_000
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Of each byte: 0 in a printable character of ASCII or between À and ÿ, 1 a line end, 2 in another character.
_KIND = np.full(256, 2, np.uint8)
_KIND[32:127], _KIND[10], _KIND[0x80:0xC0], _KIND[0xC3] = 0, 1, 0, 0


def _clean(piece: str) -> bool:
    return piece != "" and piece == piece.strip()


def _binary(cuts: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(data)])


def _line(pieces: pa.Array) -> str:
    """The pieces, each with a blank before it."""
    return " " + pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(pieces)], pa.int32()), pieces), " ")[0].as_py()


def ranks_of(tokenizer_file: str):
    """The same vocabulary as ranks, if its file lies beside the tokenizer's."""
    path = tokenizer_file.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(path):
        return None
    import public_tokenizers
    import tiktoken
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Memory:
    """What ``make`` gives for each piece of a list, remembered in two halves."""

    def __init__(self, make):
        self.make, self.young, self.old = make, {}, {}

    def all(self, pieces: set[str]) -> dict[str, bytes]:
        """Makes all these pieces known and returns the dictionary that holds them."""
        if len(self.young) > REMEMBERED:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        fresh = []
        for p in pieces:
            if p not in young:
                if (found := old.get(p)) is not None:
                    young[p] = found
                else:
                    fresh.append(p)
        young.update(zip(fresh, self.make(fresh)))
        return young


class Pieces:
    """Encodes texts to bytes of little-endian ids, two bytes each if the vocabulary allows, else four."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs a task on each core
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.ordinary = Tokenizer.from_file(path)  # for text between special tokens, without the search for them
        self.ordinary.encode_special_tokens = True
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = {t.content: i for i, t in added.items()}
        self.whole = any(t.lstrip or t.rstrip or t.single_word or t.normalized and self.tokenizer.normalizer for t in added.values())
        longest = sorted(self.special, key=len, reverse=True)
        self.marks = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.words = Memory(self._words)
        self.ranks = ranks_of(path)
        self.token_bytes = np.array([len(self.ranks.decode_single_token_bytes(i)) for i in range(self.ranks.n_vocab)]) if self.ranks else None
        self.line = self._encode(["\n"])[0]

    def _encode(self, pieces: list[str], tokenizer=None) -> list[bytes]:
        found = (tokenizer or self.ordinary).encode_batch_fast(pieces, add_special_tokens=False)
        return [array(self.code, e.ids).tobytes() for e in found]

    def _words(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece with a blank before it; the pieces neither begin nor end with white space."""
        plain = [bool(self.ranks) and all(_clean(q) and self._readable(q) for q in p.split("\n")) for p in pieces]
        fast = iter(self._at_once([p for p, ok in zip(pieces, plain) if ok]))
        rest = iter(self._encode([" " + p for p, ok in zip(pieces, plain) if not ok]))
        return [next(fast if ok else rest) for ok in plain]

    @staticmethod
    def _readable(text: str) -> bool:
        return text.isprintable() and (text.isascii() or max(text) <= "ÿ")

    def _at_once(self, pieces: list[str]) -> list[bytes]:
        if not pieces:
            return []
        sizes = np.fromiter((len(p) if p.isascii() else len(p.encode()) for p in pieces), np.int64, len(pieces))
        return self._ranked(" " + " ".join(pieces), sizes).to_pylist()

    def _ranked(self, text: str, sizes: np.ndarray) -> pa.Array:
        """Ids of each piece with a blank before it, from one text of them all: no token reaches over such a blank, so the
        bytes of the tokens tell where a piece ends. ``sizes``: bytes of the pieces without that blank."""
        ids = self.ranks.encode_to_numpy(text, disallowed_special=())
        ends = np.searchsorted(np.cumsum(self.token_bytes[ids]), np.cumsum(sizes + 1)) + 1
        ids = ids.astype(self.code)
        return _binary(np.append(0, ends) * ids.itemsize, ids)

    def _table(self, pieces: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Ids of each piece of a whole array with a blank before it, and which pieces neither are empty nor begin or end
        with white space; the others have no ids."""
        sizes = pc.binary_length(pieces).to_numpy()
        ends = np.cumsum(sizes)
        data = np.frombuffer(pieces.buffers()[2] or b"", np.uint8)
        at = np.flatnonzero(_KIND[data[:int(ends[-1])]]) if len(ends) else np.empty(0, np.int64)
        owner = np.searchsorted(ends, at, side="right")
        edge = (at == ends[owner] - sizes[owner]) | (at == ends[owner] - 1)
        odd = sizes == 0 if self.ranks else np.ones(len(sizes), bool)
        odd[owner[(_KIND[data[at]] == 2) | edge | (np.diff(at, append=-1) == 1)]] = True
        clean = np.ones(len(sizes), bool)
        if not odd.any():
            return self._ranked(_line(pieces), sizes) if len(sizes) else pa.array([], pa.binary()), clean
        rest = pieces.filter(pa.array(odd)).to_pylist()
        clean[odd] = [_clean(p) for p in rest]
        known = self.words.all({p for p in rest if _clean(p)})
        tables = [pa.array([known.get(p, b"") for p in rest], pa.binary())]
        if not odd.all():
            tables.append(self._ranked(_line(pieces.filter(pa.array(~odd))), sizes[~odd]))
        place = np.empty(len(sizes), np.int64)
        place[odd], place[~odd] = np.arange(len(rest)), np.arange(len(rest), len(sizes))
        return pa.concat_arrays(tables).take(pa.array(place)), clean

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.column(pa.array(texts, pa.string())).to_pylist()

    def column(self, texts: pa.Array, end: bytes = b"") -> pa.Array:
        """The ids of each text, and ``end`` after them."""
        if not len(texts):
            return pa.array([], pa.binary())
        lists = pc.split_pattern(texts, " ")
        cuts = lists.offsets.to_numpy()
        first, sizes = cuts[:-1], np.diff(cuts)
        words = lists.values.dictionary_encode()
        table, clean = self._table(words.dictionary)
        at = words.indices.to_numpy().copy()
        other = ~clean[at]
        heads = lists.values.take(pa.array(first)).to_pylist()
        other[first] = [not _clean(h) for h in heads]
        alone = np.logical_or.reduceat(other, first)
        if self.marks:
            alone |= [self._marked(t) for t in texts.to_pylist()] if self.whole else \
                pc.match_substring_regex(texts, self.marks.pattern).to_numpy(zero_copy_only=False)
        heads = self._encode(["" if a else h for h, a in zip(heads, alone.tolist())])
        for i, ids in zip(np.flatnonzero(alone).tolist(), self._one_by_one(texts.filter(pa.array(alone)).to_pylist())):
            heads[i] = ids
        at[first] = len(table) + np.arange(len(texts))
        if alone.any():
            kept = ~np.repeat(alone, sizes)
            kept[first] = True
            at, sizes = at[kept], np.where(alone, 1, sizes)
        ends = np.cumsum(sizes)
        at = np.insert(at, ends, len(table) + len(texts))
        found = pa.concat_arrays([table, pa.array([*heads, end], pa.binary())]).take(pa.array(at))
        cuts = np.frombuffer(found.buffers()[1], np.int32)[np.append(0, ends + np.arange(1, len(ends) + 1))]
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(cuts), found.buffers()[2]])

    def _one_by_one(self, texts: list[str]) -> list[bytes]:
        if not self.marks:
            return self._plain(texts)
        if self.whole:
            out = self._plain(["" if self._marked(t) else t for t in texts])
            at = [i for i, t in enumerate(texts) if self._marked(t)]
            for i, ids in zip(at, self._encode([texts[i] for i in at], self.tokenizer)):
                out[i] = ids
            return out
        split = [self.marks.split(t) for t in texts]  # text, mark, text, ..., text
        plain = iter(self._plain([part for parts in split for part in parts[::2]]))
        return [b"".join(array(self.code, [self.special[part]]).tobytes() if k % 2 else next(plain) for k, part in enumerate(parts))
                for parts in split]

    def _marked(self, text: str) -> bool:
        """Whether the tokenizer may find a special token in a text, also after it has normalised the text."""
        return bool(self.marks.search(text) or self.tokenizer.normalizer and self.marks.search(self.tokenizer.normalizer.normalize_str(text)))

    def _plain(self, texts: list[str]) -> list[bytes]:
        known, cut, new = self.words.young, [], set()
        for text in texts:
            parts = text.split(" ")
            more = set(parts[1:]).difference(known)
            if not all(map(_clean, more)) or not _clean(parts[0]):
                parts = _CUT.split(text)
                more = set(parts[1:]).difference(known)
            new |= more
            cut.append(parts)
        if len(known) > REMEMBERED:  # the halves change now, so every piece of these texts must be asked for
            new = {p for parts in cut for p in parts[1:]}
        known = self.words.all(new)
        heads = self._encode([parts[0] for parts in cut])
        return [head + b"".join(map(known.__getitem__, parts[1:])) for head, parts in zip(heads, cut)]


@lru_cache(1)
def pieces_of(path: str) -> Pieces:
    """One encoder for all tasks of a worker."""
    return Pieces(path)
