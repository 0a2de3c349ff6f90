"""Word and shingle hashes of whole texts in numpy.

Words are runs of bytes other than blank and tab to carriage return; A-Z count as a-z. Hashes have 64 bits.
"""

import numpy as np

BLANKS = b" \t\n\x0b\x0c\r"
#: Bytes hashed at once; cuts fall on white space.
SEGMENT = 1 << 20

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, which spreads every input bit over the output."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _odd(seed: int, n: int) -> np.ndarray:
    return mix(np.arange(n, dtype=np.uint64) + np.uint64(seed)) | np.uint64(1)


_BYTE = _odd(1 << 20, 256)
_BYTE[65:91] = _BYTE[97:123]
_BASE = np.uint64(0xD6E8FEB86659FD93)
_ORDER = _odd(1 << 30, 64)  # one factor for each place in a shingle
_BLANK = np.zeros(256, bool)
_BLANK[list(BLANKS)] = True


def _segment(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    word = ~_BLANK[buf]
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    starts, lens = edge[::2], edge[1::2] - edge[::2]
    if not len(starts):
        return np.empty(0, np.uint64), starts
    first = np.cumsum(lens) - lens
    place = np.arange(int(lens.sum())) - np.repeat(first, lens)
    power = np.cumprod(np.full(int(lens.max()), _BASE, np.uint64))
    sums = np.add.reduceat(_BYTE[buf[word]] * power[place], first)
    return mix(sums + lens.astype(np.uint64) * _GOLD), starts


def words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and byte offsets of the words of ``data``, in order."""
    buf, at, hashes, offsets = np.frombuffer(data, np.uint8), 0, [], []
    while at < len(buf):
        end = min(len(buf), at + SEGMENT)
        while end < len(buf):  # move the cut to the next blank
            stop = np.flatnonzero(_BLANK[buf[end:end + SEGMENT]])
            if len(stop):
                end += int(stop[0])
                break
            end = min(len(buf), end + SEGMENT)
        h, s = _segment(buf[at:end])
        hashes.append(h)
        offsets.append(s + at)
        at = end
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(offsets)


def word_lists(texts: list[bytes]) -> list[np.ndarray]:
    """Word hashes of each text, found in one pass over all of them."""
    hashes, offsets = words(b"\n".join(texts))
    ends = np.cumsum([len(t) + 1 for t in texts])
    return np.split(hashes, np.searchsorted(offsets, ends[:-1])) if texts else []


def shingle_set(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of k consecutive words; of all words if there are fewer; empty without words."""
    n = len(hashes)
    if not n:
        return hashes
    width = min(n, k)
    total = np.full(n - width + 1, np.uint64(width), np.uint64)
    for j in range(width):
        total += hashes[j:n - width + 1 + j] * _ORDER[j]
    total = mix(total)
    total.sort()
    return total[np.concatenate([[True], total[1:] != total[:-1]])]


def digest(found: np.ndarray) -> bytes:
    """128 bits that name a set of hashes."""
    size = np.uint64(len(found))
    return b"".join(int(np.add.reduce(mix(found ^ s)) + size).__and__((1 << 64) - 1).to_bytes(8, "big") for s in (_M1, _M2))
