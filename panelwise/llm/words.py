"""Words of a batch of texts as numpy arrays over the Arrow buffers, without one Python object per word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_MASK = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_PINV = pow(_P, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_P))


def _byte_values(lower: bool, drop: np.ndarray) -> np.ndarray:
    table = (_BYTE[LOWER] if lower else _BYTE).copy()
    table[drop] = 0
    return table


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^i and P^-i modulo 2^64 for i < n."""
    if len(_powers.get("p", ())) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, base in (("p", _P), ("q", _PINV)):
            seq = np.full(size, base & _MASK, np.uint64)
            seq[0] = 1
            _powers[name] = np.multiply.accumulate(seq)
    return _powers["p"][:n], _powers["q"][:n]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array and the offset of each text (one more than texts); null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    arr = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset:arr.offset + len(arr) + 1] if len(arr) else np.zeros(1, np.int64)
    data = arr.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def split(raw: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Start of every word, and for each text the number of words before it (one more than texts)."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~space[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = offsets[:-1][offsets[:-1] < len(raw)]
    first[begins] = inside[begins]  # a text that starts with a word starts a new one
    starts = np.flatnonzero(first)
    return starts, np.searchsorted(starts, offsets)


def hashes(raw: np.ndarray, starts: np.ndarray, lower: bool = True, drop: np.ndarray = SPACE) -> np.ndarray:
    """64-bit hash of every word, the same wherever the word stands."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    p, q = _power(len(raw))
    sums = np.add.reduceat(_byte_values(lower, drop)[raw] * p, starts)
    return mix(sums * q[starts])


def pieces(offsets: np.ndarray, size: int = 1 << 18):
    """Runs (a, b) of texts with about ``size`` bytes each; a longer text is a run of its own."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)
