"""Words of whole batches of documents as arrays: no Python object for each word.

A batch is one byte array with row offsets. hash64() gives each stretch [a, b) of the bytes a
64-bit value through prefix sums of a polynomial, so stretches of any length cost the same.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers: dict[str, np.ndarray] = {}
#: Bytes that are hashed at once, so that a very long text needs no more memory than a batch of short ones.
CHUNK = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

#: Letters and digits in lower case; other ASCII is 32. Bytes of other characters stay.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD[[i for i in range(128) if not chr(i).isalnum()]] = 32


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and inverse powers modulo 2**64, up to n; kept between batches."""
    if not _powers or len(_powers["up"]) <= n:
        size = max(n + 1, 1 << 20)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", inverse)):
                a = np.full(size, base)
                a[0] = 1
                _powers[name] = np.multiply.accumulate(a)
    return _powers["up"], _powers["down"]


def release() -> None:
    """Forget the powers if a very long text made them large."""
    if _powers and len(_powers["up"]) > 2 * CHUNK:
        _powers.clear()


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix polynomial hashes: entry i covers values[:i]."""
    up, _ = powers(len(values))
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=out[1:])
    return out


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def stretch(pre: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Unmixed hash of values[a:b] for arrays a, b, whatever its place."""
    _, down = powers(len(pre) - 1)
    return (pre[b] - pre[a]) * down[a]


def hash64(pre: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(stretch(pre, a, b) + (b - a).astype(np.uint64))


def hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """hash64 of values[a:b] for each a of starts (in order) and b of ends, a chunk of the values at a time."""
    out = np.empty(len(starts), np.uint64)
    reach = np.maximum.accumulate(ends) if len(ends) else ends
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(reach, starts[i] + CHUNK, "right")))
        a = int(starts[i])
        if reach[j - 1] - a > CHUNK:  # one longer stretch: its chunks' sums, each shifted to its place
            out[i], j = _long(values[a : ends[i]]), i + 1
        else:
            pre = prefix(values[a : reach[j - 1]])
            out[i:j] = hash64(pre, starts[i:j] - a, ends[i:j] - a)
        i = j
    return out


def _long(values: np.ndarray) -> np.uint64:
    total, shift, step = 0, 1, pow(int(_BASE), CHUNK, 1 << 64)
    for a in range(0, len(values), CHUNK):
        total += int(prefix(values[a : a + CHUNK])[-1]) * shift
        shift = shift * step & (1 << 64) - 1
    return mix(np.array([(total + len(values)) & (1 << 64) - 1], np.uint64))[0]


def runs(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest stretches of true bytes; none crosses a row's border."""
    before = np.zeros(len(member), bool)
    before[1:] = member[:-1]
    firsts = offsets[:-1][offsets[:-1] < len(member)]
    before[firsts] = False
    starts = np.flatnonzero(member & ~before)
    after = np.zeros(len(member), bool)
    after[:-1] = member[1:]
    after[firsts[firsts > 0] - 1] = False
    return starts, np.flatnonzero(member & ~after) + 1


def count_by_row(member: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of each row's bytes are true."""
    return np.array([np.count_nonzero(member[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], np.int64)


def rows_of(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The row in which each start lies."""
    return np.searchsorted(offsets, starts, "right") - 1


def per_row(rows: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(rows, weights, n).astype(np.int64)


def lower_words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of letters and digits of a text in lower case: their rows, hashes, and starts in the bytes."""
    folded = FOLD[buf]
    starts, ends = runs(folded != 32, offsets)
    return rows_of(starts, offsets), hashes(folded, starts, ends), starts
