"""SimHash fingerprints of word shingles, computed on the bytes of a text."""

from __future__ import annotations

from functools import cache

import numpy as np
from xxhash import xxh64_intdigest

_ONES = np.uint64(0x0101010101010101)
_BLOCK = 255  # so many ones fit in a lane of eight bits


def shingles(text: str | None, width: int) -> list[bytes]:
    """Every run of ``width`` words (repeats included), joined by one space.

    A-Z are lower-cased and words are runs of anything but space and
    U+0009-U+000D, which is what ``bytes.lower`` and ``bytes.split`` do. Fewer
    words than ``width`` make one shingle of all of them; none make none.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-width] + 1))
    return [joined[a:b] for a, b in zip(starts.tolist(), ends[width - 1 :].tolist(), strict=True)]


def shingle_hashes(text: str | None, width: int, seed: int) -> np.ndarray:
    """XXH64 of every shingle, as uint64."""
    return np.array([xxh64_intdigest(s, seed) for s in shingles(text, width)], np.uint64)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set: 8 masked additions instead of 64.

    Every byte of a word counts one bit; sums run over blocks of 255 hashes, so
    that no byte overflows however long the text is.
    """
    at = np.arange(0, len(hashes), _BLOCK)
    counts = np.empty((8, 8), np.int64)
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & _ONES, at)
        counts[k] = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return counts.T.reshape(64)  # byte b, bit k -> 8 * b + k (little endian)


def simhash(text: str | None, width: int, seed: int) -> int:
    """Signed 64-bit fingerprint: a bit is 1 if set in over half of the shingle hashes."""
    return _majority(shingle_hashes(text, width, seed))


def _majority(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    bits = bit_counts(hashes) * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def wide_simhash(text: str | None, width: int, seed: int) -> tuple[int, int, np.ndarray]:
    """128 bits of the *set* of shingles, as two signed longs; and the shingles' hashes, sorted as unsigned. The second 64 bits are of the hashes' own hashes."""
    found = distinct(_joint(text, width, seed))
    return _majority(found), _majority(_mixed(found ^ _SECOND)), found.view(np.int64)


def jaccard(a: str | None, b: str | None, width: int) -> float:
    """Shared shingles over all distinct shingles of two texts; 1 for two texts without words."""
    x, y = set(shingles(a, width)), set(shingles(b, width))
    return len(x & y) / len(x | y) if x or y else 1.0


def shingle_set(text: str | None, width: int, seed: int) -> np.ndarray:
    """The distinct shingles' hashes as :func:`wide_simhash` returns them, without its fingerprint."""
    return distinct(_joint(text, width, seed)).view(np.int64)


def distinct(values: np.ndarray) -> np.ndarray:
    """What ``np.unique`` returns, by sorting alone: for whole numbers that is a table of hashes and a sort."""
    values = np.sort(values)
    fresh = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=fresh[1:])
    return values[fresh]


_SECOND = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one map of 64 bits that any bit changes half of (SplitMix64's)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _joint(text: str | None, width: int, seed: int) -> np.ndarray:
    """A hash of every shingle, from its words' XXH64: each different word is hashed once, and shingles are made for the whole text at once."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    known = {w: xxh64_intdigest(w, seed) for w in set(words)}
    each = np.array([known[w] for w in words], np.uint64)
    width = min(width, len(words))
    last = len(words) - width + 1
    factors = _factors(width)
    # the number of words goes in, too: a short text is no shingle of a longer one
    found = each[:last] * factors[0] + np.uint64(width)
    for k in range(1, width):
        found += each[k : k + last] * factors[k]
    return _mixed(found)


@cache
def _factors(width: int) -> np.ndarray:
    """An odd number for each place of a shingle."""
    return _mixed(np.arange(1, width + 1, dtype=np.uint64) * _SECOND) | np.uint64(1)
