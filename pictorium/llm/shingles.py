"""Five-word shingles of a text as 64-bit hashes, in NumPy.

Words are runs of bytes other than the six ASCII spaces, with A-Z in lower case. A shingle's hash is a multilinear
form of its words' xxHash values, mixed once more: two different shingles agree with probability about 2^-64.
"""

from __future__ import annotations

import numpy as np
import xxhash

WIDTH = 5
_RANDOM = np.random.Generator(np.random.PCG64(20240517))


def odd(n: int) -> np.ndarray:
    """n random odd 64-bit numbers; the same for every process, as long as they are drawn in the same order."""
    return _RANDOM.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_TERMS = odd(WIDTH + 1)
_SHIFT, _MIX = np.uint64(31), np.uint64(0xBF58476D1CE4E5B9)


def words(text: bytes) -> list[bytes]:
    return text.lower().split()


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _SHIFT)) * _MIX
    return h ^ (h >> _SHIFT)


def positions(parts: list[bytes]) -> np.ndarray:
    """The hash of the shingle at each position; a text of fewer words is one shingle, one without words has none."""
    n = len(parts)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, parts), np.uint64, n)
    if n < WIDTH:
        return mixed((h * _TERMS[:n]).sum(dtype=np.uint64, keepdims=True) + _TERMS[WIDTH:] * np.uint64(n))
    out = h[: n - WIDTH + 1] * _TERMS[0]
    for k in range(1, WIDTH):
        out = out + h[k : n - WIDTH + 1 + k] * _TERMS[k]
    return mixed(out)


def shingle_set(text: bytes) -> np.ndarray:
    """The distinct shingles, sorted."""
    return np.unique(positions(words(text)))
