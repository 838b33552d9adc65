"""Prefix polynomial hashes of byte strings, modulo 2**64.

With ``P[i]`` the sum of ``value(b[j]) * BASE**j`` over ``j < i``, the hash of the
bytes from ``s`` to ``e`` is ``(P[e] - P[s]) * BASE**-s``: it depends on the bytes
alone, wherever they stand, and costs two look-ups.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = 0x9E6C63D0876A9A47 | 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads each bit over all of them."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: A random 64-bit value for each byte.
BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers 0 to n."""
    size = 1 << max(12, int(n).bit_length())
    if size not in _powers:
        if len(_powers) > 2:
            _powers.clear()
        inverse = pow(BASE, -1, 1 << 64)
        table = []
        for b in (BASE, inverse):
            out = np.full(size, b, np.uint64)
            out[0] = 1
            table.append(np.multiply.accumulate(out))
        _powers[size] = (table[0], table[1])
    return _powers[size]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of the bytes of each span; equal spans have equal hashes."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def window_hash(prefix: np.ndarray, width: int) -> np.ndarray:
    """span_hash of every window of ``width`` bytes."""
    n = len(prefix) - width
    if n <= 0:
        return np.zeros(0, np.uint64)
    _, down = powers(len(prefix))
    return mix((prefix[width:] - prefix[:n]) * down[:n] + U(width))


def common_extension(prefix: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many bytes the suffixes at ``a`` and ``b`` share, ``most`` at most: a binary search over hashes."""
    _, down = powers(len(prefix))
    before_a, before_b, down_a, down_b = prefix[a], prefix[b], down[a], down[b]
    low, high = np.zeros(len(a), np.int64), most.astype(np.int64)
    for _ in range(int(most.max(initial=0)).bit_length()):
        mid = (low + high + 1) >> 1
        # spans of one length need no mixing to be told apart
        same = (prefix[a + mid] - before_a) * down_a == (prefix[b + mid] - before_b) * down_b
        low, high = np.where(same, mid, low), np.where(same, high, np.maximum(mid - 1, low))
    return low
