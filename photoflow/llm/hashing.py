"""Hashes of all words of many texts at once, in numpy: what tasks of the text operators share.

A word's hash is a polynomial of its characters, taken as the difference of two prefix sums, so that the cost is per
character and not per word. All arithmetic is modulo 2**64.
"""

from __future__ import annotations

import numpy as np
import xxhash

_U = np.uint64
#: Fixed odd multipliers.
P = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]
#: Characters that are hashed together; a word of more is hashed by itself.
CHUNK = 1 << 20
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of each number."""
    x = (x ^ (x >> _U(32))) * P[3]
    x = (x ^ (x >> _U(29))) * P[4]
    return x ^ (x >> _U(32))


def _power(name: str, base: int) -> np.ndarray:
    if name not in _powers:
        out = np.full(CHUNK + 1, base % 2**64, dtype=np.uint64)
        out[0] = 1
        _powers[name] = np.multiply.accumulate(out)
    return _powers[name]


def spans(apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs start and end that ``apart`` (bool by character) leaves."""
    edges = np.flatnonzero(np.diff(np.concatenate((np.ones(1, np.int8), apart.view(np.int8), np.ones(1, np.int8)))))
    return edges[::2], edges[1::2]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of ``values[start:end]`` for each of ascending spans that don't overlap."""
    base = int(P[5])
    up, down = _power("up", base), _power("down", pow(base, -1, 2**64))
    out = np.empty(len(starts), dtype=np.uint64)
    k = 0
    with np.errstate(over="ignore"):
        while k < len(starts):
            low = starts[k]
            to = int(np.searchsorted(ends, low + CHUNK, side="right"))
            if to <= k:  # one span of more than CHUNK
                out[k] = xxhash.xxh3_64_intdigest(np.ascontiguousarray(values[low : ends[k]]).tobytes())
                k += 1
                continue
            v = (values[low : ends[to - 1]].astype(np.uint64) + _U(1)) * P[0]
            v ^= v >> _U(29)
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(v * up[: len(v)], dtype=np.uint64)))
            s, e = starts[k:to] - low, ends[k:to] - low
            out[k:to] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * P[6])
            k = to
    return out
