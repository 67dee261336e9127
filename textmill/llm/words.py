"""Words, shingles and their hashes, shared by the text operators."""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: A word is a longest run of letters and digits; marks and underscores separate.
WORD = re.compile(r"[^\W_]+")

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_STEP = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3))


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    s = np.uint64(33)
    x = (x ^ (x >> s)) * _M1
    x = (x ^ (x >> s)) * _M2
    return x ^ (x >> s)


def hash_words(ws: list[str], seen: dict[str, int]) -> np.ndarray:
    """64-bit hashes of words; ``seen`` keeps those of frequent words."""
    if len(seen) > 200_000:
        seen.clear()
    out = []
    for w in ws:
        h = seen.get(w)
        if h is None:
            h = seen[w] = xxhash.xxh64_intdigest(w)
        out.append(h)
    return np.array(out, dtype=np.uint64)


def shingle_hashes(ws: list[str], size: int, seen: dict[str, int]) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words.

    Fewer words than ``size`` make one run; no word makes none.
    """
    if not ws:
        return np.empty(0, np.uint64)
    h = hash_words(ws, seen)
    k = min(size, len(h))
    n = len(h) - k + 1
    acc = np.full(n, np.uint64(k))
    for j in range(k):
        acc = mix(acc + h[j : j + n] * _STEP[j % 5] + np.uint64(j))
    return np.unique(acc)
