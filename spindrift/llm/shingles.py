"""Words, word shingles and their hashes, computed for one text at a time inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

_WHITE = b" \t\n\x0b\x0c\r"


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as UTF-8; null has none.

    ``bytes.split()`` splits at exactly these six characters.
    """
    return text.encode("utf-8", "surrogatepass").split() if text else []


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``size``-word shingles, A-Z lower-cased.

    With fewer words than ``size`` the whole sequence is the only shingle; without words the
    set is empty.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    width = min(size, n)
    mixed = hashes[: n - width + 1].copy()
    for i in range(1, width):
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed += hashes[i : n - width + 1 + i]
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    if width < size:  # a short sequence never equals a full shingle
        mixed ^= np.uint64(width)
    mixed.sort()
    keep = np.empty(len(mixed), bool)
    keep[0] = True
    np.not_equal(mixed[1:], mixed[:-1], out=keep[1:])
    return mixed[keep]

