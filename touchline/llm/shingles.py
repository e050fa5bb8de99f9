"""Word shingles of whole texts as 64-bit hashes, in numpy batches."""

from __future__ import annotations

import numpy as np
import xxhash

FACTOR = np.uint64(0x9E3779B97F4A7C15)
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


class _Hashes(dict):
    """Hash of each word seen, computed once; emptied when it grows too large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 150_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_HASHES = _Hashes()


def words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z in lower case; none of a null text."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles of ``size`` words.

    With fewer words the whole sequence is one shingle; without a word there is none.
    """
    found = words(text)
    if not found:
        return np.empty(0, np.uint64)
    size = min(size, len(found))
    one = np.fromiter(map(_HASHES.__getitem__, found), np.uint64, len(found))
    total = one[: len(found) - size + 1].copy()
    for i in range(1, size):
        total *= FACTOR
        total ^= total >> np.uint64(29)
        total += one[i : len(found) - size + 1 + i]
    total ^= total >> np.uint64(30)
    total *= MIX[0]
    total ^= total >> np.uint64(27)
    total *= MIX[1]
    total ^= total >> np.uint64(31)
    return np.unique(total >> np.uint64(1))  # 63 bits: the same order as signed numbers


def shingle_set(text: str | None, size: int) -> set[tuple[bytes, ...]]:
    """The distinct shingles themselves, for exact comparisons."""
    found = words(text)
    if not found:
        return set()
    size = min(size, len(found))
    return set(zip(*[found[i:] for i in range(size)]))
