"""Words of a text as 64-bit hashes, and its set of hashed word shingles."""

from __future__ import annotations

import numpy as np
import xxhash

SHINGLE = 5
#: Words a worker remembers the hash of; the memory bound.
REMEMBERED = 300_000

_FACTORS = [np.uint64(x) for x in (
    0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _Hashes()


def words_of(text: bytes) -> list[bytes]:
    """Words between ASCII white space (0x20, 0x09 to 0x0D), A-Z lower-cased."""
    return text.lower().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    if len(_hashes) > REMEMBERED:
        _hashes.clear()
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


def shingle_hashes(hashes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """One hash per run of ``size`` words (of all words where there are fewer), in order."""
    size = min(size, len(hashes))
    if not size:
        return hashes
    count = len(hashes) - size + 1
    out = np.full(count, np.uint64(size))
    for k in range(size):
        out = mix(out) + hashes[k:k + count] * _FACTORS[k % len(_FACTORS)]
    return mix(out)


def shingle_set(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingle hashes of a text; empty without words."""
    return np.unique(shingle_hashes(word_hashes(words_of(text)), size))
