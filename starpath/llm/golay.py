"""The perfect binary Golay code of length 23, and keys of fingerprints that differ in few bits.

Each of the 2^23 words lies within three bits of exactly one codeword. Take a word's nearest codeword and,
where that is three bits off, also the five at four bits: one or six codewords. Of two words that differ in
one bit, each has the other's nearest codeword among its own: it is at most four bits off, and if it is four
off, the word's own nearest one is three off, since otherwise both words would be nearest to that one.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits, which are words with leading zeros. Three
errors or fewer over three segments leave

- a segment without an error and another without one, or
- a segment without an error and another with one, or
- one error in each segment.

For each case fingerprints that differ so share a key. One error changes a segment's parity, so in the last
two cases those with even parity answer with their nearest codeword, and those with odd parity ask with all.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

LENGTH, CHECKS = 23, 11
#: Fixed value: a generator polynomial of the code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
#: Lowest bit and width of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
ANSWERS, ASKS = 1, 2
_PAYLOAD = 44


def _syndrome(word: int) -> int:
    for bit in range(LENGTH - 1, CHECKS - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - CHECKS)
    return word


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and high 11 bits, and per syndrome the error patterns of up to four bits, nearest first."""
    bits = [_syndrome(1 << k) for k in range(LENGTH)]

    def xors(values: list[int]) -> np.ndarray:
        out = np.zeros(1, np.int64)
        for value in values:
            out = np.concatenate([out, out ^ value])
        return out

    errors: list[list[int]] = [[] for _ in range(1 << CHECKS)]
    for weight in range(5):
        for places in combinations(range(LENGTH), weight):
            syndrome = 0
            for place in places:
                syndrome ^= bits[place]
            if weight < 4 or errors[syndrome][0].bit_count() == 3:
                errors[syndrome].append(sum(1 << place for place in places))
    near = np.full((1 << CHECKS, 6), -1, np.int64)
    for syndrome, patterns in enumerate(errors):
        near[syndrome, :len(patterns)] = patterns
    return xors(bits[:12]), xors(bits[12:]), near


_LOW, _HIGH, _NEAR = _tables()


def codewords(words: np.ndarray) -> np.ndarray:
    """Per word the 12-bit indices of its codewords, nearest first; -1 where there are fewer than six."""
    patterns = _NEAR[_LOW[words & 0xFFF] ^ _HIGH[words >> 12]]
    return np.where(patterns < 0, -1, (words[:, None] ^ patterns) >> CHECKS)


def keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(rows, keys, sides)``: the keys of 64-bit fingerprints, by row; a side is ``ANSWERS``, ``ASKS`` or both."""
    whole = fingerprints.astype(np.uint64)
    parts = [((whole >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    found = [codewords(part) for part in parts]
    odd = [np.bitwise_count(part) % 2 == 1 for part in parts]
    every = np.arange(len(whole))
    out: list[tuple[np.ndarray, np.ndarray, int]] = []
    tag = 0

    def post(rows: np.ndarray, payload: np.ndarray, side: int) -> None:
        out.append((rows, (np.int64(tag) << _PAYLOAD) | payload, side))

    for i, j in combinations(range(3), 2):
        post(every, parts[i] << 21 | parts[j], ANSWERS | ASKS)
        tag += 1
    for i in range(3):
        for j in range(3):
            if i != j:
                even, rows = np.flatnonzero(~odd[j]), np.flatnonzero(odd[j])
                post(even, parts[i][even] << 12 | found[j][even, 0], ANSWERS)
                at, which = np.nonzero(found[j][rows] >= 0)
                post(rows[at], parts[i][rows[at]] << 12 | found[j][rows[at], which], ASKS)
                tag += 1
    even, rows = np.flatnonzero(~odd[0]), np.flatnonzero(odd[0])
    a, b, c = found
    post(even, a[even, 0] << 24 | b[even, 0] << 12 | c[even, 0], ANSWERS)
    for x in range(6):
        for y in range(6):
            for z in range(6):
                ask = rows[(a[rows, x] >= 0) & (b[rows, y] >= 0) & (c[rows, z] >= 0)]
                post(ask, a[ask, x] << 24 | b[ask, y] << 12 | c[ask, z], ASKS)
    return (np.concatenate([rows for rows, _, _ in out]), np.concatenate([k for _, k, _ in out]),
            np.concatenate([np.full(len(rows), side, np.int8) for rows, _, side in out]))
