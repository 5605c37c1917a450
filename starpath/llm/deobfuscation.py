"""Restoring disguised words: Viterbi over a lattice of readings under a character trigram model.

A character may stand for a letter it looks like, for any letter where it masks one, for nothing where it
repeats or separates, or for itself. The trigram model says which reading looks like a word.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Codes of the model: word boundary, a to z, any other letter.
SYMBOLS = 28
_OTHER = SYMBOLS - 1
_LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
          "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
_MASKS, _GAPS = "*#%&^~?", "._-'`,/\\ "
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_EDGES = ".,;:!?\"'()[]{}<>|#$%&*+-=_/\\~^`@…»«¿¡"
_TRIPLE = re.compile(r"(.)\1\1")
_SUSPECT = re.compile(r"[a-z]")
#: Costs of reading a look-alike, a masked letter, a dropped separator, a dropped repeat (in a run, or of a pair).
LOOK, MASK, GAP, REPEAT, PAIR = 1.0, 1.5, 0.7, 0.2, 7.0
BEAM = 16


def code(char: str) -> int:
    return 0 if char == " " else ord(char) - 96 if "a" <= char <= "z" else _OTHER


def trigram_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Counts of letter trigrams over all plain words of all documents; ``SYMBOLS`` cubed numbers."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS ** 3, np.int64)
        table = np.full(256, _OTHER, np.int64)
        table[32] = 0
        table[97:123] = np.arange(1, 27)
        for batch in batches:
            words: Counter = Counter()
            for value in batch.column(0).to_pylist():
                words.update((value or "").lower().split())
            plain = [(w, n) for w, n in words.items() if w.isalpha() and w.isascii()]
            if not plain:
                continue
            data = np.frombuffer(("  " + "  ".join(w for w, _ in plain) + " ").encode(), np.uint8)
            codes = table[data]
            sizes = np.array([len(w) + 2 for w, _ in plain])
            weight = np.repeat(np.array([n for _, n in plain]), sizes)
            cells = codes[:-2] * SYMBOLS * SYMBOLS + codes[1:-1] * SYMBOLS + codes[2:]
            here = min(len(cells), len(weight))
            keep = codes[1:-1][:here] + codes[2:][:here] > 0
            np.add.at(total, cells[:here][keep], weight[:here][keep])
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["cell", "n"])

    sums = docs.select(F.col(text).cast("string")).mapInArrow(count, "cell long, n long").groupBy("cell").agg(
        F.sum("n").alias("n")).toArrow()
    out = np.zeros(SYMBOLS ** 3, np.int64)
    out[sums["cell"].to_numpy()] = sums["n"].to_numpy()
    return out


def costs(counts: np.ndarray) -> np.ndarray:
    """Negative log probabilities ``[second last, last, next]``, each order backed by the one below."""
    three = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
    two = three.sum(0)
    one = two.sum(0)
    p1 = (one + 1) / (one.sum() + SYMBOLS)
    p2 = (two + 20 * p1) / (two.sum(1, keepdims=True) + 20)
    p3 = (three + 20 * p2) / (three.sum(2, keepdims=True) + 20)
    return -np.log(p3)


class Restorer:
    """``words(token)`` and ``spaced(chars)`` give the most likely words."""

    def __init__(self, cost: np.ndarray):
        self.cost = cost.tolist()

    def _readings(self, raw: str, at: int) -> list[tuple[str, float]]:
        char = raw[at]
        out = [(x, LOOK) for x in _LOOKS.get(char, "")]
        if char in _MASKS:
            out += [(x, MASK) for x in _LETTERS]
        if char in _GAPS or char in _MASKS:
            out.append(("", GAP if char in _GAPS else 3 * MASK))
        if char.isalpha():
            out.append((char, 0.0))
            if at and raw[at - 1] == char:
                out.append(("", REPEAT if raw[max(0, at - 2):at + 3].count(char) > 2 else PAIR))
        elif not out or char in " ,/":
            out.append((" ", GAP))
        return out

    def decode(self, raw: str) -> list[str]:
        """Viterbi over all readings; states are the last two letters read."""
        cost = self.cost
        paths: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
        for at in range(len(raw)):
            following: dict[tuple[int, int], tuple[float, str]] = {}
            readings = self._readings(raw, at)
            for (a, b), (spent, read) in paths.items():
                for char, price in readings:
                    if not char or (char == " " and b == 0):
                        state, total, now = (a, b), spent + price, read
                    else:
                        c = code(char)
                        state, total, now = (b, c) if c else (0, 0), spent + price + cost[a][b][c], read + char
                    if state not in following or total < following[state][0]:
                        following[state] = (total, now)
            paths = following if len(following) <= BEAM else dict(sorted(following.items(), key=lambda x: x[1][0])[:BEAM])
        best = min(paths.items(), key=lambda x: x[1][0] + (cost[x[0][0]][x[0][1]][0] if x[0][1] else 0))
        return best[1][1].split()

    def words(self, token: str) -> list[str]:
        """The words of one lower-case token; nearly all have one reading, themselves."""
        core = token.strip(_EDGES)
        if core.isalpha() and not _TRIPLE.search(core):
            return [core] if token[0] not in "$@" else sorted({core, *self.decode(token[0] + core)})
        whole = token.strip(".,;:\"'()[]{}<>").rstrip("!?")
        if not _SUSPECT.search(whole):
            return [core] if core else []
        if core.isalpha() and core != whole:
            return sorted({*self.decode(core), core})
        return self.decode(whole)

    def spaced(self, chars: str) -> list[str]:
        """The words of single characters that stood apart: a blank may be a boundary or a disguise."""
        return self.decode(" ".join(chars))
