"""Token ids of whole texts, encoding each distinct word of many texts once.

Both tokenizers cut a text into words before they merge, and no word's ids depend on its neighbours. So texts are cut
at white space where that is certain to be a word boundary, and what follows a word as a token of its own is parted from
it. The distinct words of Latin letters go to the tokenizer in long strings, as the tokens that start or end a word
show where each one's ids begin; the ids are then put together by place. Nothing is kept between calls, so memory
follows from the size of a call (``by_size``). Whatever is not plain (runs of blanks, other scripts, special tokens'
strings, digits) is encoded as it stands. Tests compare all this with encoding whole texts.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

_LETTERS = "a-zA-ZÀ-ÖØ-öø-ÿ"
#: A word, with the blank before it, and what follows it as a token of its own; or any other piece.
_WORDS = re.compile(f"^( ?[{_LETTERS}]+)([.,;:!?|#$%&*]*)$|^(.+)$", re.MULTILINE)
#: Stands between pieces while a text is cut.
_CUT = "\x1f"
#: Python cuts at these, the tokenizers don't.
_CONTROL = re.compile("[\x1c-\x1f]")
_coders: dict[str, "Coder"] = {}


def _gathered(ids: np.ndarray, sizes: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of units in the given order, and where each ends; ``sizes`` are the units' numbers of ids."""
    each = sizes[units]
    ends = np.cumsum(each)
    shift = (np.cumsum(sizes) - sizes)[units] - (ends - each)
    return ids[np.repeat(shift, each) + np.arange(len(shift) and ends[-1])], ends


class Coder:
    """``encode_all(texts)`` gives each text's ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        # one thread: others would each hold memory of their own, and tasks share the cores already
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ["RAYON_NUM_THREADS"] = "1"
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.byte_level = self.tokenizer.normalizer is None
        size = max(vocabulary.values()) + 1
        #: Ids that start a word with a blank (byte-level) or end one (word ends).
        self.edge = np.zeros(size, bool)
        for token, number in vocabulary.items():
            self.edge[number] = token.startswith("Ġ") if self.byte_level else token.endswith("</w>")

    def plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _each(self, pieces: list[str]) -> list[np.ndarray]:
        """The ids of pieces, one by one."""
        found = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False) if pieces else []
        return [np.array(x.ids, "<u4") for x in found]

    def _strung(self, words: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The ids of words of Latin letters, for the byte-level kind each with a blank before it, and each word's number of them."""
        ids, sizes = [], []
        for at in range(0, len(words), 500):
            part = words[at:at + 500]
            text = ("" if self.byte_level else " ").join(part)
            ids.append(np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4"))
            edges = np.flatnonzero(self.edge[ids[-1]])
            cuts = np.append(edges, len(ids[-1])) if self.byte_level else np.insert(edges + 1, 0, 0)
            assert len(cuts) == len(part) + 1
            sizes.append(np.diff(cuts))
        return ids, sizes

    def _ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct pieces, one after the other, and each piece's number of them."""
        if "\n" in pieces:
            pieces[pieces.index("\n")] = _CUT
        found = _WORDS.findall("\n".join(pieces)) if pieces else []
        assert len(found) == len(pieces)
        bodies, marks, odd = (pa.array(part, pa.string()) for part in zip(*found)) if found else [pa.array([], pa.string())] * 3
        is_odd = pc.binary_length(odd).to_numpy() > 0
        marks, odd = marks.dictionary_encode(), odd.dictionary_encode()
        bodies = (bodies if self.byte_level else pc.utf8_lower(bodies)).dictionary_encode()
        names = bodies.dictionary.to_pylist()
        strung = np.array([not self.byte_level or name.startswith(" ") for name in names], bool) & np.array([*map(bool, names)], bool)
        ids, sizes = self._strung([name for name, one in zip(names, strung) if one])
        alone = [name for name, one in zip(names, strung) if not one] + marks.dictionary.to_pylist() + [
            "\n" if other == _CUT else other for other in odd.dictionary.to_pylist()]
        rest = self._each(alone)
        sizes = np.concatenate([*sizes, [len(x) for x in rest]]).astype(np.int64)
        # units: strung bodies, other bodies, marks, odd pieces; a piece has a body or is odd
        place = np.empty(len(names), np.int64)
        place[strung], place[~strung] = np.arange(strung.sum()), strung.sum() + np.arange((~strung).sum())
        body, mark, other = (x.indices.to_numpy() for x in (bodies, marks, odd))
        units = np.stack([np.where(is_odd, len(names) + len(marks.dictionary) + other, place[body] if len(names) else body),
                          len(names) + mark], 1)
        each = sizes[units]
        return _gathered(np.concatenate([*ids, *rest, np.zeros(0, "<u4")]), sizes, units.ravel())[0], each.sum(1)

    def _cut(self, text: str) -> list[str] | None:
        """The pieces of a text, or nothing where it has to be encoded as it stands."""
        if not text or "<|" in text or _CUT in text:
            return None
        if not self.byte_level:
            return None if _CONTROL.search(text) else text.split()
        pieces = text.replace(" ", _CUT + " ").replace("\n", f"{_CUT}\n{_CUT}").split(_CUT)
        # each piece is one word: none is empty, and there are as many as white space of any kind makes
        single = len(pieces) - text.count("\n") == len(text.split())
        return pieces if single and "" not in pieces and " " not in pieces else None

    def encode_all(self, texts: list[str]) -> list[bytes]:
        cut = [self._cut(text) for text in texts]
        words = pa.array([piece for pieces in cut if pieces for piece in pieces], pa.string()).dictionary_encode()
        ids, sizes = self._ids(words.dictionary.to_pylist())
        joined, ends = _gathered(ids, sizes, words.indices.to_numpy())
        ends = np.append(0, ends)
        out, at = [], 0
        for text, pieces in zip(texts, cut):
            if pieces is None:
                out.append(self.plain(text) if text else b"")
            else:
                out.append(joined[ends[at]:ends[at + len(pieces)]].tobytes())
                at += len(pieces)
        return out


def coder(path: str) -> Coder:
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """A function from texts to ids; the tokenizer is read once per worker process."""
    return lambda texts: coder(path).encode_all(texts)


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def by_size(texts: list[str], most: int = 2_000_000) -> Iterator[list[str]]:
    """Runs of texts of about ``most`` characters."""
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text)
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part
