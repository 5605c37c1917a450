"""Language identification of code-switched text by a linear-chain conditional random field.

Each word has a label. Its features are affixes, letter trigrams and the word itself (the lexicon),
hashed into a fixed number of weights per language; neighbouring labels have learnt transition weights.
Training chains are spans of labelled documents, some of them put together from documents in different
languages, so that switches are seen. Gradients come from forward-backward. A text's language is the one
with the largest share of its words, by the words' marginals over the whole text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spans of labelled documents that are fitted on, at most, and words of a span.
SPANS, SPAN_WORDS = 16_000, 32
BUCKETS = 1 << 16
#: Spans put together in one training chain.
CHAIN = 2
PASSES, BATCH, RATE, DECAY = 6, 500, 0.5, 1e-6
#: Words a worker remembers; the memory bound. Words labelled at once.
REMEMBERED, AT_ONCE = 300_000, 300_000
UNKNOWN = "und"

_EDGES = ".,;:!?\"'()[]{}<>|#$%&*+-=_/\\~^`@…»«¿¡0123456789"


def held_out(id_column: str = "doc_id") -> Column:
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % 3 == 1


def features_of(token: str) -> list[int]:
    """Buckets of a word's features; none without letters."""
    word = token.strip(_EDGES).lower()
    if not any(map(str.isalpha, word)):
        return []
    framed = ("^" + word + "$").encode()
    names = [framed, b"p" + framed[:3], b"s" + framed[-3:], b"q" + framed[:4], b"t" + framed[-4:]]
    names += [framed[k:k + 3] for k in range(len(framed) - 2)]
    return [zlib.crc32(name) % BUCKETS for name in names]


def _sums(weights: np.ndarray, features: list[list[int]]) -> np.ndarray:
    """The sum of each word's weights, ``words x languages``."""
    out = np.zeros((len(features), weights.shape[1]))
    sizes = np.array([len(f) for f in features])
    if sizes.sum():
        flat = np.array([x for f in features for x in f])
        used = np.flatnonzero(sizes)
        starts = np.concatenate([[0], np.cumsum(sizes[used])])[:-1]
        out[used] = np.add.reduceat(weights[flat], starts)
    return out


def marginals(emissions: np.ndarray, lengths: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward on chains of falling length: ``steps x chains x labels`` marginals, and forward scales.

    ``emissions`` and ``transition`` are positive factors (exponentials of scores).
    """
    steps, chains, labels = emissions.shape
    active = np.searchsorted(-lengths, -np.arange(steps), side="left")
    forward, scale = np.zeros_like(emissions), np.ones((steps, chains))
    state = emissions[0] / labels
    for t in range(steps):
        n = active[t]
        if t:
            state = (state[:n] @ transition) * emissions[t, :n]
        total = state.sum(1, keepdims=True)
        state = state / total
        forward[t, :n], scale[t, :n] = state, total[:, 0]
    backward = np.ones((chains, labels))
    for t in range(steps - 2, -1, -1):
        n = active[t + 1]
        ahead = (emissions[t + 1, :n] * backward[:n]) @ transition.T
        backward[:n] = ahead / ahead.sum(1, keepdims=True)
        forward[t, :n] *= backward[:n]
        forward[t, :n] /= forward[t, :n].sum(1, keepdims=True)
    return forward, scale


class LanguageModel:
    """``languages``, weights ``BUCKETS x languages`` and transition scores; of fixed size."""

    def __init__(self, languages: list[str], weights: np.ndarray, transition: np.ndarray):
        self.languages, self.weights, self.transition = languages, weights, transition


def labelled_spans(docs: DataFrame, text: str, label: str, bound: int, words: int) -> DataFrame:
    """``label, words``: at most ``bound`` spans of whole labelled texts, by hash."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, spans, keys = [], [], []
            for value, name, key in zip(*(c.to_pylist() for c in batch.columns)):
                tokens = (value or "").split()
                for number, at in enumerate(range(0, len(tokens), words)):
                    labels.append(name)
                    spans.append(" ".join(tokens[at:at + words]))
                    keys.append(zlib.crc32(f"{key} {number}".encode()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(labels, pa.string()), pa.array(spans, pa.string()), pa.array(keys, pa.int64())],
                names=["label", "words", "key"])

    usable = docs.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    return usable.select(F.col(text).cast("string"), F.col(label).cast("string"), F.col("doc_id").cast("string")).mapInArrow(
        cut, "label string, words string, key long").orderBy("key", "words", "label").limit(bound).select("label", "words")


def fit_language(docs: DataFrame, text: str = "text", label: str = "lang", bound: int = SPANS) -> LanguageModel | None:
    """A model from at most ``bound`` spans; None without labels."""
    rows = labelled_spans(docs, text, label, bound, SPAN_WORDS).toArrow()
    if not rows.num_rows:
        return None
    languages = sorted(set(rows["label"].to_pylist()))
    number = {name: k for k, name in enumerate(languages)}
    spans = [(number[name], words.split()) for name, words in zip(rows["label"].to_pylist(), rows["words"].to_pylist())]
    vocabulary: dict[str, int] = {}
    features: list[list[int]] = []
    for _, words in spans:
        for word in words:
            if word not in vocabulary:
                vocabulary[word] = len(features)
                features.append(features_of(word))
    flat = np.array([x for f in features for x in f] or [0], np.int64)
    owner = np.repeat(np.arange(len(features)), [len(f) for f in features]) if len(features) else np.zeros(0, np.int64)
    flat = flat[:len(owner)]
    starts = np.searchsorted(owner, np.arange(len(features) + 1))
    chance = np.random.default_rng(7)
    labels = len(languages)
    weights, transition = np.zeros((BUCKETS, labels)), np.zeros((labels, labels))
    seen, seen_transition = np.full((BUCKETS, labels), 1e-8), np.full((labels, labels), 1e-8)
    for _ in range(PASSES):
        order = chance.permutation(len(spans))
        chains, at = [], 0
        while at < len(order):
            count = int(chance.integers(1, CHAIN + 1))
            chains.append(order[at:at + count])
            at += count
        for first in range(0, len(chains), BATCH):
            part = [([vocabulary[w] for s in chain for w in spans[s][1]],
                     [spans[s][0] for s in chain for _ in spans[s][1]]) for chain in chains[first:first + BATCH]]
            part = sorted((p for p in part if p[0]), key=lambda p: -len(p[0]))
            if not part:
                continue
            lengths = np.array([len(p[0]) for p in part])
            used, inverse = np.unique(np.concatenate([p[0] for p in part]), return_inverse=True)
            pieces = [flat[starts[u]:starts[u + 1]] for u in used]
            sizes = np.array([len(p) for p in pieces])
            index = np.concatenate(pieces)
            word_of = np.repeat(np.arange(len(used)), sizes)
            scores = np.zeros((len(used), labels))
            for y in range(labels):
                scores[:, y] = np.bincount(word_of, weights[index, y], minlength=len(used))
            factors = np.exp(scores - scores.max(1, keepdims=True))
            steps = lengths[0]
            where_step = np.concatenate([np.arange(n) for n in lengths])
            where_chain = np.repeat(np.arange(len(part)), lengths)
            gold = np.concatenate([p[1] for p in part])
            emissions = np.ones((steps, len(part), labels))
            emissions[where_step, where_chain] = factors[inverse]
            expected_pairs = np.zeros((labels, labels))
            states, _ = marginals(emissions, lengths, np.exp(transition))
            found = states[where_step, where_chain]
            # pair marginals follow from neighbouring marginals and the transition factors
            later = np.flatnonzero(where_step > 0)
            left, right = found[later - 1], found[later]
            pair = left[:, :, None] * np.exp(transition)[None] * right[:, None, :]
            expected_pairs = (pair / pair.sum((1, 2), keepdims=True)).sum(0)
            real_pairs = np.zeros((labels, labels))
            np.add.at(real_pairs, (gold[later - 1], gold[later]), 1)
            miss = -found
            miss[np.arange(len(gold)), gold] += 1
            per_word = np.stack([np.bincount(inverse, miss[:, y], minlength=len(used)) for y in range(labels)], 1)
            gradient = np.stack([np.bincount(index, per_word[word_of, y], minlength=BUCKETS) for y in range(labels)], 1)
            gradient -= DECAY * len(gold) * weights
            seen += gradient ** 2
            weights += RATE * gradient / np.sqrt(seen)
            change = real_pairs - expected_pairs
            seen_transition += change ** 2
            transition += RATE * 0.2 * change / np.sqrt(seen_transition)
    return LanguageModel(languages, weights.astype(np.float32), transition)


class Labeller:
    """``shares(texts)``: for each text the share of its words per language, and its words with letters."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.transition = np.exp(model.transition)
        self.places: dict[str, int] = {}
        self.factors = np.zeros((0, len(model.languages)))
        self.letters = np.zeros(0, bool)

    def _learn(self, words: set[str]) -> None:
        if len(self.places) + len(words) > REMEMBERED:
            self.places, self.factors, self.letters = {}, self.factors[:0], self.letters[:0]
        new = [w for w in words if w not in self.places]
        features = [features_of(w) for w in new]
        scores = _sums(self.model.weights, features)
        self.places.update(zip(new, range(len(self.letters), len(self.letters) + len(new))))
        self.factors = np.concatenate([self.factors, np.exp(scores - scores.max(1, keepdims=True))])
        self.letters = np.concatenate([self.letters, np.array([bool(f) for f in features], bool)])

    def shares(self, texts: list[str | None]) -> np.ndarray:
        """``texts x (languages + 1)``: sums of marginals over words with letters, and the number of these."""
        words = [(x or "").split() for x in texts]
        out = np.zeros((len(texts), len(self.model.languages) + 1))
        order = sorted((k for k, w in enumerate(words) if w), key=lambda k: -len(words[k]))
        at = 0
        while at < len(order):
            size, end = 0, at
            while end < len(order) and (end == at or size < AT_ONCE):
                size += len(words[order[end]])
                end += 1
            part = order[at:end]
            at = end
            unknown: set[str] = set().union(*(words[k] for k in part)).difference(self.places)
            self._learn(set().union(*(words[k] for k in part)) if len(self.places) + len(unknown) > REMEMBERED else unknown)
            lengths = np.array([len(words[k]) for k in part])
            places = np.fromiter((self.places[w] for k in part for w in words[k]), np.int64, int(lengths.sum()))
            step = np.arange(len(places)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            chain = np.repeat(np.arange(len(part)), lengths)
            emissions = np.ones((int(lengths[0]), len(part), len(self.model.languages)))
            emissions[step, chain] = self.factors[places]
            states, _ = marginals(emissions, lengths, self.transition)
            counted = self.letters[places]
            found = states[step[counted], chain[counted]]
            sums = np.stack([np.bincount(chain[counted], found[:, y], minlength=len(part)) for y in range(found.shape[1])]
                            + [np.bincount(chain[counted], minlength=len(part))], 1)
            out[part] = sums
        return out


def predict_language(docs: DataFrame, model: LanguageModel | None, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` of every row; ``score`` is the share of the words in that language."""
    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(model) if model else None
        for batch in batches:
            texts = batch.column(1).to_pylist()
            names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if labeller:
                shares = labeller.shares(texts)
                best = shares[:, :-1].argmax(1)
                for k in np.flatnonzero(shares[:, -1]):
                    names[k] = model.languages[best[k]]
                    scores[k] = min(1.0, shares[k, best[k]] / shares[k, -1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names), pa.array(scores)], names=["id", "lang_pred", "score"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, F.col(text).cast("string")).mapInArrow(
        label, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_column)


def language_id(docs: DataFrame, text: str = "text", label: str = "lang", bound: int = SPANS) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs``.

    Languages are learnt only where ``held_out`` is false and the label is not null. Null texts and texts
    without letters are ``und`` with score 0, as is every text if there are no labels. Repeated rows are
    predicted each; null ids are predicted and never learnt from. Other columns are ignored; no rows in,
    no rows out.
    """
    model = fit_language(docs, text, label, bound)
    return predict_language(docs, model, "doc_id", text).select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
