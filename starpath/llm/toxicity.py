"""Toxicity of restored text.

Words are restored by the noisy channel of ``deobfuscation`` and give features: the word and its first
letters. On a bounded sample of labelled documents, each feature's log odds are estimated and lowered by
their uncertainty, and those that clearly speak for the label are kept. A logistic regression turns a
document's evidence (its strongest word, all its evidence, the number of telling words) into a
probability; for fitting it, each half of the sample is judged by the odds of the other half. Every
document is then scored in one pass over its whole text.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starpath.llm.common import written
from starpath.llm.deobfuscation import Restorer, costs, trigram_counts

#: Labelled documents that are fitted on, at most.
SAMPLE = 16_000
#: Features kept, at most; the strongest ones.
FEATURES = 20_000
#: Parts of the sample for fitting the logistic regression.
FOLDS = 4
PREFIXES = (4, 5, 6, 7, 8)
#: Least lowered log odds of a kept feature.
LEAST_ODDS = 2.5
#: Tokens a worker remembers the evidence of; the memory bound.
REMEMBERED = 300_000
PREDICTED_AT = 0.7


def held_out(id_column: str = "doc_id") -> Column:
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % 3 == 1


def features_of(word: str) -> list[str]:
    return [word + "."] + [word[:n] for n in PREFIXES if len(word) >= n]


def restored_words(text: str | None, restorer: Restorer) -> list[str]:
    """Words of a text, each token restored; runs of single characters are restored together."""
    tokens = (text or "").lower().split()
    out: list[str] = []
    for run, group in _runs(tokens):
        out += restorer.spaced(run) if run else [w for t in group for w in restorer.words(t)]
    return out


def _runs(tokens: list[str]) -> Iterator[tuple[str, list[str]]]:
    """Stretches of at least three one-character tokens, and the tokens between them."""
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    single = np.concatenate([[0], sizes == 1, [0]]).astype(np.int8)
    edges = np.flatnonzero(np.diff(single)).reshape(-1, 2)
    at = 0
    for start, end in edges[edges[:, 1] - edges[:, 0] >= 3].tolist() if len(tokens) else []:
        if start > at:
            yield "", tokens[at:start]
        last = tokens[end][0] if end < len(tokens) and len(tokens[end]) == 2 and not tokens[end][1].isalnum() else ""
        yield "".join(tokens[start:end]) + last, []
        at = end + bool(last)
    if at < len(tokens):
        yield "", tokens[at:]


class Scorer:
    """Evidence of a text: strongest word, sum of evidence of distinct words, and their number, all damped."""

    def __init__(self, weights: dict[str, float], cost: np.ndarray):
        self.weights, self.restorer = weights, Restorer(cost)
        self.known: dict[str, float] = {}

    def weigh(self, words: list[str]) -> float:
        return max((self.weights.get(f, 0.0) for w in words for f in features_of(w)), default=0.0)

    def evidence(self, text: str | None) -> tuple[float, float, float]:
        known, found = self.known, []
        if len(known) > REMEMBERED:
            known.clear()
        for run, group in _runs((text or "").lower().split()):
            if run:
                found.append(self.weigh(self.restorer.spaced(run)))
                continue
            for token in group:
                if token not in known:
                    known[token] = self.weigh(self.restorer.words(token))
            found += {t: w for t, w in zip(group, map(known.__getitem__, group)) if w}.values()
        found = [w for w in found if w]
        return max(found, default=0.0), math.log1p(sum(found)), math.log1p(len(found))


def _sample(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """``_id, label, fold``: at most ``bound`` labelled documents outside the held-out part, by hash of the id."""
    usable = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(
        F.max(label).alias("label"))
    return usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound).select(
        F.col("doc_id").alias("_id"), "label", F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(FOLDS)).alias("fold"))


def feature_counts(sample: DataFrame, cost: np.ndarray) -> DataFrame:
    """``feature`` and documents with it by fold and label (``_CELLS``); the empty feature has all documents."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(cost)

        def rows(counts: dict[str, list[int]]) -> pa.RecordBatch:
            columns = np.array(list(counts.values()), np.int64).reshape(-1, len(_CELLS))
            return pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.string()), *(pa.array(columns[:, k]) for k in range(len(_CELLS)))], names=["feature", *_CELLS])

        counts: dict[str, list[int]] = {}
        for batch in batches:
            for value, label, fold in zip(*(c.to_pylist() for c in batch.columns)):
                cell = 2 * fold + label
                for feature in {"", *(f for w in set(restored_words(value, restorer)) for f in features_of(w))}:
                    counts.setdefault(feature, [0] * len(_CELLS))[cell] += 1
                if len(counts) > 300_000:
                    yield rows(counts)
                    counts = {}
        yield rows(counts)

    sums = sample.select("text", F.col("label").cast("int"), F.col("fold").cast("int")).mapInArrow(
        count, "feature string, " + ", ".join(f"{c} long" for c in _CELLS)).groupBy("feature").agg(
        *(F.sum(c).alias(c) for c in _CELLS))
    return written(sums.filter((_toxic(range(FOLDS)) > 1) | (F.col("feature") == "")), "feature-counts")


def _toxic(folds: Iterable[int], label: int = 1) -> Column:
    return sum((F.col(f"n{fold}{label}") for fold in folds), F.lit(0))


def feature_weights(counts: DataFrame, folds: list[int]) -> dict[str, float]:
    """Lowered log odds of the telling features, from these folds of the sample."""
    clean, toxic = _toxic(folds, 0), _toxic(folds)
    tallied = counts.select("feature", clean.alias("clean"), toxic.alias("toxic"))
    whole = tallied.filter("feature = ''").first()
    if whole is None or not whole.toxic or not whole.clean:
        return {}
    odds = F.log((F.col("toxic") + 0.5) / (whole.toxic + 1)) - F.log((F.col("clean") + 0.5) / (whole.clean + 1))
    spread = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    best = tallied.filter("feature <> '' and toxic > 1").withColumn("weight", odds - spread).filter(
        F.col("weight") > LEAST_ODDS).orderBy(F.desc("weight"), "feature").limit(FEATURES).collect()
    return {row.feature: row.weight for row in best}


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.1) -> np.ndarray:
    """Newton's method; the last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty * w
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w)), gradient)
    return w


class ToxicityModel:
    """Weights of features, costs of the character model and the logistic weights; of bounded size."""

    def __init__(self, weights: dict[str, float], cost: np.ndarray, logistic: np.ndarray):
        self.weights, self.cost, self.logistic = weights, cost, logistic

    def evidence(self, docs: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
        """``columns`` and the three measures of evidence."""
        weights, cost = self.weights, self.cost

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer = Scorer(weights, cost)
            for batch in batches:
                values = [scorer.evidence(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
                measures = np.array(values, float).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-1], *(pa.array(measures[:, k]) for k in range(3))], names=[*columns, *_MEASURES])

        rows = docs.select(*columns, F.col(text).cast("string").alias("_text"))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
        return rows.mapInArrow(score, ", ".join([schema, *(f"{m} double" for m in _MEASURES)]))

    def score(self, docs: DataFrame, columns: list[str], text: str = "text", name: str = "score") -> DataFrame:
        """``columns`` of each row and its score, 0 to 1, as ``name``."""
        *weights, bias = (float(w) for w in self.logistic)
        logit = sum((F.col(m) * w for m, w in zip(_MEASURES, weights)), F.lit(bias))
        return self.evidence(docs, columns, text).select(*columns, (1 / (1 + F.exp(-logit))).alias(name))


_CELLS = tuple(f"n{fold}{label}" for fold in range(FOLDS) for label in (0, 1))
_MEASURES = ("_strongest", "_total", "_number")


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", bound: int = SAMPLE) -> ToxicityModel:
    """A model from at most ``bound`` documents with ``doc_id`` in ``labels``; the character model is from all texts."""
    cost = costs(trigram_counts(docs))
    picked = F.broadcast(_sample(docs, labels, label, bound))
    sample = written(docs.select("doc_id", "text").join(picked, F.col("doc_id") == F.col("_id")).select(
        "doc_id", "text", "label", "fold"), "labelled-sample")
    counts = feature_counts(sample, cost)
    others = [[other for other in range(FOLDS) if other != fold] for fold in range(FOLDS)]
    judged = [ToxicityModel(feature_weights(counts, others[fold]), cost, np.zeros(4)).evidence(
        sample.filter(F.col("fold") == fold), ["label"]) for fold in range(FOLDS)]
    rows = reduce(DataFrame.union, judged).toArrow()
    y = rows["label"].to_numpy().astype(float)
    x = np.stack([rows[m].to_numpy() for m in _MEASURES], 1)
    logistic = fit_logistic(x, y) if len(y) else np.array([1.0, 0, 0, -3.0])
    return ToxicityModel(feature_weights(counts, list(range(FOLDS))), cost, logistic)


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", bound: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Labels are learnt only where ``held_out`` is false. Null and empty texts have no evidence and get the
    score of that. A document labelled more than once counts as toxic if any label says so. Rows repeated
    are scored each; null ids are scored and never learnt from; without labels of both kinds the score is
    that of no evidence. Other columns are ignored; no rows in, no rows out.
    """
    model = fit_toxicity(docs, labels, label, bound)
    return model.score(docs, ["doc_id"]).select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= PREDICTED_AT).cast("int").alias("predicted"))
