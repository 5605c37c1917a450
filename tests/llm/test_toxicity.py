from __future__ import annotations

import zlib

import numpy as np
import pytest

from starpath.llm.deobfuscation import SYMBOLS, Restorer, code, costs
from starpath.llm.toxicity import Scorer, _runs, toxicity
from tests.llm.helpers import ODD, documents, prose

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def restorer():
    counts = np.zeros((SYMBOLS,) * 3)
    for word in ("idiot moron stupid scum loser hello world nation other their reading mention editor people".split()
                 + prose(3, 400).split()):
        letters = [0, 0, *(code(c) for c in word if c.isalpha()), 0]
        for a, b, c in zip(letters, letters[1:], letters[2:]):
            counts[a, b, c] += 1
    return Restorer(costs(counts.ravel()))


@pytest.mark.parametrize("token, word", [
    ("1d10t", "idiot"), ("m0r0n", "moron"), ("stuuuupid", "stupid"), ("s.c.u.m", "scum"), ("l0s3r!", "loser"),
    ("$tupid", "stupid"), ("id*ot", "idiot"), ("hello,", "hello"), ("idiot!!", "idiot")])
def test_restored(restorer, token, word):
    assert word in restorer.words(token)


def test_plain_words_and_numbers_stay(restorer):
    assert restorer.words("naïve") == ["naïve"]
    assert restorer.words("2024") == ["2024"]
    assert restorer.words("***") == []
    assert restorer.spaced("idiot") == ["idiot"]


def test_runs_of_single_characters():
    assert list(_runs("you i d i o t. go a b".split())) == [("", ["you"]), ("idiot", []), ("", ["go", "a", "b"])]
    assert list(_runs([])) == []


def test_evidence_finds_disguised_words(restorer):
    scorer = Scorer({"idiot.": 4.0}, np.array(restorer.cost))
    assert scorer.evidence("what an 1d10t")[0] == 4.0
    assert scorer.evidence("i d i o t you are")[0] == 4.0
    assert scorer.evidence(None) == scorer.evidence("good day") == (0.0, 0.0, 0.0)


def test_learns_restored_words_and_holds_out(spark):
    texts = ODD + [prose(k, 20) + (" you idiot moron" if k % 4 == 0 else "") for k in range(240)]
    texts += [prose(k + 300, 20) + " 1d10t m0r0n" for k in range(12)] + [prose(k + 400, 20) for k in range(12)]
    labels = [(k, 1 if "idiot" in (t or "") else 0) for k, t in enumerate(texts) if k < 255]
    frame = spark.createDataFrame(labels + [(1, None), (None, 1)], "doc_id long, toxic int")
    rows = {r.doc_id: r for r in toxicity(documents(spark, texts, extra=True), frame).collect()}
    assert len(rows) == len(texts)
    for key, row in rows.items():
        assert row.held_out == (zlib.crc32(str(key).encode()) % 3 == 1)
        assert 0 <= row.score <= 1 and row.predicted == int(row.score >= 0.7)
        bad = any(w in (texts[key] or "") for w in ("idiot", "1d10t"))
        assert row.predicted == bad


def test_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity(documents(spark, []), none).count() == 0
    assert {r.predicted for r in toxicity(documents(spark, [(1, "a"), (1, "a"), (None, None)]), none).collect()} == {0}


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    clean = [r for r in rows if not r.toxic]
    assert sum(r.predicted for r in clean) <= 0.02 * len(clean)
    assert np.mean([r.score for r in rows if r.toxic]) > 5 * np.mean([r.score for r in clean])
