from __future__ import annotations

import zlib
from itertools import product

import numpy as np

from starpath.llm.language_id import Labeller, LanguageModel, features_of, language_id, marginals
from tests.llm.helpers import ODD, documents


def test_marginals_against_all_paths():
    chance = np.random.default_rng(2)
    lengths = np.array([5, 3, 1])
    emissions, transition = chance.random((5, 3, 3)) + 0.1, chance.random((3, 3)) + 0.1
    states, _ = marginals(emissions.copy(), lengths, transition)
    for chain, size in enumerate(lengths):
        total = np.zeros((size, 3))
        for path in product(range(3), repeat=int(size)):
            weight = np.prod([emissions[t, chain, y] for t, y in enumerate(path)])
            weight *= np.prod([transition[a, b] for a, b in zip(path, path[1:])])
            for t, y in enumerate(path):
                total[t, y] += weight
        assert np.allclose(states[:size, chain], total / total.sum(1, keepdims=True))


def test_features():
    assert features_of("123 ,.".split()[0]) == features_of(",.") == []
    assert features_of("Haus,") == features_of("haus")


def test_held_out_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97


def test_code_switching_and_odd_texts(spark):
    german = "der die das und ist nicht ein eine haus strasse wirklich zwischen"
    english = "the of and that with house street really between another this which"
    texts = [(k, " ".join((german if k % 2 else english).split()[k % 5:] * 6)) for k in range(60)]
    docs = documents(spark, texts + [(100 + k, t) for k, t in enumerate(ODD)], extra=True)
    docs = docs.selectExpr("doc_id", "text", "CASE WHEN doc_id >= 60 THEN NULL WHEN doc_id % 2 = 1 THEN 'de' ELSE 'en' END AS lang", "size")
    rows = {r.doc_id: r for r in language_id(docs).collect()}
    assert all(rows[k].lang_pred == ("de" if k % 2 else "en") for k in range(60))
    for k, text in enumerate(ODD):
        letters = any(map(str.isalpha, text or ""))
        assert (rows[100 + k].lang_pred != "und") == letters
        assert 0 <= rows[100 + k].score <= 1


def test_switch_inside_a_text():
    weights = np.zeros((1 << 16, 2))
    for y, words in enumerate(("aaa abab baab", "zzz zyzy yzzy")):
        for word in words.split():
            weights[features_of(word), y] += 0.6
    labeller = Labeller(LanguageModel(["a", "z"], weights, np.log(np.array([[0.9, 0.1], [0.1, 0.9]]))))
    shares = labeller.shares(["aaa abab baab aaa zzz zyzy", None, "12 ."])
    assert abs(shares[0, 0] - 4) < 0.3 and abs(shares[0, 1] - 2) < 0.3 and shares[0, 2] == 6
    assert not shares[1:].any()


def test_no_labels_and_no_rows(spark):
    assert language_id(documents(spark, [])).count() == 0
    rows = language_id(documents(spark, [(1, "a"), (1, "a"), (None, "b")]).selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang"))
    assert [(r.lang_pred, r.score) for r in rows.collect()] == [("und", 0.0)] * 3
