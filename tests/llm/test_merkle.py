from __future__ import annotations

from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from starpath.llm import queries
from starpath.llm.merkle import fold, leaf_of, merkle_manifest, siblings
from tests.llm.helpers import ODD, SCHEMA, documents


def h(text):
    return sha256(text.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], row[1])))


def tree(nodes, fanout):
    """The root, and per leaf the siblings left and right of each node on its way."""
    ways = [[] for _ in nodes]
    under = [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        above, joined = [], []
        for at in range(0, len(nodes), fanout):
            run = nodes[at:at + fanout]
            for k in range(len(run)):
                for leaf_place in under[at + k]:
                    ways[leaf_place].append(("".join(run[:k]), "".join(run[k + 1:])))
            above.append(h("".join(run)))
            joined.append(sum(under[at:at + fanout], []))
        nodes, under = above, joined
    return nodes[0], ways


def brute(rows, fanout):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf(row)))
    langs = sorted(groups, key=lambda lang: (lang is not None, (lang or "").encode()))
    parts = {lang: tree([x[2] for x in sorted(groups[lang])], fanout) for lang in langs}
    root, upper = tree([parts[lang][0] for lang in langs], fanout)
    out = []
    for lang, above in zip(langs, upper):
        for place, ((known, key, own), way) in enumerate(zip(sorted(groups[lang]), parts[lang][1])):
            out.append((key if known else None, lang, place, own, parts[lang][0], root, tuple(way + above)))
    return sorted(out, key=str)


def found(frame):
    return sorted([(r.doc_id, r.lang, r.place, r.leaf, r.subroot, r.root, tuple((s.left, s.right) for s in r.proof))
                   for r in frame.collect()], key=str)


def made(langs):
    rows = [(k * 7 % 1009, text, lang, None if k % 5 == 0 else f"s{k % 3}", None if k % 4 == 0 else k)
            for k, (text, lang) in enumerate(langs)]
    return rows + [(None, "a", "en", "s", 1), (None, None, None, None, None), (3, "same", "en", "s", 1), (3, "same", "en", "s", 1)]


@pytest.mark.parametrize("fanout, depth", [(2, 1), (2, 3), (3, 1), (2, 12)])
def test_against_whole_trees(spark, fanout, depth):
    """Uneven trees from one leaf to many blocks, with null, empty and odd languages, texts and ids."""
    texts = (ODD * 6)[:77]
    rows = made([(text, "en" if k < 41 else (None, "", "fr", "é", "-", "0:")[k % 6]) for k, text in enumerate(texts)])
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS tree", "1 AS block", "2 AS place", "3 AS node", "4 AS also")
    assert found(merkle_manifest(docs, fanout=fanout, depth=depth)) == brute(rows, fanout)


def test_one_language_and_one_row(spark):
    for count in (1, 2, 9):
        rows = [(k, str(k), "en", "s", k) for k in range(count)]
        assert found(merkle_manifest(spark.createDataFrame(rows, SCHEMA), depth=1)) == brute(rows, 2)


def test_every_row_a_language_of_its_own(spark):
    rows = [(k, "t", f"l{k}", "s", k) for k in range(21)]
    assert found(merkle_manifest(spark.createDataFrame(rows, SCHEMA), depth=1)) == brute(rows, 2)


def test_empty(spark):
    assert merkle_manifest(documents(spark, [])).collect() == []


def test_proofs_fold_and_tampering_shows(spark):
    docs = documents(spark, [f"text {k}" for k in range(50)])
    changed = leaf_of(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars") + 1, F.col("text"))
    rows = merkle_manifest(docs, also=F.when(F.col("doc_id") % 10 == 0, changed), depth=2)
    ok = rows.select("doc_id", (fold(F.coalesce("also", "leaf"), F.col("proof")) == F.col("root")).alias("ok"),
                     siblings(F.col("proof")).alias("text"))
    got = ok.collect()
    assert {r.doc_id for r in got if not r.ok} == {0, 10, 20, 30, 40}
    assert all(len(r.text) % 64 == 0 for r in got)


def test_query_does_not_depend_on_partitions(spark, tmp_path):
    rows = made([(str(k), "en") for k in range(60)])
    results = []
    for parts in (1, 7):
        spark.createDataFrame(rows, SCHEMA).repartition(parts).write.parquet(f"{tmp_path}/{parts}/documents.parquet")
        results.append(sorted(queries.op11_merkle_manifest(spark, f"{tmp_path}/{parts}").collect(), key=str))
    assert results[0] == results[1]
    assert {r.verified for r in results[0]} == {True, False}
    assert all(r.verified for r in results[0] if r.doc_id is None)
