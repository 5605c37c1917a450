from __future__ import annotations

import hashlib

from starpath.llm.exact_dedup import exact_dedup
from tests.llm.helpers import ODD, documents, prose


def lower(text):
    return (text or "").encode().lower()


def expected(rows):
    rows = list(rows)
    groups = {}
    for key, text in rows:
        groups.setdefault(lower(text), []).append(key)
    return sorted((key, max(groups[lower(t)]), len(groups[lower(t)]), key == max(groups[lower(t)]),
                   hashlib.sha256(lower(t)).hexdigest()) for key, t in rows)


def found(frame):
    return sorted(tuple(r)[:5] for r in frame.collect())


def test_odd_texts_and_clashing_columns(spark):
    assert found(exact_dedup(documents(spark, ODD, extra=True))) == expected(enumerate(ODD))


def test_rounds_and_false_alarms_change_nothing(spark):
    texts = [prose(k % 150, 8) for k in range(400)] + ["hot"] * 200
    frame = exact_dedup(documents(spark, texts), max_cells=4096)
    assert found(frame) == expected(enumerate(texts))


def test_most_unique_rows_are_not_shuffled(spark):
    texts = [f"text {k}" for k in range(1000)] + ["same", "Same"]
    rows = exact_dedup(documents(spark, texts)).collect()
    assert all(r.shuffled for r in rows if r.group_size > 1)
    assert sum(r.shuffled for r in rows) < 30


def test_repeated_ids_and_empty_table(spark):
    rows = [(1, "a"), (1, "a"), (2, "b"), (None, "b")]
    got = exact_dedup(documents(spark, rows)).select("doc_id", "keep_id", "group_size", "kept").collect()
    assert sorted(map(tuple, got), key=str) == sorted(
        [(1, 1, 2, True), (1, 1, 2, True), (2, 2, 2, True), (None, 2, 2, False)], key=str)
    assert exact_dedup(documents(spark, [])).count() == 0
