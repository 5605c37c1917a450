"""The driver's three functions."""

from __future__ import annotations

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_entry_recommends_twenty_unrated_stores_per_request(spark):
    best = entry.entry(spark)
    assert best.columns == ["request_id", "rank", "item_id", "name", "address", "score"]
    rows = best.collect()
    assert len(rows) == 40 * 20
    assert len({(row.request_id, row.item_id) for row in rows}) == len(rows)
    unrated = {(-row.user_id, row.item_id) for row in entry.queries()["unrated_candidates"](spark, SMALL).collect()}
    assert {(row.request_id, row.item_id) for row in rows} <= unrated


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
