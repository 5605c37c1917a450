"""The cap as state over a stream against the cap in batch."""

from __future__ import annotations

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from starpath.operators.ratings import cap_per_user
from starpath.streaming import caps
from starpath.streaming.requests import request_files

SCHEMA = "user_id bigint, item_id bigint, rating double, rated_at string"


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(12)
    out = [(draw.choice([1, draw.randrange(30)]), draw.randrange(9), float(draw.randrange(1, 6)), f"2024-0{draw.randrange(1, 9)}-01")
           for _ in range(600)]
    return out + out[:40] + [(None, 1, 1.0, "2024-01-01"), (5, None, 1.0, "2000-01-01"), (5, 1, None, "2000-01-01"), (5, 1, 1.0, None)]


def listed(frame):
    return sorted((r.user_id, r.position, r.item_id, r.rating, r.rated_at) for r in frame.collect())


def run(spark, parts, folder, cap=11, idle=None):
    """Each part is a file and a batch."""
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = request_files(spark, f"{folder}/in", spark.createDataFrame([], SCHEMA).schema, files_per_batch=1)
        caps.write_first_ratings(stream, f"{folder}/out", f"{folder}/progress", cap, idle).awaitTermination()
    return listed(caps.current_lists(spark, f"{folder}/out"))


@pytest.mark.parametrize("cuts, cap", [([], 11), ([1, 17, 300], 11), ([250], 2)])
def test_stream_equals_batch_for_any_cut(spark, rows, tmp_path, cuts, cap):
    ends = [0, *cuts, len(rows)]
    got = run(spark, [rows[a:b] for a, b in zip(ends, ends[1:])], tmp_path, cap)
    whole = spark.createDataFrame(rows, SCHEMA).dropna()
    assert got == listed(cap_per_user(whole, [F.col("rated_at"), F.col("item_id"), F.col("rating")], cap))
    assert max(position for _, position, *_ in got) == cap


def test_an_idle_user_is_forgotten(spark, tmp_path):
    parts = [[(1, 1, 1.0, "2024-01-01"), (2, 1, 1.0, "2024-01-01")], [(2, 2, 1.0, "2024-01-02")], [(1, 3, 1.0, "2024-01-03")]]
    got = run(spark, parts, tmp_path / "short", idle=timedelta(milliseconds=1))
    # the second batch brings user 1 nothing, and user 2 a rating that keeps its list
    assert [r[:3] for r in got] == [(1, 1, 3), (2, 1, 1), (2, 2, 2)]
    got = run(spark, parts, tmp_path / "long", idle=timedelta(days=1))
    assert [r[:3] for r in got] == [(1, 1, 1), (1, 2, 3), (2, 1, 1), (2, 2, 2)]


def test_users_are_taken_in_groups(spark, tmp_path, monkeypatch):
    """The processor is called once per group and batch, however many users a group has, and gives only changed lists."""
    monkeypatch.setattr(caps, "GROUPS", 2)
    users = range(300)
    parts = [[(user, 5, 1.0, "2024-02-01") for user in users], [(user, 4 if user % 3 else 9, 1.0, "2024-03-01") for user in users],
             [(7, 1, 1.0, "2024-01-01")]]
    got = run(spark, parts, tmp_path, cap=2)
    expected = {user: [5, 4 if user % 3 else 9] for user in users} | {7: [1, 5]}
    assert [(u, p, i) for u, p, i, *_ in got] == [(u, p, i) for u in users for p, i in enumerate(expected[u], 1)]
    written = spark.read.parquet(f"{tmp_path}/out").groupBy("batch_id").agg(F.count_distinct("user_id").alias("n"))
    assert {r.batch_id: r.n for r in written.collect()} == {0: 300, 1: 300, 2: 1}
    state = [r for r in spark.read.format("statestore").option("path", f"{tmp_path}/progress").option(
        "stateVarName", "ratings").load().collect()]
    assert len(state) == 2
