from __future__ import annotations

from collections import defaultdict

from starpath.llm.sharding import shard
from tests.llm.helpers import ODD, documents, prose


def check(rows, count, texts, slack):
    assert len(rows) == len(texts)
    sizes, slots, shards_of = [0] * count, defaultdict(list), defaultdict(set)
    for row in rows:
        assert row["size"] == len((row.text or "").encode()) + 1
        sizes[row["shard"]] += row["size"]
        slots[row["shard"]].append(row.slot)
        shards_of[row.text].add(row["shard"])
    for found in slots.values():
        assert sorted(found) == list(range(len(found)))
    assert max(sizes) - min(sizes) <= slack
    return shards_of


def test_near_equal_bytes_and_whole_groups(spark):
    texts = [prose(k % 300, 20 + k % 300 % 50) for k in range(900)]
    rows = shard(documents(spark, texts)).collect()
    largest = 3 * max(map(len, texts))
    shards_of = check(rows, 8, texts, 2 * largest)
    assert sum(len(s) > 1 for s in shards_of.values()) <= 7


def test_a_hot_group_is_cut(spark):
    texts = ["the same text again"] * 400 + [prose(k, 10) for k in range(200)]
    check(shard(documents(spark, texts), shards=4).collect(), 4, texts, 300)


def test_odd_texts(spark):
    rows = shard(documents(spark, ODD + ODD, extra=True)).collect()
    check(rows, 8, ODD + ODD, 10**6)
    assert shard(documents(spark, [])).count() == 0
    same = shard(documents(spark, [(1, "a")] * 9)).collect()
    check(same, 8, ["a"] * 9, 10**6)
