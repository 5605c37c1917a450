"""Frequent keys against full counts, and joins on them."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from starpath.operators import skew


@pytest.mark.parametrize("parts, kind", [(5, "bigint"), (20, "bigint"), (5, "string"), (1, "bigint")])
def test_every_frequent_key_is_found(spark, parts, kind):
    """Few counters for many keys, in small batches, from several tasks."""
    draw = random.Random(parts)
    keys = [draw.choice([1, 1, 2, draw.randrange(10), draw.randrange(5000), None]) for _ in range(8000)]
    df = spark.createDataFrame([(None if k is None else k if kind == "bigint" else f"k{k}",) for k in keys], f"key {kind}").repartition(3)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    try:
        spark.conf.set(size, 100)
        found, total = skew.frequent_keys(df, "key", parts)
        got = {r.key: r.n for r in found.collect()}
    finally:
        spark.conf.set(size, before)
    true = Counter(r.key for r in df.collect() if r.key is not None)
    assert total == len(keys)
    assert {k for k, n in true.items() if n * parts > total} <= set(got)
    assert all(true[k] <= n <= true[k] + total / (skew.COUNTERS * parts) for k, n in got.items())
    assert len(got) < skew.COUNTERS / (skew.COUNTERS - 1) * parts + 1


def test_no_rows(spark):
    found, total = skew.frequent_keys(spark.createDataFrame([], "key bigint"), "key")
    assert (found.collect(), total) == ([], 0)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_a_plain_join(spark, how):
    draw = random.Random(1)
    facts = spark.createDataFrame([(draw.choice([0, 0, 0, draw.randrange(40), None]), n) for n in range(3000)], "key bigint, n bigint")
    lookup = spark.range(0, 40, 2).select(F.col("id").alias("key"), (F.col("id") * 3).alias("value"))
    got = skew.salted_join(facts, lookup, "key", "n", how, parts=10)
    assert sorted(map(str, got.collect())) == sorted(map(str, facts.join(lookup, "key", how).collect()))
