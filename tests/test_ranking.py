"""Ranking, names, positions, ids, formatted results."""

from __future__ import annotations

from pyspark.sql import functions as F

from starpath.operators import ids, positions, ranking, skew


def test_names_go_with_their_own_scores(spark):
    top = spark.createDataFrame([(3, 0.9), (1, 0.5)], "item_id bigint, score double")
    stores = spark.createDataFrame([(1, "one", "a"), (2, "two", "b"), (3, "three", "c")],
                                   "item_id bigint, name string, address string")
    named = ranking.with_names(ranking.top_overall(top, 2), stores)
    assert sorted((r.score, r.name) for r in named.collect()) == [(0.5, "one"), (0.9, "three")]
    assert ranking.only_listed(stores, top).count() == 2


def test_top_per_user_breaks_ties_by_item(spark):
    scores = spark.createDataFrame([(1, 9, 0.5), (1, 8, 0.5), (1, 7, 0.1), (2, 7, 0.3)],
                                   "user_id bigint, item_id bigint, score double")
    top = sorted((r.user_id, r["rank"], r.item_id) for r in ranking.top_per_user(scores, 2).collect())
    assert top == [(1, 1, 8), (1, 2, 9), (2, 1, 7)]


def test_factor_scores_drop_unknown_ids(spark):
    users = spark.createDataFrame([(1, [1.0, 2.0])], "id int, features array<float>")
    items = spark.createDataFrame([(5, [3.0, 4.0])], "id int, features array<float>")
    pairs = spark.createDataFrame([(1, 5), (1, 6), (2, 5)], "user_id bigint, item_id bigint")
    assert [(r.user_id, r.item_id, r.score) for r in ranking.factor_scores(pairs, users, items).collect()] == [(1, 5, 11.0)]


def test_format_and_split(spark):
    df = spark.createDataFrame([(1, "Café", "", 1234.5)], "item_id bigint, name string, address string, score double")
    formatted = ranking.format_results(df).select("item_id", "result")
    assert formatted.first().result == "Café::::1234.50"
    pieces = sorted(map(tuple, ranking.split_results(formatted).collect()))
    assert pieces == [(1, "Caf", 0, "Café"), (1, "Caf", 2, "1234.50")]


def test_positions_follow_the_order_across_partitions(spark):
    df = spark.range(0, 5000, 1, 7).select((F.col("id") * 37 % 5000).alias("k"))
    numbered = positions.number_rows(df, ["k"])
    assert numbered.filter(F.col("position") != F.col("k") + 1).isEmpty()
    assert numbered.count() == 5000


def test_pairs_by_position_stop_at_the_shorter_side(spark):
    left = spark.createDataFrame([("b",), ("a",), ("c",)], "l string")
    right = spark.createDataFrame([(2,), (1,)], "r int")
    pairs = ranking.pair_by_position(left, right, ["l"], ["r"])
    assert sorted(map(tuple, pairs.collect())) == [(1, "a", 1), (2, "b", 2)]


def test_dense_ids_are_gapless_and_stable(spark):
    df = spark.range(3000).select(F.concat(F.lit("same-long-prefix-"), F.col("id") % 1000).alias("key"))
    first = ids.dense_ids(df, "key").collect()
    again = ids.dense_ids(df.repartition(13), "key", digits=2).collect()
    assert sorted(row.dense_id for row in first) == list(range(1, 1001))
    assert sorted(first) == sorted(again)
    mapped = ids.replace_ids(df, ids.dense_ids(df, "key"), "key")
    assert mapped.select("key").distinct().count() == 1000 and mapped.count() == 3000


def test_salted_join_equals_a_plain_join(spark):
    hot = spark.range(3000).select(F.when(F.col("id") < 1000, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("x"))
    lookup = spark.range(2900).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left"):
        salted = sorted(map(tuple, skew.salted_join(hot, lookup, "k", "x", how, parts=20).select("k", "x", "v").collect()), key=str)
        plain = sorted(map(tuple, hot.join(lookup, "k", how).select("k", "x", "v").collect()), key=str)
        assert salted == plain


def test_salted_join_cuts_the_hot_key(spark):
    hot = spark.range(3000).select(F.when(F.col("id") < 1000, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("x"))
    counts = hot.groupBy("k").count()
    joined = skew.salted_join(hot, counts, "k", "x", parts=100)
    assert joined.filter("k = 1").count() == 1000
    assert joined.count() == 3000
