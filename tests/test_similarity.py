"""Item similarity against brute force, with and without users that rated almost everything."""

from __future__ import annotations

import math
import random
from collections import defaultdict
from itertools import combinations

import pytest

from pyspark.sql import functions as F

from starpath.operators import similarity
from starpath.operators.similarity import item_pairs, similar_items

SCHEMA = "user_id bigint, item_id bigint, rating double"


def brute_force(rows, min_support):
    cells = defaultdict(list)
    for user, item, rating in rows:
        cells[user, item].append(rating)
    vectors = defaultdict(dict)
    for (user, item), values in cells.items():
        vectors[item][user] = sum(values) / len(values)
    lengths = {item: math.sqrt(sum(v * v for v in vector.values())) for item, vector in vectors.items()}
    found = {}
    for a, b in combinations(sorted(vectors), 2):
        common = vectors[a].keys() & vectors[b].keys()
        if len(common) >= min_support:
            dot = sum(vectors[a][u] * vectors[b][u] for u in common)
            found[a, b] = (dot / (lengths[a] * lengths[b]), len(common))
    return found


def sample(hot_users, items=40, users=60, seed=7):
    """Ratings where each hot user rated nearly all items and holds far more rows than anyone else."""
    rng = random.Random(seed)
    rows = [(user, rng.randrange(items), float(rng.randint(1, 5))) for user in range(users) for _ in range(6)]
    for hot in range(hot_users):
        rows += [(1000 + hot, item, float(rng.randint(1, 5))) for item in range(items) if rng.random() < 0.9]
    return rows


@pytest.mark.parametrize("hot_users,min_support", [(0, 3), (1, 1), (1, 2), (2, 3), (3, 2), (5, 3)])
def test_pairs_equal_brute_force(spark, hot_users, min_support):
    rows = sample(hot_users)
    pairs = item_pairs(spark.createDataFrame(rows, SCHEMA), min_support, heavy=8)
    got = {(row.item_a, row.item_b): (row.similarity, row.support) for row in pairs.collect()}
    expected = brute_force(rows, min_support)
    assert got.keys() == expected.keys()
    for pair, (similarity, support) in expected.items():
        assert got[pair][1] == support
        assert got[pair][0] == pytest.approx(similarity, abs=1e-9)


def test_heavy_limit_does_not_change_the_result(spark):
    ratings = spark.createDataFrame(sample(3), SCHEMA)
    results = [sorted(map(tuple, similar_items(ratings, 5, 2, heavy, digits=6).collect())) for heavy in (3, 10, 10_000)]
    assert results[0] == results[1] == results[2]


def test_lists_are_symmetric_ranked_and_without_the_item_itself(spark):
    found = similar_items(spark.createDataFrame(sample(1), SCHEMA), size=1000, min_support=2, heavy=10).collect()
    values = {(row.item_id, row.similar_id): row.similarity for row in found}
    assert all(values[b, a] == value for (a, b), value in values.items())
    assert all(a != b for a, b in values)
    ranks = defaultdict(list)
    for row in found:
        ranks[row.item_id].append(row["rank"])
    assert all(sorted(values) == list(range(1, len(values) + 1)) for values in ranks.values())


def test_equal_vectors_have_similarity_one(spark):
    rows = [(user, item, float(user + 1)) for user in range(3) for item in (1, 2)]
    assert item_pairs(spark.createDataFrame(rows, SCHEMA)).first().similarity == pytest.approx(1.0)


def test_pairs_that_cannot_qualify_are_not_made(spark):
    rng = random.Random(2)
    rows = [(user, item, 3.0) for user in range(300) for item in rng.sample(range(600), 20)]
    cells = similarity.rating_cells(spark.createDataFrame(rows, SCHEMA))
    met = similarity._common(similarity._unit_cells(cells, 3).withColumn("_blocks", F.lit(1)), 3)
    every = 300 * 20 * 19 // 2
    made = met.agg(F.sum("support")).first()[0]
    assert made < every / 4
    assert {(r.item_a, r.item_b) for r in met.filter("support >= 3").collect()} == set(brute_force(rows, 3))


def test_signatures_meet_ratings_in_rounds(spark, monkeypatch):
    """No table keeps a signature per rating, and rounds of users find the same pairs."""
    draw = random.Random(9)
    rows = [(draw.randrange(60), draw.randrange(40), float(draw.randrange(1, 6))) for _ in range(900)] + [(1, i, 3.0) for i in range(40)]
    ratings = spark.createDataFrame(rows, "user_id bigint, item_id bigint, rating double")

    def pairs():
        return {(r.item_a, r.item_b): (round(r.similarity, 9), r.support) for r in similarity.item_pairs(ratings, 3, 20).collect()}

    whole, kept = pairs(), []
    down = similarity.set_down
    monkeypatch.setattr(similarity, "ROUND_BYTES", 20_000)
    monkeypatch.setattr(similarity, "set_down", lambda df, *a, **k: (kept.append(df.columns), down(df, *a, **k))[1])
    assert pairs() == whole
    assert sum("item_a" in columns for columns in kept) > 4
    assert not [columns for columns in kept if "places" in columns and "user_id" in columns]
