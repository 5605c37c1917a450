"""Item similarity from common raters, exact also where a few users rated almost everything.

Cosine over whole rating vectors, for item pairs with at least ``min_support`` common users.

The direct way joins ratings with themselves by user, which costs the square of a user's ratings, and sums far more
pairs than qualify. Two bounds keep pairs from being made:

1. Signatures. Each item has the set of its raters' places, hashed to ``PLACES``. Items cannot have more common
   users than common places, plus the users that the item with fewer clashes loses to clashes. A pair
   below ``min_support`` by this bound never leaves the task that sees a common user.
2. Prefixes, for users with more than ``heavy`` ratings. Order users from the most to the least active and leave
   out the first ``min_support - 1`` heavy raters of each item. Two items with ``min_support`` common users
   still share a user that neither left out: of their common users take the least active; at least
   ``min_support - 1`` others come before it in both items. The few ratings left out are then added for the pairs
   found: from the two items' lists where both left the user out, else by a lookup of (user, item).

Users left in after that are cut into blocks of ``heavy`` ratings, so no task sees more than one
block against another. All tables go this one way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from starpath.operators.skew import salted_join
from starpath.session import set_down, together

#: Places of a signature; a multiple of 64. It sets how many pairs are ruled out and changes no result.
PLACES = 4096
#: Bytes of signatures and ratings, about, that meet in a round.
ROUND_BYTES = 2 << 30
#: Members whose signatures are held at once, and comparisons made at once.
_MEMBERS, _AT_ONCE = 8192, 4096


def rating_cells(ratings: DataFrame) -> DataFrame:
    """One row per (user, item): the mean of its ratings."""
    return ratings.groupBy("user_id", "item_id").agg(F.avg("rating").alias("rating"))


def similar_items(ratings: DataFrame, size: int = 10, min_support: int = 3, heavy: int = 1000,
                  digits: int | None = None) -> DataFrame:
    """``(item_id, rank, similar_id, similarity, support)``: each item's ``size`` nearest items.

    With ``digits`` similarities are rounded before they are ranked, so that items which are equally
    near but for the order of additions are ranked by id.
    """
    pairs = item_pairs(ratings, min_support, heavy)
    if digits is not None:
        pairs = pairs.withColumn("similarity", F.round("similarity", digits))
    ends = F.array(
        F.struct(F.col("item_a").alias("item_id"), F.col("item_b").alias("similar_id")),
        F.struct(F.col("item_b").alias("item_id"), F.col("item_a").alias("similar_id")),
    )
    both = pairs.select(F.explode(ends).alias("_ends"), "similarity", "support").select(
        "_ends.item_id", "_ends.similar_id", "similarity", "support")
    order = W.partitionBy("item_id").orderBy(F.desc("similarity"), "similar_id")
    return both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size)


def item_pairs(ratings: DataFrame, min_support: int = 3, heavy: int = 1000) -> DataFrame:
    """``(item_a, item_b, similarity, support)`` for every pair with ``min_support`` common users, ``item_a < item_b``."""
    rated = set_down(rating_cells(ratings), "rated")
    items = set_down(_signatures(rated, min_support), "items")
    cells = set_down(_weights(rated, items), "cells")
    activity = cells.groupBy("user_id").agg(F.count("*").alias("activity"))
    ranked = salted_join(cells, activity.filter(F.col("activity") > heavy), "user_id", "item_id", "left")
    first = W.partitionBy("item_id").orderBy(F.desc("activity"), "user_id")
    left_out = set_down(
        ranked.filter("activity is not null")
        .withColumn("_place", F.row_number().over(first))
        .filter(F.col("_place") <= min_support - 1)
        .select("user_id", "item_id", "weight"), "out"
    )
    left_in = ranked.join(left_out.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti").withColumn(
        "_blocks", F.coalesce(F.ceil(F.col("activity") / heavy).cast("int"), F.lit(1)))
    found = _found(left_in, items, min_support)
    return _with_left_out(found, left_out, cells, min_support).filter(
        F.col("support") >= min_support).withColumnRenamed("dot", "similarity")


def _signatures(cells: DataFrame, min_support: int) -> DataFrame:
    """Each item's length and signature; items with too few raters cannot qualify."""
    return (
        cells.groupBy("item_id")
        .agg(F.sqrt(F.sum(F.col("rating") * F.col("rating"))).alias("_length"), F.count("*").alias("raters"),
             F.collect_set(F.pmod(F.xxhash64("user_id"), F.lit(PLACES)).cast("short")).alias("places"))
        .filter((F.col("raters") >= min_support) & (F.col("_length") > 0))
    )


def _unit_cells(cells: DataFrame, min_support: int) -> DataFrame:
    """Ratings scaled so that each item's vector has length 1, with its signature."""
    items = _signatures(cells, min_support)
    return _signed(_weights(cells, items), items)


def _weights(cells: DataFrame, items: DataFrame) -> DataFrame:
    """Ratings scaled so that each item's vector has length 1."""
    return salted_join(cells, items.select("item_id", "_length"), "item_id", "user_id").select(
        "user_id", "item_id", (F.col("rating") / F.col("_length")).alias("weight"))


def _signed(cells: DataFrame, items: DataFrame) -> DataFrame:
    """Each rating with its item's signature."""
    return salted_join(cells, items.select("item_id", "places", (F.col("raters") - F.size("places")).alias("clashes")), "item_id", "user_id")


def _found(left_in: DataFrame, items: DataFrame, min_support: int) -> DataFrame:
    """The pairs' sums over common users. Each rating meets its item's signature, which is longer than the rating, so
    where they would take more than ``ROUND_BYTES`` users go in rounds, and a round's leave the disk before the next."""
    size = items.agg(F.sum(F.col("raters") * (2 * F.size("places") + 64))).first()[0] or 0
    rounds = max(1, -(-size // ROUND_BYTES))
    if rounds == 1:
        return set_down(_common(_signed(set_down(left_in, "in"), items), min_support), "found")
    place = F.pmod(F.xxhash64("user_id"), F.lit(rounds)).cast("int")
    dealt = set_down(left_in.withColumn("round", place).repartition("round", F.pmod(F.xxhash64("item_id"), F.lit(8))), "rounds", by=("round",))
    parts = [set_down(_common(_signed(dealt.filter(F.col("round") == k).drop("round"), items), min_support), "part") for k in range(rounds)]
    return set_down(together(parts).groupBy("item_a", "item_b").agg(
        F.sum("dot").alias("dot"), F.sum("support").alias("support")), "found")


def _common(cells: DataFrame, min_support: int) -> DataFrame:
    """Sums over common users of the pairs that can have ``min_support`` of them, block against block.

    A pair of items meets in exactly one pair of blocks per user.
    """
    part = F.pmod(F.xxhash64("item_id"), F.col("_blocks")).cast("int")
    dealt = cells.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    member = F.struct(F.col("item_id").cast("bigint").alias("item_id"), "weight", "clashes", "part", "places")
    lists = dealt.groupBy("user_id", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j")).agg(
        F.array_sort(F.collect_list(member)).alias("members")).select((F.col("i") != F.col("j")).alias("across"), "members")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = batch.column(1).offsets.to_numpy().astype(np.int64)
            across = batch.column(0).to_numpy(zero_copy_only=False)
            at = 0
            while at < batch.num_rows:
                last = max(at + 1, int(np.searchsorted(ends, ends[at] + _MEMBERS, "right")) - 1)
                yield _pairs(batch.column(1).slice(at, last - at), across[at:last], min_support)
                at = last

    return lists.mapInArrow(meet, "item_a long, item_b long, dot double").groupBy("item_a", "item_b").agg(
        F.sum("dot").alias("dot"), F.count("*").alias("support"))


def _pairs(lists: pa.ListArray, across: np.ndarray, min_support: int) -> pa.RecordBatch:
    """The pairs of members of each list whose signatures allow ``min_support`` common users."""
    members = lists.flatten()
    ends = lists.offsets.to_numpy().astype(np.int64)
    ends = ends - ends[0]
    items, weights, clashes, parts = (members.field(k).to_numpy() for k in ("item_id", "weight", "clashes", "part"))
    places = members.field("places")
    held = places.flatten().to_numpy().astype(np.int64)
    rows = np.repeat(np.arange(len(members)), np.diff(places.offsets.to_numpy()))
    signatures = np.zeros((len(members), PLACES // 64), np.uint64)
    np.bitwise_or.at(signatures, (rows, held >> 6), np.uint64(1) << (held & 63).astype(np.uint64))
    left, right = [], []
    for start, end, mixed in zip(ends, ends[1:], across):
        step = max(1, _AT_ONCE // max(1, end - start))
        for x in range(start, end, step):
            own = slice(x, min(end, x + step))
            rest = slice(x, end)
            common = np.bitwise_count(signatures[own, None] & signatures[None, rest]).sum(2, dtype=np.int64)
            near = common + np.minimum(clashes[own, None], clashes[None, rest]) >= min_support
            # members are in order of their item, so each pair once
            near &= np.arange(own.start, own.stop)[:, None] < np.arange(x, end)[None]
            if mixed:
                near &= parts[own, None] != parts[None, rest]
            a, b = np.nonzero(near)
            left.append(a + x)
            right.append(b + x)
    a, b = (np.concatenate(side) if side else np.zeros(0, np.int64) for side in (left, right))
    return pa.RecordBatch.from_arrays(
        [pa.array(items[a]), pa.array(items[b]), pa.array(weights[a] * weights[b])], names=["item_a", "item_b", "dot"])


def _with_left_out(found: DataFrame, left_out: DataFrame, cells: DataFrame, min_support: int) -> DataFrame:
    """Adds the users that one or both items of a pair left out to the pair's sums.

    A user left out by both items is settled between their two lists. Only for a user left out by
    one item the other item's rating has to be looked up, and only where the pair can still qualify.
    """
    # At most min_support - 1 entries per item.
    lists = left_out.groupBy("item_id").agg(
        F.map_from_entries(F.collect_list(F.struct("user_id", "weight"))).alias("_out"))
    first = lists.select(F.col("item_id").alias("item_a"), F.col("_out").alias("_out_a"))
    second = lists.select(F.col("item_id").alias("item_b"), F.col("_out").alias("_out_b"))
    listed = salted_join(set_down(salted_join(found, first, "item_a", "item_b", "left")), second, "item_b", "item_a", "left")
    none = F.create_map().cast("map<bigint,double>")
    a, b = F.coalesce("_out_a", none), F.coalesce("_out_b", none)
    users_a, users_b = F.map_keys(a), F.map_keys(b)
    settled = listed.select(
        "item_a", "item_b", "dot", "support", a.alias("_out_a"), b.alias("_out_b"),
        F.array_intersect(users_a, users_b).alias("_both"),
        F.array_except(users_a, users_b).alias("_only_a"),
        F.array_except(users_b, users_a).alias("_only_b"),
    ).filter(
        F.col("support") + F.size("_both") + F.size("_only_a") + F.size("_only_b") >= min_support
    ).select(
        "item_a", "item_b", "_out_a", "_out_b", "_only_a", "_only_b",
        F.aggregate("_both", F.col("dot"), lambda total, user: total
                    + F.element_at("_out_a", user) * F.element_at("_out_b", user)).alias("dot"),
        (F.col("support") + F.size("_both")).alias("support"),
    )
    settled = set_down(settled)
    asked = F.concat(
        F.transform("_only_a", lambda user: F.struct(
            user.alias("user_id"), F.element_at("_out_a", user).alias("other"), F.col("item_b").alias("item_id"))),
        F.transform("_only_b", lambda user: F.struct(
            user.alias("user_id"), F.element_at("_out_b", user).alias("other"), F.col("item_a").alias("item_id"))))
    questions = settled.select("item_a", "item_b", F.explode(asked).alias("_ask")).select(
        "item_a", "item_b", "_ask.user_id", "_ask.item_id", F.col("_ask.other").alias("_other"))
    answers = questions.join(cells, ["user_id", "item_id"]).select(
        "item_a", "item_b", (F.col("_other") * F.col("weight")).alias("dot"), F.lit(1).cast("bigint").alias("support"))
    return settled.select("item_a", "item_b", "dot", "support").unionByName(answers).groupBy("item_a", "item_b").agg(
        F.sum("dot").alias("dot"), F.sum("support").alias("support"))
