"""Exact distinct counts that add up: one bitmap of ids per group, merged by or.

An id sets one bit of a bitmap of 32 768; which bitmap follows from the id, so ids should be dense (see
``ids.dense_ids``). Bitmaps of small groups are kept once, and any larger group, also one with rows that came
later, is the or of them: no rating is read again, and no id is shuffled twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def id_bitmaps(df: DataFrame, by: Sequence[str], ids: Sequence[str] = ("user_id", "item_id")) -> DataFrame:
    """``by..., kind, bucket, bits, n_rows``: the ids of each group; null ids count as rows only.

    ``kind`` is the name of the id column. Rows are counted under the kind ``rows``, which has no bits.
    """
    kinds = F.explode(F.array(*[F.struct(F.lit(name).alias("kind"), F.col(name).cast("bigint").alias("id")) for name in ids]))
    pairs = df.select(*by, kinds.alias("_own")).select(*by, "_own.kind", "_own.id").filter("id is not null")
    bits = pairs.groupBy(*by, "kind", F.bitmap_bucket_number("id").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))
    rows = df.groupBy(*by).agg(F.count("*").alias("n_rows"))
    return bits.withColumn("n_rows", F.lit(0).cast("bigint")).unionByName(rows.select(
        *by, F.lit("rows").alias("kind"), F.lit(None).cast("bigint").alias("bucket"), F.lit(None).cast("binary").alias("bits"), "n_rows"))


def merged(bitmaps: DataFrame, by: Sequence[str]) -> DataFrame:
    """The same table for larger groups, or for the union of several tables."""
    return bitmaps.groupBy(*by, "kind", "bucket").agg(
        F.bitmap_or_agg("bits").alias("bits"), F.sum("n_rows").alias("n_rows"))


def distinct_counts(bitmaps: DataFrame, by: Sequence[str], ids: Sequence[str] = ("user_id", "item_id")) -> DataFrame:
    """``by..., n_rows, n_<id>``: a group's rows and distinct ids."""
    return bitmaps.groupBy(*by).agg(F.sum("n_rows").alias("n_rows"), *[
        F.coalesce(F.sum(F.when(F.col("kind") == name, F.bitmap_count("bits"))), F.lit(0)).alias(f"n_{name}") for name in ids])
