"""Load text lines into tables: packed top-store lines, and ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starpath.functions.ratings import season_of
from starpath.operators.ratings import parse_ratings, with_timestamp
from starpath.operators.rejects import accepted, rejected
from starpath.operators.toplists import as_store_table, parse_top_lines
from starpath.session import cut_lineage
from starpath.sources.jdbc import write_jdbc
from starpath.sources.lines import read_lines
from starpath.sources.tables import write_slices, write_table


def load_top_stores(spark: SparkSession, source: str, target: str, rejects: str | None = None,
                    driver: str | None = None, url: str | None = None, strict_compat: bool = False) -> DataFrame:
    """Text lines to the store table; Parquet folder ``target``, or database table ``target`` when ``url`` is given."""
    parsed = parse_top_lines(read_lines(spark, source), strict_compat)
    stores = as_store_table(parsed)
    if url is not None:
        if driver is None:
            raise ValueError("a database target needs a driver class")
        write_jdbc(stores, url, target, driver)
    else:
        write_table(stores, target)
    if rejects is not None:
        write_table(rejected(parsed), rejects)
    return stores


def load_ratings(spark: SparkSession, source: str, users: DataFrame, target: str, rejects: str | None = None) -> None:
    """``user::item::rating::date`` lines to a table laid out by season and state.

    ``users`` gives each ``user_id`` its ``state``; ratings of other users and ratings whose date
    cannot be read go to ``rejects`` with the lines that are no ratings. A user listed more than once
    has the first of its states by name. The text is read, and users are joined, once.
    """
    parsed = with_timestamp(parse_ratings(read_lines(spark, source))).withColumn("season", season_of(F.col("rated_ts")))
    dated = cut_lineage(parsed.withColumn("reject_reason", F.coalesce(
        "reject_reason", F.when(F.col("season").isNull(), F.lit("bad_date")))))
    homes = users.groupBy("user_id").agg(F.min("state").alias("state"))
    # Lines without a user id stay out of the join, where they would all share the null key.
    placed = cut_lineage(accepted(dated).join(homes, "user_id", "left").withColumn(
        "reject_reason", F.when(F.col("state").isNull(), F.lit("unknown_user"))))
    columns = ["user_id", "item_id", "rating", "rated_at", "bucket", "season", "state"]
    write_slices(accepted(placed).select(*columns), target)
    if rejects is not None:
        kept = ["value", "reject_reason"]
        write_table(rejected(dated).select(*kept).unionByName(rejected(placed).select(*kept)), rejects)
