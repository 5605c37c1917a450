"""The recommendation inputs as views over the test tables.

Nothing here takes a part of a table: every order line is a rating, every part is a store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starpath.functions.ratings import bucket_digit, season_of
from starpath.operators.places import with_place
from starpath.operators.toplists import top_items
from starpath.schemas import SEASONS
from starpath.sources.tables import read_table

def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_table(spark, f"{folder}/{name}.parquet")


def star(quantity: str) -> F.Column:
    return (1 + F.floor((F.col(quantity) - 1) / 10)).cast("double")


def _order_lines(spark: SparkSession, folder: str, orders: DataFrame) -> DataFrame:
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", star("l_quantity").alias("rating"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def ratings(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as ratings: the customer rates the part; there is no row key."""
    date = F.date_format("o_orderdate", "yyyy-MM-dd")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", date.alias("rated_at"))
    return _order_lines(spark, folder, orders).select(
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("item_id"),
        "rating",
        "rated_at",
        bucket_digit(F.col("rated_at")).alias("bucket"),
    )


def _placed_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with their season and their customer's place.

    Customers get their place first and orders meet customers before order lines, so a filter on city,
    state or season reaches the shorter tables and the lines, the longest one, are shuffled once.
    """
    customers = with_place(table(spark, folder, "customer").select("c_custkey", "c_nationkey"), "c_nationkey")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", season_of(F.col("o_orderdate")).alias("season"))
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", "o_custkey", "season", "state_index", "state", "city")


def sliced_ratings(spark: SparkSession, folder: str) -> DataFrame:
    """Ratings with the season of the order and the state and city of the customer."""
    lines = _order_lines(spark, folder, _placed_orders(spark, folder))
    return lines.select(
        F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"), "rating",
        "season", "state_index", "state", "city")


def users(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with the state of their nation."""
    return with_place(table(spark, folder, "customer").select("c_custkey", "c_nationkey"), "c_nationkey").select(
        F.col("c_custkey").alias("user_id"), "state")


def stores(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("item_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("address"))


def store_lines(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    return part.select(F.concat_ws(
        "::", F.col("p_partkey").cast("string"), "p_name", "p_type", F.col("p_size").cast("string"), "p_brand",
    ).alias("value"))


def top_stores(spark: SparkSession, folder: str, size: int = 50) -> DataFrame:
    """The most rated stores of each state and season, with names."""
    top = top_items(sliced_ratings(spark, folder), size, ("state_index", "state", "city", "season"))
    # At most ten states x four seasons x size rows, whatever the data.
    return stores(spark, folder).join(F.broadcast(top), "item_id")


def slice_requests(spark: SparkSession, folder: str) -> DataFrame:
    """One request per state and season: its ten most rated stores, each with its rounded mean as stars."""
    top = top_stores(spark, folder, 10)
    season_index = F.array_position(F.array(*[F.lit(name) for name in SEASONS]), F.col("season"))
    stars = F.floor(F.col("mean_rating") + 0.5).cast("string")
    pair = F.struct("rank", F.concat_ws("=", F.col("item_id").cast("string"), stars).alias("pair"))
    grouped = top.groupBy(
        (F.col("state_index") * len(SEASONS) + season_index).cast("bigint").alias("request_id"), "season", "city",
    ).agg(F.array_sort(F.collect_list(pair)).alias("pairs"))
    return grouped.select("request_id", request_url(F.col("season"), F.col("city"),
                                                    F.array_join(F.col("pairs.pair"), "&")).alias("url"))


def request_url(season: F.Column, city: F.Column, pairs: F.Column) -> F.Column:
    return F.concat(F.lit("/recommend/result?season="), season, F.lit("&city="),
                    F.replace(city, F.lit(" "), F.lit("+")), F.lit("&"), pairs)


def line_requests(spark: SparkSession, folder: str) -> DataFrame:
    """One request per order line: its part with the quantity's stars, its supplier with the line number as stars.

    Line numbers run to 7, so some of these stars are out of range.
    """
    lines = table(spark, folder, "lineitem").join(
        _placed_orders(spark, folder), F.col("l_orderkey") == F.col("o_orderkey"))
    pairs = F.concat(
        F.col("l_partkey").cast("string"), F.lit("="), star("l_quantity").cast("int").cast("string"), F.lit("&"),
        F.col("l_suppkey").cast("string"), F.lit("="), F.col("l_linenumber").cast("string"))
    return lines.select(
        (F.col("o_orderkey") + 1).alias("request_id"), request_url(F.col("season"), F.col("city"), pairs).alias("url"))


def typed_stars(spark: SparkSession, folder: str) -> DataFrame:
    """Event values as ratings typed by people: whole for clicks and views, a tenth for sign-ups, else with decimals."""
    value = F.col("value")
    whole = F.floor(value).cast("string")
    raw = (
        F.when(F.col("event_type").isin("click", "view"), whole)
        .when(F.col("event_type") == "signup", F.floor(value / 10).cast("string"))
        .otherwise(F.format_string("%.2f", value))
    )
    return table(spark, folder, "events").select("event_id", "user_id", raw.alias("raw"))


def factors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("features"))


def item_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings as item factors of one slice, as long as the item's mean rating."""
    means = ratings(spark, folder).groupBy("item_id").agg(F.avg("rating").alias("mean"))
    vectors = factors(spark, folder).withColumnRenamed("id", "item_id").join(means, "item_id")
    return vectors.select(F.lit("").alias("slice"), "item_id", F.transform(
        "features", lambda x: x.cast("double") * F.col("mean")).alias("features"))
