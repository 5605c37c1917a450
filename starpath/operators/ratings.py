"""Ratings: text form, validation, cap, split, summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from starpath.functions import numbers, ratings as rules, text


def parse_ratings(lines: DataFrame) -> DataFrame:
    """``user::item::rating::date`` lines as typed columns with the bucket digit and a reject_reason."""
    parts = F.col("_parts")
    typed = lines.select("*", text.once(text.fields(F.col("value"))).alias("_parts")).select(
        *lines.columns,
        F.size(parts).alias("_size"),
        numbers.whole_number(F.get(parts, F.lit(0))).alias("user_id"),
        numbers.whole_number(F.get(parts, F.lit(1))).alias("item_id"),
        numbers.decimal_number(F.get(parts, F.lit(2))).alias("rating"),
        F.get(parts, F.lit(3)).alias("rated_at"),
    )
    typed = typed.withColumn("bucket", rules.bucket_digit(F.col("rated_at")))
    reason = (
        F.when(F.col("_size") < 4, F.lit("missing_field"))
        .when(F.col("user_id").isNull() | F.col("item_id").isNull(), F.lit("bad_id"))
        .when(F.col("rating").isNull(), F.lit("bad_rating"))
        .when(F.col("bucket").isNull(), F.lit("bad_date"))
    )
    return typed.withColumn("reject_reason", reason).drop("_size")


def with_timestamp(ratings: DataFrame) -> DataFrame:
    """Adds ``rated_ts`` from a ten-digit epoch or a date; null where the field is neither."""
    field = F.col("rated_at")
    epoch = F.when(field.rlike("^[0-9]{9,10}$"), F.timestamp_seconds(field.try_cast("bigint")))
    return ratings.withColumn("rated_ts", F.coalesce(epoch, F.try_to_timestamp(field)))


def rating_lines(ratings: DataFrame, user: str = "user_id", item: str = "item_id",
                 rating: str = "rating", rated_at: str = "rated_at") -> DataFrame:
    """The text form of ratings, whole stars without a decimal point."""
    star = F.col(rating)
    as_text = F.when(star == F.floor(star), star.cast("bigint").cast("string")).otherwise(star.cast("string"))
    return ratings.select(
        F.concat_ws("::", F.col(user).cast("string"), F.col(item).cast("string"), as_text,
                    F.col(rated_at).cast("string")).alias("value")
    )


def validate_stars(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds ``stars`` and ``reject_reason`` for ratings as typed."""
    number = F.col("_number")
    return df.select("*", text.once(rules.typed_number(F.col(raw))).alias("_number")).select(
        *df.columns, rules.stars(number).alias("stars"), rules.star_problem(number).alias("reject_reason"))


def cap_per_user(ratings: DataFrame, order_by: list, cap: int = 11, user: str = "user_id") -> DataFrame:
    """A user's first ``cap`` ratings with their ``position``; each task keeps at most ``cap`` rows per user to shuffle."""
    order = W.partitionBy(user).orderBy(*order_by)
    return ratings.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= cap)


def with_split(ratings: DataFrame) -> DataFrame:
    return ratings.withColumn("split", rules.split_name(F.col("bucket")))


def split_sizes(ratings: DataFrame) -> DataFrame:
    return with_split(ratings).groupBy("split").agg(F.count("*").alias("n_ratings"))


def summary(ratings: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Ratings, users and items in one pass; the distinct keys are combined before the shuffle."""
    return ratings.groupBy(*by).agg(
        F.count("*").alias("n_ratings"),
        F.count_distinct("user_id").alias("n_users"),
        F.count_distinct("item_id").alias("n_items"),
    )


def season_counts(df: DataFrame, date: str) -> DataFrame:
    return df.groupBy(rules.season_of(F.col(date)).alias("season")).agg(F.count("*").alias("n_ratings"))
