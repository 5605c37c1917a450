"""Parquet tables: stores, and ratings laid out by season and state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starpath.operators.datasets import spread

SLICE_COLUMNS = ("season", "state")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table."""
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def write_slices(ratings: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Ratings as one folder per season and state; a slice that holds much of the data is written by many tasks."""
    spread(ratings, None, *SLICE_COLUMNS).write.mode(mode).partitionBy(*SLICE_COLUMNS).parquet(path)


def read_slice(spark: SparkSession, path: str, season: str, state: str | None = None) -> DataFrame:
    """One season, or one season and state; Spark opens only the folders of that slice."""
    ratings = spark.read.parquet(path).filter(F.col("season") == season)
    return ratings if state is None else ratings.filter(F.col("state") == state)
