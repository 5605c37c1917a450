"""City and state lookups against the ten-row dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starpath.schemas import cities


def with_city(df: DataFrame, state: str = "state") -> DataFrame:
    """Adds ``city`` for a state code; null where the code is unknown."""
    lookup = cities(df.sparkSession).select(F.col("state").alias(state), "city")
    return df.join(lookup, state, "left")


def with_state(df: DataFrame, city: str = "city") -> DataFrame:
    """Adds ``state`` for a plain city name; null where the city is unknown."""
    lookup = cities(df.sparkSession).select(F.col("city").alias(city), "state")
    return df.join(lookup, city, "left")


def with_place(df: DataFrame, nation_key: str) -> DataFrame:
    """Adds ``state`` and ``city`` for a nation key: the dimension row with the key's last digit."""
    lookup = cities(df.sparkSession)
    return df.join(lookup, F.pmod(F.col(nation_key), F.lit(10)) == lookup["state_index"])
