"""Record types and the city dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

STORE_SCHEMA = T.StructType([
    T.StructField("city", T.StringType(), False),
    T.StructField("season", T.StringType(), False),
    T.StructField("store_id", T.StringType(), False),
    T.StructField("store_name", T.StringType(), False),
    T.StructField("rank", T.IntegerType(), False),
])

RATING_SCHEMA = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("item_id", T.LongType()),
    T.StructField("rating", T.DoubleType()),
    T.StructField("rated_at", T.StringType()),
    T.StructField("bucket", T.IntegerType()),
])

REQUEST_SCHEMA = T.StructType([
    T.StructField("request_id", T.LongType()),
    T.StructField("url", T.StringType()),
])

# State code and city, in dimension order.
CITIES = (
    ("EDH", "Edinburgh"),
    ("BW", "Karlsruhe"),
    ("QC", "Montreal"),
    ("ON", "Waterloo"),
    ("PA", "Pittsburgh"),
    ("NC", "Charlotte"),
    ("IL", "Urbana-Champaign"),
    ("AZ", "Phoenix"),
    ("NV", "Las Vegas"),
    ("WI", "Madison"),
)

# Season names, in calendar order.
SEASONS = ("spring", "summer", "autumn", "winter")


def cities(spark: SparkSession) -> DataFrame:
    """``(state_index, state, city)``: ten rows, known to Catalyst as an inline table and so broadcast by size."""
    rows = ", ".join(f"({index}, '{state}', '{city}')" for index, (state, city) in enumerate(CITIES))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS cities(state_index, state, city)")
