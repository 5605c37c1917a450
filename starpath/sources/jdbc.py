"""Database tables through Spark's JDBC writer; the caller brings URL and driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.readwriter import DataFrameWriter


def jdbc_writer(df: DataFrame, driver: str, connections: int = 8, batch: int = 10_000) -> DataFrameWriter:
    """A writer that opens at most ``connections`` connections and sends rows in batches."""
    return (
        df.write.format("jdbc").mode("overwrite")
        .option("driver", driver)
        .option("numPartitions", connections)
        .option("batchsize", batch)
    )


def write_jdbc(df: DataFrame, url: str, table: str, driver: str, connections: int = 8) -> None:
    """Replace a database table."""
    jdbc_writer(df, driver, connections).option("url", url).option("dbtable", table).save()
