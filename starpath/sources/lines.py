"""Text lines in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``value`` per line of a file or a folder of files."""
    return spark.read.text(path)


def read_ordered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``value`` and ``line_order``, which grows by file name, then by place within the file.

    A row id alone would not do: Spark packs file pieces into tasks by size. The piece's own start
    comes first, and rows of one piece are read in order by one task.
    """
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("row"),
    )
    return spark.read.text(path).select("value", place.alias("line_order"))


def write_lines(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One line per row from ``value``; ``mode='append'`` adds rating records to earlier ones."""
    lines.select("value").write.mode(mode).text(path)


def write_tuples(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Rows as delimited text."""
    df.write.mode(mode).option("escape", '"').csv(path)
