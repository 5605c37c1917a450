"""Split sizes and the mean baseline kept up to date from new files only.

What the results need of a file is additive: per group and split its ratings' count, mean and summed squares around
the mean. These few rows are kept per file, under the file's path, length and time. An update reads the files that have
none yet, in one pass, and its rows get their name by one rename, so a failed update leaves nothing behind. Two updates
at once may both read a file; their rows for it are equal, and one of them counts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starpath.operators.ratings import with_split
from starpath.sources import versions

_KEY = ("file", "length", "changed")


def _named(files: DataFrame) -> DataFrame:
    data = F.col("_metadata")
    return files.withColumns({"file": data["file_path"], "length": data["file_size"],
                              "changed": F.unix_millis(data["file_modification_time"])})


def _of_files(ratings: DataFrame, by: Sequence[str]) -> DataFrame:
    return with_split(ratings).groupBy(*_KEY, *by, "split").agg(
        F.count("rating").alias("n"), F.avg("rating").alias("mean"), F.var_pop("rating").alias("_var")).select(
        *_KEY, *by, "split", "n", "mean", (F.col("n") * F.col("_var")).alias("squares"))


def update(spark: SparkSession, source: str, state: str, by: Sequence[str] = (),
           read: Callable[[SparkSession, list[str]], DataFrame] | None = None) -> int:
    """Adds the files of ``source`` that ``state`` has not seen; the number of new files.

    ``read`` turns paths into ratings with ``rating``, ``bucket`` and ``by``; by default they are Parquet. A file
    that was rewritten in place is a new file, so give new ratings files of their own. A file without ratings is
    noted by a row of count zero.
    """
    listed = _named(spark.read.format("binaryFile").load(source)).select(*_KEY)
    fresh = listed if not versions.numbered(spark, state) else listed.join(
        tallies(spark, state).select(*_KEY).distinct(), list(_KEY), "left_anti")
    found = fresh.collect()
    if not found:
        return 0
    paths = [row.file for row in found]
    ratings = _named(read(spark, paths) if read else spark.read.parquet(*paths))
    empty = spark.createDataFrame(found, listed.schema).select(
        *_KEY, *[F.lit(None).cast(ratings.schema[name].dataType).alias(name) for name in by],
        F.lit(None).cast("string").alias("split"), F.lit(0).cast("bigint").alias("n"),
        F.lit(0.0).alias("mean"), F.lit(0.0).alias("squares"))
    rows = _of_files(ratings, by)
    draft = versions.unfinished(state)
    rows.unionByName(empty).coalesce(1).write.parquet(draft)
    versions.take_next_number(spark, draft, state)
    return len(paths)


def tallies(spark: SparkSession, state: str) -> DataFrame:
    """All kept rows, each file's once."""
    folders = [f"{state.rstrip('/')}/{number}" for number in versions.numbered(spark, state)]
    kept = spark.read.parquet(*folders)
    return kept.dropDuplicates([c for c in kept.columns if c not in ("n", "mean", "squares")])


def merged(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """``by..., n, mean, squares`` of larger groups: spread within the parts, and of the parts' means around the whole's."""
    parts = rows.filter("n > 0").withColumn("_key", F.struct(F.lit(0), *by))
    whole = parts.groupBy("_key").agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_mean"))
    off = F.col("mean") - F.col("_mean")
    means = whole.select(F.col("_key").alias("_whole"), "_mean")
    return parts.join(means, F.col("_key").eqNullSafe(F.col("_whole"))).groupBy(*by).agg(
        F.sum("n").alias("n"), F.first("_mean").alias("mean"), F.sum(F.col("squares") + F.col("n") * off * off).alias("squares"))


def mean_baseline(rows: DataFrame) -> DataFrame:
    """One row: sizes of the splits, the mean of train and validation, and its error on the test split."""
    split = merged(rows, ["split"])

    def of(name: str, value: str) -> F.Column:
        return F.coalesce(F.max(F.when(F.col("split") == name, F.col(value))), F.lit(0))

    wide = split.agg(*[of(name, "n").alias(f"n_{name}") for name in ("train", "validation", "test")],
                     *[of(name, "mean").alias(f"_{name}") for name in ("train", "validation", "test")], of("test", "squares").alias("_squares"))
    total = F.col("n_train") * F.col("_train") + F.col("n_validation") * F.col("_validation")
    known = wide.withColumn("mean_rating", F.try_divide(total, F.col("n_train") + F.col("n_validation")))
    off = F.col("_test") - F.col("mean_rating")
    error = F.sqrt(F.try_divide(F.col("_squares") + F.col("n_test") * off * off, F.col("n_test")))
    return known.select("n_train", "n_validation", "n_test", "mean_rating", error.alias("baseline_rmse"))
