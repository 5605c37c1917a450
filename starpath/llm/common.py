"""What several operators here need: written tables, joins with hot keys, bounded bitmaps, Arrow batches.

Documents are rows ``doc_id, text`` with any further columns. A repeated ``doc_id`` is two rows, not one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starpath.session import shared_folder

#: A key is hot when it holds more than this part of the rows; so there are fewer than 1000 hot keys.
HOT_PARTS = 1000


def new_folder(df: DataFrame, name: str) -> str:
    """A fresh path in the folder all executors share; it is removed when the session's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/starpath-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends here and a lost executor costs nothing."""
    path = new_folder(df, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hot_join(facts: DataFrame, groups: DataFrame, key: str, size: str, spread_by: Column, total: int) -> DataFrame:
    """Left join of ``facts`` to one-row-per-key ``groups`` where a few keys may hold most of the facts.

    ``groups`` tells in ``size`` how many facts a key has, ``total`` is their sum. Rows of keys above
    ``total / HOT_PARTS`` (fewer than ``HOT_PARTS`` keys, a proven bound) are broadcast; facts of those
    keys get their values there and go into the shuffle under a hash of ``spread_by``, so they land
    evenly. The other keys meet in an ordinary join.
    """
    values = [c for c in groups.columns if c != key]
    least = total / HOT_PARTS
    hot = groups.filter(F.col(size) > least).select(
        F.col(key).alias("_hot_key"), F.struct(*values).alias("_hot"))
    cold = groups.filter(F.col(size) <= least).select(
        F.xxhash64(key).alias("_deal"), F.col(key).alias("_cold_key"), F.struct(*values).alias("_cold"))
    marked = facts.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left").withColumn(
        "_deal_by", F.when(F.col("_hot_key").isNull(), F.xxhash64(key)).otherwise(F.xxhash64(spread_by)))
    met = marked.join(
        cold, (F.col("_deal_by") == F.col("_deal")) & (F.col(key) == F.col("_cold_key")), "left")
    found = F.coalesce("_hot", "_cold")
    return met.select(*facts.columns, *(found[c].alias(c) for c in values))


#: Bits of a bitmap: 2 MB, whatever it is made from.
BITS = 1 << 24


def bit_of(column: str | Column) -> Column:
    """The place of a key in a bitmap."""
    return F.pmod(F.xxhash64(column), F.lit(BITS))


def bitmap(keys: DataFrame, place: Column) -> np.ndarray:
    """``BITS`` bits as 64-bit words, set at each key's ``place`` (0 to ``BITS - 1``).

    Its size is fixed; more keys only make it less selective. Whoever uses it joins exactly afterwards.
    """
    words = keys.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b")).toArrow()
    out = np.zeros(BITS // 64, np.int64)
    out[words["w"].to_numpy()] = words["b"].to_numpy()
    return out


def has_bit(words: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Which places are set."""
    return (words[places >> 6] >> (places & 63)) & 1 == 1


def utf8(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """The values as UTF-8; null counts as empty."""
    return column.cast(pa.binary()).fill_null(b"").to_pylist()


def binary_rows(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Slices ``offsets[i]:offsets[i + 1]`` of a numpy array as binary values."""
    data = np.ascontiguousarray(values)
    places = (offsets * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(places), pa.py_buffer(data)])


def chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def text_column(name: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
