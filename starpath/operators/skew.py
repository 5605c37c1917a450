"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starpath.session import cut_lineage

#: Counters a task has for each of the parts asked for. The counts' error stays below one part in as many.
COUNTERS = 4


def frequent_keys(df: DataFrame, key: str, parts: int = 1000) -> tuple[DataFrame, int]:
    """``(key, n)`` of every key that holds more than ``1 / parts`` of the rows, and the number of rows.

    Each task has ``COUNTERS * parts`` counters. When it has more keys than that, it takes the count of the largest
    one that has no place from all and drops those that are left with nothing; what it took in all is its error. So a
    key's rows are at most its summed counts and the summed errors, which stay below one in ``COUNTERS * parts`` of all rows.
    ``n`` is that bound. Keys that may hold more than the share are returned: all that do, and fewer than
    ``COUNTERS / (COUNTERS - 1) * parts`` in all. Rows are read once, and no more than the counters is shuffled.
    """
    kind = df.schema[key].dataType.simpleString()
    most = COUNTERS * parts

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, error = None, 0, 0
        for batch in batches:
            rows += batch.num_rows
            found = pc.value_counts(batch.column(0).drop_null())
            new = pa.table([found.field("values"), found.field("counts")], names=["key", "n"])
            held = new if held is None else pa.concat_tables([held, new]).group_by("key", use_threads=False).aggregate(
                [("n", "sum")]).select(["key", "n_sum"]).rename_columns(["key", "n"])
            if held.num_rows > most:
                least = pc.sort_indices(held, [("n", "descending")])[most]
                taken = held["n"][least.as_py()].as_py()
                held = pa.table([held["key"], pc.subtract(held["n"], taken)], names=["key", "n"]).filter(pc.field("n") > 0)
                error += taken
        if held is not None:
            yield from pa.table([held["key"], held["n"], pa.nulls(held.num_rows, pa.int64()), pa.nulls(held.num_rows, pa.int64())],
                                names=["key", "n", "rows", "error"]).combine_chunks().to_batches()
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, held.schema.field("key").type), pa.nulls(1, pa.int64()), pa.array([rows], pa.int64()), pa.array([error], pa.int64())],
                names=["key", "n", "rows", "error"])

    summaries = df.select(key).mapInArrow(count, f"key {kind}, n bigint, rows bigint, error bigint").groupBy("key").agg(
        F.sum("n").alias("n"), F.sum("rows").alias("rows"), F.sum("error").alias("error"))
    summaries = cut_lineage(summaries)
    total, error = summaries.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum("error"), F.lit(0))).first()
    bound = F.col("n") + error
    return summaries.filter(F.col("key").isNotNull() & (bound * parts > total)).select(F.col("key").alias(key), bound.alias("n")), total


def salted_join(facts: DataFrame, lookup: DataFrame, key: str, spread_by: str, how: str = "inner",
                parts: int = 1000) -> DataFrame:
    """Join ``facts`` to one-row-per-key ``lookup`` on ``key``, cutting hot keys by the hash of ``spread_by``.

    A key is hot when it may hold more than ``1 / parts`` of the facts, by ``frequent_keys``, so there are fewer than
    ``4 / 3 * parts`` hot keys and their list is broadcast. A hot key's facts go to as many salts as it may hold parts,
    and its lookup row is repeated once per salt: fewer than ``3 * parts`` extra rows in all. Adaptive
    execution does not cover this case by itself where the lookup is an aggregate on the same key,
    because no exchange then stands right below the join. Facts are read twice, once to count, so
    hand in a table or a frame with its lineage cut.
    """
    found, total = frequent_keys(facts, key, parts)
    hot = F.broadcast(found.select(key, F.ceil(F.col("n") * parts / F.lit(max(total, 1))).cast("int").alias("_salts")))
    salts = F.coalesce("_salts", F.lit(1))
    salted_facts = facts.join(hot, key, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(spread_by), salts).cast("int")).drop("_salts")
    salted_lookup = lookup.join(hot, key, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return salted_facts.join(salted_lookup, [key, "_salt"], how).drop("_salt")
