"""Exact dedup: two-pass Bloom filtering finds possibly repeated hashes, and only those rows are shuffled.

Pass one lets each task fill a Bloom filter of the hashes it has met and a second one of those it has
met twice. Merging the tasks' filters, a bit met in two tasks counts as met twice. Pass two looks every
hash up in the merged second filter: a hash with any bit unset is certainly unique and its row passes
straight through; the others, true repeats and a few chance ones, are shuffled and counted exactly.

The filter is sized from the number of rows at ``CELLS_PER_ROW`` bits each. A filter never has more than
``MAX_CELLS`` bits (16 MB), so larger tables are taken in rounds of disjoint hash ranges; the hashes of a
round are read from its own folder of the hash table, so all rounds together read it once per pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starpath.llm.common import hot_join, new_folder, text_column, utf8, written

CELLS_PER_ROW = 16
PROBES = 4
MAX_CELLS = 1 << 27
#: Bits of one filter block; a hash sets all its bits within one block.
BLOCK = 1 << 12


def hashed(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, digest``: SHA-256 of the text with A-Z lower-cased, in UTF-8; null counts as empty."""
    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [hashlib.sha256(x.lower()).digest() for x in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.binary())], names=["id", "digest"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("id"), text_column(text)).mapInArrow(digests, f"id {kind}, digest binary")


def _cells(cells: int) -> tuple[Column, list[Column]]:
    """The filter block of a digest, and its bits within the block, from different bytes of the digest."""
    def number(first: int, size: int) -> Column:
        return F.conv(F.hex(F.substring("digest", first, size)), 16, 10).cast("long")

    return number(5, 7) % (cells // BLOCK), [number(12 + 2 * k, 2) % BLOCK for k in range(PROBES)]


def _fill(cells: int):
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(cells, bool), np.zeros(cells, bool)
        for batch in batches:
            at = np.stack([batch.column(k).to_numpy() for k in range(PROBES)], 1)
            unique, counts = np.unique(at, axis=0, return_counts=True)
            again = once[unique].all(1) | (counts > 1)
            twice[unique[again]] = True
            once[unique] = True
        words = [np.packbits(x, bitorder="little").view(np.int64) for x in (once, twice)]
        used = np.flatnonzero(words[0])
        for part in np.array_split(used, len(used) // 65_536 + 1):
            yield pa.RecordBatch.from_arrays(
                [pa.array(part), pa.array(words[0][part]), pa.array(words[1][part])], names=["word", "once", "twice"])

    return fill


def repeated_blocks(hashes: DataFrame, cells: int) -> DataFrame:
    """``block, bits``: the merged filter of hashes met twice, as one array of longs per block."""
    block, probes = _cells(cells)
    filled = hashes.select(*((block * BLOCK + p).alias(f"p{k}") for k, p in enumerate(probes))).mapInArrow(
        _fill(cells), "word long, once long, twice long")
    merged = filled.groupBy("word").agg(F.collect_list(F.struct("once", "twice")).alias("tasks")).select(
        "word", F.aggregate(
            "tasks", F.struct(F.lit(0).cast("long").alias("once"), F.lit(0).cast("long").alias("twice")),
            lambda acc, x: F.struct(
                acc["once"].bitwiseOR(x["once"]).alias("once"),
                acc["twice"].bitwiseOR(x["twice"]).bitwiseOR(acc["once"].bitwiseAND(x["once"])).alias("twice")),
            lambda acc: acc["twice"]).alias("bits")).filter("bits != 0")
    per_block = BLOCK // 64
    return merged.groupBy((F.col("word") / per_block).cast("long").alias("block")).agg(
        F.map_from_entries(F.collect_list(F.struct((F.col("word") % per_block).cast("int").alias("w"), "bits"))).alias("words")
    ).select("block", F.transform(
        F.sequence(F.lit(0), F.lit(per_block - 1)),
        lambda w: F.coalesce(F.element_at("words", w), F.lit(0).cast("long"))).alias("bits"))


def possibly_repeated(hashes: DataFrame, cells: int) -> DataFrame:
    """``hashes`` with ``maybe``: whether the filter says that the digest may occur twice."""
    block, probes = _cells(cells)
    seen = F.broadcast(repeated_blocks(hashes, cells).withColumnRenamed("block", "_block"))
    bits = [F.expr(f"(shiftright(element_at(bits, cast(_p{k} div 64 as int) + 1), cast(_p{k} % 64 as int)) & 1) = 1")
            for k in range(PROBES)]
    looked = hashes.withColumn("_at", block).withColumns({f"_p{k}": p for k, p in enumerate(probes)}).join(
        seen, F.col("_at") == F.col("_block"), "left")
    return looked.select(*hashes.columns, F.coalesce(reduce(lambda a, b: a & b, bits), F.lit(False)).alias("maybe"))


def exact_dedup(docs: DataFrame, id_column: str = "doc_id", text: str = "text", max_cells: int = MAX_CELLS) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256, shuffled``: one row per row of ``docs``.

    Of rows with equal text (A-Z lower-cased) the one with the largest id stays; ``shuffled`` tells
    whether the filter sent the row to the exact count. Null texts count as empty and are equal to
    each other. Rows repeated with the same id are one group and all kept. Null ids never win and are
    kept only when the whole group has none. No rows in, no rows out; other columns are ignored.
    """
    path = new_folder(docs, "hashes")
    rows = max(docs.count(), 1)
    cells = BLOCK
    while cells < min(rows * CELLS_PER_ROW, max_cells):
        cells *= 2
    rounds = -(-rows * CELLS_PER_ROW // cells)
    first = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")
    hashed(docs, id_column, text).withColumn("round", (first % rounds).cast("int")).write.partitionBy("round").parquet(path)
    spark, kind = docs.sparkSession, docs.schema[id_column].dataType.simpleString()
    schema = f"id {kind}, digest binary, round int"
    parts = [possibly_repeated(spark.read.schema(schema).parquet(path).filter(F.col("round") == r).drop("round"), cells)
             for r in range(rounds)]
    looked = written(reduce(DataFrame.union, parts), "looked-up")
    maybe = looked.filter("maybe")
    groups = written(maybe.groupBy("digest").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    total = groups.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    counted = hot_join(maybe.drop("maybe"), groups, "digest", "group_size", F.col("id"), total)
    alone = looked.filter(~F.col("maybe")).select(
        "id", "digest", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    out = counted.withColumn("shuffled", F.lit(True)).unionByName(alone.withColumn("shuffled", F.lit(False)))
    return out.select(
        F.col("id").alias(id_column), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"), "shuffled")
