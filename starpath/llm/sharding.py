"""Sharding by histogram sort: splitters are refined by exact byte counts, then rows are exchanged once.

Every row gets a 64-bit key: the high bits come from the text, the low bits from the id. So equal texts
lie next to each other and stay in one shard wherever a cut can fall between texts; only a group too
large for that is cut, by id. In each round every open splitter sends a comb of probe keys from its
interval; each task counts the bytes below all probes in its own rows, the counts are added up, and the
interval shrinks to the two probes around the wanted size. A splitter is settled once a probe is within
the tolerance, or no key is left between its bounds. The driver sees only probes times splitters numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from starpath.llm.common import written

SHARDS = 8
PROBES = 64
#: A splitter may miss its ideal place by this part of a shard's ideal size.
TOLERANCE = 0.0005
#: Low key bits that come from the id.
ID_BITS = 20
#: Rows that one task numbers.
PIECE_ROWS = 4_000


def bytes_below(keyed: DataFrame, probes: np.ndarray) -> np.ndarray:
    """Exact bytes with ``key`` less than each of the sorted probes, counted per task and added up."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(len(probes) + 1, np.int64)
        for batch in batches:
            at = np.searchsorted(probes, batch.column(0).to_numpy(), side="right")
            np.add.at(found, at, batch.column(1).to_numpy())
        used = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(found[used])], names=["cell", "bytes"])

    sums = keyed.select("key", "size").mapInArrow(count, "cell long, bytes long").groupBy("cell").agg(
        F.sum("bytes").alias("bytes")).toArrow()
    cells = np.zeros(len(probes) + 1, np.int64)
    cells[sums["cell"].to_numpy()] = sums["bytes"].to_numpy()
    return np.cumsum(cells)[:-1]


def splitters(keyed: DataFrame, shards: int = SHARDS, probes: int = PROBES, tolerance: float = TOLERANCE) -> list[int]:
    """``shards - 1`` keys; shard ``i`` holds the keys from splitter ``i - 1`` up to below splitter ``i``."""
    total = keyed.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    lowest, highest = -(1 << 63), (1 << 63) - 1
    wanted = [total * (i + 1) / shards for i in range(shards - 1)]
    bounds = [(lowest, 0, highest, total) for _ in wanted]
    near = max(total / shards * tolerance, 1)
    while True:
        open_ones = [i for i, (low, below, high, upto) in enumerate(bounds)
                     if high - low > 1 and min(wanted[i] - below, upto - wanted[i]) > near]
        if not open_ones:
            break
        combs = {i: [bounds[i][0] + (bounds[i][2] - bounds[i][0]) * k // (probes + 1) for k in range(1, probes + 1)]
                 for i in open_ones}
        keys = np.array(sorted({key for comb in combs.values() for key in comb}), np.int64)
        count = dict(zip(keys.tolist(), bytes_below(keyed, keys).tolist()))
        for i, comb in combs.items():
            for key in comb:
                if count[key] <= wanted[i] and key > bounds[i][0]:
                    bounds[i] = (key, count[key], *bounds[i][2:])
                elif count[key] > wanted[i] and key < bounds[i][2]:
                    bounds[i] = (*bounds[i][:2], key, count[key])
    return [low if wanted[i] - below <= upto - wanted[i] else high for i, (low, below, high, upto) in enumerate(bounds)]


def shard(docs: DataFrame, id_column: str = "doc_id", text: str = "text", shards: int = SHARDS,
          tolerance: float = TOLERANCE) -> DataFrame:
    """The rows of ``docs`` with ``size``, ``shard`` (0 to ``shards - 1``) and ``slot`` (gapless from 0 in a shard).

    The size is the text's UTF-8 bytes plus 1, a null text has none. Shards are near equal in bytes;
    equal texts share a shard unless a cut must fall inside their group. Rows repeated in full are
    separate rows. Null ids are allowed. Columns of ``docs`` that bear a new column's name are replaced.
    No rows in, no rows out.
    """
    rows = docs.drop("size", "shard", "slot")
    size = F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("long") + 1
    low = (1 << ID_BITS) - 1
    key = F.xxhash64(text).bitwiseAND(F.lit(~low)).bitwiseOR(F.xxhash64(F.lit(1), F.col(id_column)).bitwiseAND(F.lit(low)))
    keyed = rows.withColumn("size", size).withColumn("_key", key)
    narrow = written(keyed.select(F.col("_key").alias("key"), "size"), "shard-keys")
    cuts = splitters(narrow, shards, PROBES, tolerance)
    pieces = max(1, -(-narrow.count() // (shards * PIECE_ROWS)))

    def place(of: str) -> tuple[Column, Column]:
        """Shard and piece of a key; pieces deal a shard's rows to tasks."""
        past = sum((F.when(F.col(of) >= cut, 1).otherwise(0) for cut in cuts), F.lit(0))
        return past.cast("int"), F.pmod(F.xxhash64(of), F.lit(pieces)).cast("int")

    shard_of, piece_of = place("key")
    sizes = narrow.groupBy(shard_of.alias("_shard"), piece_of.alias("_piece")).agg(F.count("*").alias("rows"))
    before = W.partitionBy("_shard").orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("_shard", "_piece", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("_start"))
    within = W.partitionBy("_shard", "_piece").orderBy("_key", id_column)
    shard_of, piece_of = place("_key")
    placed = keyed.withColumn("_shard", shard_of).withColumn("_piece", piece_of).withColumn(
        "_slot", F.row_number().over(within) - 1).join(starts, ["_shard", "_piece"])
    return placed.select(*rows.columns, "size", F.col("_shard").alias("shard"), (F.col("_slot") + F.col("_start")).alias("slot"))
