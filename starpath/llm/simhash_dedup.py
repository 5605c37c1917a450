"""Near-dedup by SimHash fingerprints: Golay-code keys find those that differ in few bits.

1. Each text gives a 64-bit fingerprint: the majority of its shingles' hashes, bit by bit. Texts with the
   same fingerprint are one node from here on, however many copies there are.
2. A node has about a hundred keys (see ``golay``); any two nodes that differ in at most three bits share one
   on which one asks and the other answers. Keys are counted once; keys without both are dropped.
3. Nodes meet under the keys that are left. Long lists are dealt into blocks, and pairs of blocks are
   separate work. All members of a block are compared by their whole fingerprints, and what leaves a block
   is a star for each group that its links join, so a list gives no more rows than it has members.
4. Links are closed to components.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starpath.llm import golay
from starpath.llm.common import BITS, bitmap, has_bit, hot_join, text_column, utf8, written
from starpath.llm.near_dedup import components

SHINGLE = 3
SEED = 42
#: Fingerprints link when at most so many bits differ; the keys are made for three.
DISTANCE = 3
#: Members of one block of a list.
BLOCK = 512
#: Bytes of a text whose words are held at once, and fingerprints whose keys are.
PIECE, AT_ONCE = 1 << 20, 4096
#: Nodes whose keys are made in one task, as a node of eight bytes gives about a hundred keys.
PER_TASK = 200_000

_hash = partial(xxhash.xxh64_intdigest, seed=SEED)
_SPACE = b" \t\n\v\f\r"


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some at a time."""
    start = 0
    while start < len(text):
        end = start + PIECE
        while end < len(text) and text[end] not in _SPACE:
            end += 1
        yield text[start:end].split()
        start = end


def _votes(words: list[bytes], size: int) -> np.ndarray:
    """How many shingles of these words have each bit set, highest first."""
    joined = b" ".join(words)
    ends = np.cumsum([len(word) + 1 for word in words]) - 1
    starts = np.append(0, ends[:-1] + 1)[:len(words) - size + 1].tolist()
    hashes = np.array([_hash(joined[a:b]) for a, b in zip(starts, ends[size - 1:].tolist())], ">u8")
    return np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """The fingerprint of a text as a signed number; zero without words."""
    votes, count, held = np.zeros(64, np.int64), 0, []
    for words in _pieces(text.lower()):
        held = held[len(held) - size + 1:] + words if len(held) >= size else held + words
        if len(held) >= size:
            votes += _votes(held, size)
            count += len(held) - size + 1
    if not count and held:
        votes, count = _votes(held, len(held)), 1
    return int(np.packbits(votes * 2 > count).view(">i8")[0])


def fingerprints(docs: DataFrame, id_column: str, text: str, size: int) -> DataFrame:
    """``id, node``: each row's fingerprint."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(value, size) for value in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["id", "node"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("id"), text_column(text)).mapInArrow(sign, f"id {kind}, node long")


def _place(key: Column) -> Column:
    """A key's place in a bitmap; ``_post`` has the same in numpy."""
    return key.bitwiseXOR(F.shiftright(key, 20)).bitwiseXOR(F.shiftright(key, 40)).bitwiseAND(F.lit(BITS - 1))


def _post(nodes: DataFrame, known: np.ndarray | None = None) -> DataFrame:
    """``key, node, side``: the nodes' keys, those alone that may be in the bitmap ``known``."""
    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                values = batch.column(0).slice(at, AT_ONCE).to_numpy()
                rows, keys, sides = golay.keys(values)
                if known is not None:
                    hit = has_bit(known, (keys ^ (keys >> 20) ^ (keys >> 40)) & (BITS - 1))
                    rows, keys, sides = rows[hit], keys[hit], sides[hit]
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(values[rows]), pa.array(sides)],
                                                 names=["key", "node", "side"])

    return nodes.select("node").mapInArrow(post, "key long, node long, side tinyint")


def shared_keys(nodes: DataFrame) -> DataFrame:
    """``key, n``: keys on which a node asks and another answers, and how many nodes have them."""
    answers, asks = (F.sum(F.col("side").bitwiseAND(F.lit(side).cast("tinyint")).cast("int")) for side in (golay.ANSWERS, golay.ASKS))
    counted = _post(nodes).groupBy("key").agg(answers.alias("answers"), (asks / golay.ASKS).cast("long").alias("asks"), F.count("*").alias("n"))
    return counted.filter("answers > 0 and asks > 0 and n > 1").select("key", "n")


def lists(nodes: DataFrame, block: int) -> DataFrame:
    """``nodes``: the members of each shared key, in blocks and pairs of blocks."""
    tasks = max(nodes.sparkSession.sparkContext.defaultParallelism, -(-nodes.count() // PER_TASK))
    nodes = nodes.select("node").repartition(tasks, "node")
    shared = written(shared_keys(nodes), "shared-keys")
    total = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    posted = _post(nodes, bitmap(shared, _place(F.col("key")))).select("key", "node")
    met = hot_join(posted, shared, "key", "n", F.col("node"), total).filter("n is not null")
    blocks = F.ceil(F.col("n") / block).cast("int")
    part = F.pmod(F.xxhash64("node"), blocks).cast("int")
    dealt = met.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return dealt.groupBy("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j")).agg(
        F.collect_list("node").alias("nodes")).select(F.array_sort("nodes").alias("nodes")).filter(F.size("nodes") > 1).distinct()


def links(members: DataFrame, distance: int) -> DataFrame:
    """``a, b``: for what links join within each list, its least node and each other one."""
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(0)
            values, offsets = held.flatten().to_numpy().view(np.uint64), np.diff(held.offsets.to_numpy())
            starts = np.cumsum(offsets) - offsets
            two = starts[offsets == 2]
            near = np.bitwise_count(values[two] ^ values[two + 1]) <= distance
            left, right = [values[two][near]], [values[two + 1][near]]
            for start, size in zip(starts[offsets > 2], offsets[offsets > 2]):
                own = values[start:start + size]
                near = np.bitwise_count(own[:, None] ^ own[None, :]) <= distance
                free = np.ones(size, bool)
                while free.any():
                    group = np.zeros(size, bool)
                    group[np.argmax(free)] = True
                    edge = group
                    while edge.any():
                        edge = near[edge].any(0) & ~group
                        group = group | edge
                    free &= ~group
                    joined = own[group]
                    left.append(np.repeat(joined[0], len(joined) - 1))
                    right.append(joined[1:])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(side).view(np.int64)) for side in (left, right)], names=["a", "b"])

    return members.mapInArrow(confirm, "a long, b long").distinct()


def simhash_dedup(docs: DataFrame, id_column: str = "doc_id", text: str = "text", size: int = SHINGLE,
                  distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """``doc_id, fingerprint, component_id, kept``: one row per row of ``docs``.

    Words are cut at ASCII white space after lower-casing A-Z; shingles are runs of ``size`` words, repeats
    included, and a text with fewer words is one shingle. Texts without words, and null texts, have the
    fingerprint zero and link like any other. ``component_id`` is the least id in the component; rows
    repeated with that id all stay. A null id never is a component's least unless the component has no other.
    ``distance`` is at most three. Other columns are ignored; no rows in, no rows out.
    """
    if not 0 <= distance <= DISTANCE:
        raise ValueError(f"the keys find fingerprints that differ in at most {DISTANCE} bits")
    signed = written(fingerprints(docs, id_column, text, size), "fingerprints")
    nodes = written(signed.groupBy("node").agg(F.min("id").alias("least"), F.count("*").alias("copies")), "nodes")
    found = written(links(lists(nodes, block), distance), "found-links")
    labels = components(found, nodes)
    classes = written(nodes.join(labels, "node", "left").select(
        "node", "copies", F.coalesce("label.least", "least").alias("component_id")), "classes")
    total = classes.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    return hot_join(signed, classes, "node", "copies", F.col("id"), total).select(
        F.col("id").alias(id_column), F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
