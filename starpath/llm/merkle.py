"""Merkle manifest of a dataset, with each leaf's proof, by butterfly exchange.

A row's leaf is the hash of its fields. Leaves of one tree stand in a stated order; every ``fanout``
consecutive nodes become their hash, the last run with fewer, until one node is left. The roots of all
trees are the leaves of one more tree, whose root stands for the dataset.

1. Leaves are sorted by range; a row's place in its tree is its place in its partition plus what the tree
   has in earlier partitions. Only the first tree of a partition has any there, so there are fewer such
   counts than partitions.
2. Places are cut into aligned blocks of ``fanout ** depth`` leaves. A block hashes its own part of the tree.
3. Blocks then swap subtree roots in rounds. In round r the ``fanout`` blocks whose numbers differ in digit r
   alone send each other the roots of the subtrees they are in. Each hashes the parent for itself and adds
   the others' roots to its own path. After the last round every block holds the tree's root and the upper
   part of its leaves' proofs; nothing is sent down. Numbers up to the next power of ``fanout`` are taken by
   blocks without leaves, which only pass on what they hear, so that each block has all its partners.

A step of a proof is what stands left and right of the node within its run: ``node = H(left + node + right)``.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from starpath.llm.common import hot_join, written

FANOUT = 2
#: Levels of the tree that a block hashes by itself; it holds ``FANOUT ** DEPTH`` leaves.
DEPTH = 12
#: Rounds between two written tables.
ROUNDS_AT_ONCE = 8

_STEP = "struct<left: string, right: string>"
_NO_TREE = "-"


def field(value: Column) -> Column:
    """A value as the hash takes it: its length in UTF-8 bytes, ``:`` and itself; ``-`` if null."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit(_NO_TREE)).otherwise(
        F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(*values: Column) -> Column:
    """The hash of a row with these fields, in hex."""
    return F.sha2(F.concat(*map(field, values)), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    return F.aggregate(proof, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def siblings(proof: Column) -> Column:
    """All hashes of a proof as one text, level by level and left to right."""
    return F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), "")


def _hash(nodes: list[str]) -> str:
    return sha256("".join(nodes).encode()).hexdigest()


def levels(nodes: list[str], fanout: int, depth: int | None = None) -> list[list[str]]:
    """The nodes of a tree level by level: up to one node, or ``depth`` levels up."""
    out = [nodes]
    while len(out[-1]) > 1 if depth is None else len(out) <= depth:
        last = out[-1]
        out.append([_hash(last[at:at + fanout]) for at in range(0, len(last), fanout)])
    return out


def _placed(leaves: DataFrame) -> DataFrame:
    """``leaves`` (tree, at, node, also) with ``place``, the leaf's place in its tree, in order of ``at`` and node."""
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            trees = batch.column(0).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.append(True, trees[1:] != trees[:-1]))
            sizes = np.diff(np.append(starts, len(trees)))
            before = np.zeros(len(starts), np.int64)
            before[0] = seen if trees[0] == last else 0
            places = np.arange(len(trees)) - np.repeat(starts - before, sizes)
            last, seen = trees[-1], int(places[-1]) + 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(places, pa.int64())], names=[*batch.schema.names, "place"])

    # equal leaves are dealt at random; which of them gets which place changes nothing
    order = ["tree", F.col("at").asc_nulls_first(), "node", "deal"]
    ranged = leaves.withColumn("deal", F.rand(1)).repartitionByRange(*order).sortWithinPartitions(*order).drop("deal")
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranged.schema) + ", part int, place long"
    numbered = written(ranged.withColumn("part", F.spark_partition_id()).mapInArrow(number, kind), "leaves")
    counts = numbered.groupBy("tree", "part").agg(F.count("*").alias("n"))
    before = W.partitionBy("tree").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    # only a partition's first tree has leaves in earlier ones: at most one row per partition
    earlier = counts.withColumn("before", F.sum("n").over(before)).filter("before > 0").drop("n")
    return numbered.join(F.broadcast(earlier), ["tree", "part"], "left").withColumn(
        "place", F.col("place") + F.coalesce("before", F.lit(0))).drop("part", "before")


def _blocks(leaves: DataFrame, fanout: int, depth: int) -> DataFrame:
    """``tree, block, blocks, leaves``: aligned blocks; ``blocks`` tells how many the tree has."""
    number = F.floor(F.col("place") / F.lit(fanout ** depth))
    packed = written(_placed(leaves).groupBy("tree", number.alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("place", "at", "node", "also"))).alias("leaves")), "blocks")
    sizes = packed.groupBy("tree").agg(F.count("*").alias("blocks"))
    total = packed.count()
    return written(hot_join(packed, sizes, "tree", "blocks", F.col("block"), total), "sized-blocks")


def _block_roots(blocks: DataFrame, fanout: int, depth: int) -> DataFrame:
    """``tree, block, blocks, root, path``: the root of each block's own part; the path is empty yet."""
    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            several = batch.column(2).to_numpy() > 1
            roots = [levels(nodes, fanout, depth if more else None)[-1][0]
                     for nodes, more in zip(batch.column(3).to_pylist(), several)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(roots, pa.string())], names=["tree", "block", "blocks", "root"])

    return blocks.select("tree", "block", "blocks", "leaves.node").mapInArrow(
        climb, "tree string, block long, blocks long, root string").withColumn("path", F.expr(f"cast(array() as array<{_STEP}>)"))


def _exchanged(blocks: DataFrame, fanout: int, most: int) -> DataFrame:
    """The blocks with the root of their tree and their path to it; ``most`` is the largest number of blocks of a tree."""
    powers = [1]
    while powers[-1] < most:
        powers.append(powers[-1] * fanout)
    full = F.filter(F.array(*[F.lit(p).cast("long") for p in powers]), lambda p: p >= F.col("blocks"))[0]
    # numbers without leaves up to the next power: fewer than fanout per block
    places = F.explode(F.sequence(F.col("block"), full - 1, F.col("blocks"))).alias("number")
    state = blocks.select("tree", "blocks", "root", "path", "block", places).select(
        "tree", "blocks", "path", F.col("number").alias("block"), F.when(F.col("number") == F.col("block"), F.col("root")).alias("root"))
    for done, width in enumerate(powers[:-1], 1):
        high = F.floor(F.col("block") / F.lit(width * fanout))
        group = state.groupBy("tree", "blocks", high.alias("high"), (F.col("block") % F.lit(width)).alias("low")).agg(
            F.array_sort(F.collect_list(F.struct("block", "root", "path"))).alias("run"))
        heard = group.select("tree", "blocks", "run", F.col("run.root").alias("roots"), F.posexplode("run").alias("digit", "own"))
        known = F.exists("roots", lambda root: root.isNotNull())
        # a tree with no more blocks than this has its root already
        growing = F.col("blocks") > width
        left = F.array_join(F.slice("roots", F.lit(1), F.col("digit")), "")
        right = F.array_join(F.slice("roots", F.col("digit") + 2, F.lit(fanout)), "")
        step = F.struct(left.alias("left"), right.alias("right"))
        state = heard.select(
            "tree", "blocks", F.when(growing, F.array_append("own.path", step)).otherwise(F.col("own.path")).alias("path"),
            F.col("own.block").alias("block"),
            F.when(~growing, F.col("own.root")).when(known, F.sha2(F.array_join("roots", ""), 256)).alias("root"))
        if done % ROUNDS_AT_ONCE == 0:
            state = written(state, "rounds")
    return state.filter(F.col("block") < F.col("blocks")).select("tree", "block", "root", "path")


def _forest(leaves: DataFrame, fanout: int, depth: int) -> tuple[DataFrame, DataFrame]:
    """Blocks with their leaves, and the same blocks with root and path, from ``tree, at, node, also``."""
    blocks = _blocks(leaves, fanout, depth)
    most = blocks.agg(F.coalesce(F.max("blocks"), F.lit(0))).first()[0]
    return blocks, written(_exchanged(_block_roots(blocks, fanout, depth), fanout, most), "roots")


def _with_proofs(blocks: DataFrame, upper: DataFrame, fanout: int, depth: int) -> DataFrame:
    """``tree, place, at, node, also, proof`` and the columns of ``upper`` but block and path, one row per leaf."""
    further = [c for c in upper.columns if c not in ("tree", "block", "path")]

    def open_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                held = one.column(2).flatten()
                nodes = held.field("node").to_pylist()
                inner = levels(nodes, fanout, depth if one.column(1)[0].as_py() > 1 else None)[:-1]
                path = one.column(3)[0].as_py()
                lefts, rights = [], []
                for place in range(len(nodes)):
                    for nodes_here in inner:
                        at = place - place % fanout
                        lefts.append("".join(nodes_here[at:place]))
                        rights.append("".join(nodes_here[place + 1:at + fanout]))
                        place //= fanout
                    lefts += [step["left"] for step in path]
                    rights += [step["right"] for step in path]
                steps = pa.StructArray.from_arrays([pa.array(lefts, pa.string()), pa.array(rights, pa.string())], ["left", "right"])
                ends = np.arange(len(nodes) + 1, dtype=np.int32) * (len(inner) + len(path))
                same = pa.array(np.zeros(len(nodes), np.int64))
                yield pa.RecordBatch.from_arrays(
                    [one.column(0).take(same), held.field("place"), held.field("at"), held.field("node"), held.field("also"),
                     pa.ListArray.from_arrays(pa.array(ends), steps), *(c.take(same) for c in one.columns[4:])],
                    names=["tree", "place", "at", "node", "also", "proof", *further])

    kinds = blocks.schema["leaves"].dataType.elementType
    schema = (f"tree string, place long, at {kinds['at'].dataType.simpleString()}, node string, also string, "
              f"proof array<{_STEP}>, ") + ", ".join(f"{c} string" for c in further)
    return blocks.join(upper, ["tree", "block"]).select("tree", "blocks", "leaves", "path", *further).mapInArrow(
        open_blocks, schema)


def merkle_manifest(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
                    by: str = "lang", order: str = "doc_id", also: Column | None = None,
                    fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """``doc_id, lang, place, leaf, also, subroot, root, proof``: one row per row of ``docs``.

    ``columns`` are hashed; rows with the same ``by`` make one tree, in order of ``order`` (null first) and
    of the leaf where that ties, so repeated rows are leaves of their own. A null ``by`` is a tree of its
    own, before all others. ``proof`` leads from the leaf to ``root`` over ``subroot``. ``also`` is any text
    of a row that is carried along. Nulls and empty texts differ in their hash. Other columns are ignored;
    no rows in, no rows out.
    """
    carried = F.lit(None).cast("string") if also is None else also
    rows = docs.select(field(F.col(by)).alias("tree"), F.col(order).alias("at"), leaf_of(*map(F.col, columns)).alias("node"),
                       carried.alias("also"))
    blocks, upper = _forest(written(rows, "hashed"), fanout, depth)
    name = F.when(F.col("tree") != _NO_TREE, F.expr("substring(tree, instr(tree, ':') + 1)"))
    # the trees' roots are few where trees are large; the same blocks and rounds serve where they are not
    roots = upper.filter("block = 0").select(
        F.lit("").alias("tree"), name.alias("at"), F.col("root").alias("node"), F.col("tree").alias("also"))
    top_blocks, top_upper = _forest(roots, fanout, depth)
    top = written(_with_proofs(top_blocks, top_upper, fanout, depth).select(
        F.col("also").alias("tree"), F.col("proof").alias("further"), F.col("root").alias("whole")), "top")
    sizes = upper.groupBy("tree").agg(F.count("*").alias("n"))
    above = hot_join(upper.withColumnRenamed("root", "subroot"), top.join(sizes, "tree"), "tree", "n", F.col("block"), upper.count())
    paths = above.select("tree", "block", F.concat("path", "further").alias("path"), "subroot", F.col("whole").alias("root"))
    return _with_proofs(blocks.select("tree", "block", "blocks", "leaves"), paths, fanout, depth).select(
        F.col("at").alias(order), name.alias(by), "place", F.col("node").alias("leaf"), "also", "subroot", "root", "proof")
