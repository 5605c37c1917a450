"""Near-dedup by MinHash with a signature-coordinate inverted join, confirmed on full shingle sets.

1. Each text gives its set of hashed five-word shingles and a signature of ``COORDINATES`` minima. Texts
   with the same set are one node from here on, however many copies there are.
2. Nodes are posted under (coordinate, value). Values that only one node has cannot collide; a node with
   fewer than ``MATCHES`` other values is skipped. Of the rest, only the prefix is posted: the rarest
   values, so many that two nodes with ``MATCHES`` collisions must meet in one of them.
3. Within a posting list, collisions of whole signatures are counted. A pair with at least ``MATCHES`` is
   a candidate in one list only, that of its first common value. Long lists are dealt into blocks, and
   pairs of blocks are separate work, so no task gets a whole hot list.
4. The sets of candidates are fetched once, and each block of a list counts exact overlaps, leaving out
   pairs that it has already joined. What leaves a block is a star for each group that its links join.
5. Links are closed to components by passing on the smallest label and jumping along labels.

Two texts at the threshold collide in 0.75 of the coordinates on average; fewer than ``MATCHES`` of
``COORDINATES`` happens to about one such pair in five million, and to closer pairs far less often.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starpath.llm.common import bit_of, bitmap, has_bit, hot_join, text_column, utf8, written
from starpath.llm.shingles import SHINGLE, shingle_set

COORDINATES = 48
MATCHES = 20
#: A link needs 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Nodes of one block of a posting list.
BLOCK = 256

_random = np.random.default_rng(20_240_229)
_FACTORS = _random.integers(1, 1 << 62, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _random.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """One number per coordinate: the coordinate above the 32 bits of its least hash."""
    least = np.full(COORDINATES, np.uint64(2**64 - 1), np.uint64)
    for at in range(0, len(shingles), 4096):
        np.minimum(least, (shingles[at:at + 4096, None] * _FACTORS + _SHIFTS).min(0), out=least)
    return ((np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32)) | (least >> np.uint64(32))).astype(np.int64)


def node_of(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def signatures(docs: DataFrame, id_column: str, text: str, words: int) -> DataFrame:
    """``id, text_hash, n_shingles, node, tokens``; texts without words have neither node nor tokens."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, nodes, tokens = [], [], []
            for value in utf8(batch.column(1)):
                found = shingle_set(value, words)
                sizes.append(len(found))
                nodes.append(node_of(found) if len(found) else None)
                tokens.append(signature(found) if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()),
                 pa.array(tokens, pa.list_(pa.int64()))], names=["id", "text_hash", "n_shingles", "node", "tokens"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("id"), text_column(text), F.xxhash64(text_column(text))).mapInArrow(
        sign, f"id {kind}, text_hash long, n_shingles long, node binary, tokens array<long>")


def repeated_tokens(nodes: DataFrame) -> DataFrame:
    """``token, n``: the signature values that several nodes have."""
    return nodes.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")).filter("n > 1")


def posting_lists(nodes: DataFrame, matches: int, block: int) -> DataFrame:
    """``token, n, parts, nodes, tokens, counts``: one row per block, or pair of blocks, of a posting list."""
    repeated = written(repeated_tokens(nodes), "repeated-tokens")
    total = repeated.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    known = bitmap(repeated, bit_of("token"))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            per_row = np.diff(batch.column(1).offsets.to_numpy())
            rows = np.repeat(np.arange(batch.num_rows), per_row)
            hit = has_bit(known, batch.column(2).flatten().to_numpy())
            enough = np.bincount(rows[hit], minlength=batch.num_rows) >= matches
            hit &= enough[rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows[hit])), batch.column(1).flatten().filter(pa.array(hit))],
                names=["node", "token"])

    places = F.transform("tokens", lambda token: bit_of(token))
    posted = nodes.select("node", "tokens", places).mapInArrow(post, "node binary, token long")
    counted = hot_join(posted, repeated, "token", "n", F.col("node"), total).filter("n is not null")
    own = counted.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("own")).filter(
        F.size("own") >= matches)
    prefix = F.slice("own", F.lit(1), F.size("own") - matches + 1)
    lists = own.select(
        "node", F.col("own.token").alias("tokens"), F.col("own.n").alias("counts"), F.explode(prefix).alias("posting")
    ).select("node", "tokens", "counts", "posting.token", "posting.n")
    blocks = F.ceil(F.col("n") / block).cast("int")
    part = F.pmod(F.xxhash64("node"), blocks).cast("int")
    dealt = lists.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    member = F.struct("node", "part", "tokens", "counts")
    return dealt.groupBy(
        "token", "n", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j")
    ).agg(F.collect_list(member).alias("members")).filter(F.size("members") > 1).select(
        F.xxhash64("token", "i", "j").alias("block"), "token", "n", (F.col("i") != F.col("j")).alias("across"),
        F.col("members.node").alias("nodes"), F.col("members.part").alias("parts"),
        F.col("members.tokens").alias("tokens"), F.col("members.counts").alias("counts"))


def candidates(lists: DataFrame, matches: int) -> DataFrame:
    """``block, place, node, partners``: nodes with candidates; partners are places in the block, as u16."""
    def collide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                n = len(row["nodes"])
                values = np.tile(-1 - np.arange(n, dtype=np.int64)[:, None], (1, COORDINATES))
                order = np.zeros((n, COORDINATES), np.int64)
                for r, (tokens, counts) in enumerate(zip(row["tokens"], row["counts"])):
                    tokens = np.array(tokens, np.int64)
                    at = tokens >> 32
                    values[r, at], order[r, at] = tokens, np.array(counts, np.int64) * 64 + at
                here = row["n"] * 64 + (row["token"] >> 32)
                parts = np.array(row["parts"])
                partners: dict[int, np.ndarray] = {}
                for x in range(n - 1):
                    same = values[x + 1:] == values[x]
                    near = same.sum(1) >= matches
                    if row["across"]:
                        near &= parts[x + 1:] != parts[x]
                    near = np.flatnonzero(near)
                    if len(near):
                        first = np.where(same[near], order[x], np.int64(2**62)).min(1)
                        near = near[first == here] + x + 1
                        if len(near):
                            partners[x] = near
                used = sorted(set(partners).union(*(p.tolist() for p in partners.values())))
                out += [(row["block"], x, row["nodes"][x], partners.get(x, np.zeros(0)).astype("<u2").tobytes()) for x in used]
            columns = list(zip(*out)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary()),
                 pa.array(columns[3], pa.binary())], names=["block", "place", "node", "partners"])

    return lists.mapInArrow(collide, "block long, place int, node binary, partners binary")


def full_sets(docs: DataFrame, wanted: DataFrame, id_column: str, text: str, words: int) -> DataFrame:
    """``node, shingles``: the whole sets of the wanted nodes (``node, id`` of one text each), read again."""
    known = bitmap(wanted, bit_of("id"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = pa.array(has_bit(known, batch.column(0).to_numpy()))
            sets = [shingle_set(value, words) for value in utf8(batch.column(1).filter(hit))]
            sets = [s for s in sets if len(s)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([node_of(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                names=["node", "shingles"])

    found = docs.select(bit_of(id_column), text_column(text)).mapInArrow(read, "node binary, shingles binary")
    return found.join(wanted.select("node"), "node").dropDuplicates(["node"])


def links(members: DataFrame, percent: int) -> DataFrame:
    """``a, b``: for what confirmed links join within each block, its least node and each other one."""
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[bytes, bytes]] = []
            for group in batch.column(0).to_pylist():
                sets = {m["place"]: np.frombuffer(m["shingles"], np.uint64) for m in group}
                nodes = {m["place"]: m["node"] for m in group}
                root = {place: place for place in sets}

                def top(x: int) -> int:
                    while root[x] != x:
                        root[x] = root[root[x]]
                        x = root[x]
                    return x

                for member in group:
                    x = member["place"]
                    own = sets[x]
                    for y in np.frombuffer(member["partners"], "<u2").tolist():
                        a, b = top(x), top(y)
                        other = sets[y]
                        small, large = min(len(own), len(other)), max(len(own), len(other))
                        if a == b or 100 * small < percent * large:
                            continue
                        at = np.searchsorted(own, other)
                        at[at == len(own)] = 0
                        common = int((own[at] == other).sum())
                        if 100 * common >= percent * (len(own) + len(other) - common):
                            root[b] = a
                joined: dict[int, list[bytes]] = {}
                for place, node in nodes.items():
                    joined.setdefault(top(place), []).append(node)
                # a star around the least node, so that lists which join the same nodes send the same rows
                for star in joined.values():
                    least = min(star)
                    out += [(least, node) for node in star if node != least]
            yield pa.RecordBatch.from_arrays(
                [pa.array([a for a, _ in out], pa.binary()), pa.array([b for _, b in out], pa.binary())], names=["a", "b"])

    grouped = members.groupBy("block").agg(
        F.collect_list(F.struct("place", "node", "partners", "shingles")).alias("members")).select("members")
    return grouped.mapInArrow(confirm, "a binary, b binary")


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, label``: for every node with a link, the least (id, node) reachable. Edges are read often: hand in a table."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "links")
    own = F.struct("least", "node").alias("label")
    ends = both.select(F.col("a").alias("node")).distinct()
    labels = written(nodes.join(ends, "node", "left_semi").select("node", own), "labels")
    while True:
        heard = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(
            F.min("label").alias("heard"))
        lower = written(labels.join(heard, "node", "left").select(
            "node", F.least("label", "heard").alias("label"), (F.col("heard") < F.col("label")).alias("moved")), "labels")
        if not lower.agg(F.coalesce(F.max("moved"), F.lit(False))).first()[0]:
            return lower.select("node", "label")
        target = lower.select(F.col("node").alias("at"), F.col("label").alias("further"))
        labels = written(lower.join(target, F.col("label.node") == F.col("at"), "left").select(
            "node", F.least("label", "further").alias("label")), "labels")


def near_dedup(docs: DataFrame, id_column: str = "doc_id", text: str = "text", words: int = SHINGLE,
               matches: int = MATCHES, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """``doc_id, text_hash, n_shingles, component_id, kept``: one row per row of ``docs``.

    Words are cut at ASCII white space after lower-casing A-Z; a text with fewer than ``words`` words is
    one shingle. Texts without words, and null texts, link to nothing and stay. ``component_id`` is the
    least id in the component; rows repeated with that id all stay. A null id never is a component's
    least unless the component has no other, and then stays. Other columns are ignored; no rows in, no
    rows out.
    """
    signed = written(signatures(docs, id_column, text, words), "signatures")
    nodes = written(signed.filter("node is not null").groupBy("node").agg(
        F.min("id").alias("least"), F.count("*").alias("copies"), F.first("tokens").alias("tokens")), "nodes")
    pairs = written(candidates(posting_lists(nodes, matches, block), matches), "candidates")
    wanted = pairs.select("node").distinct().join(nodes.select("node", F.col("least").alias("id")), "node")
    wanted = written(wanted, "wanted")
    sets = full_sets(docs, wanted, id_column, text, words)
    found = written(links(pairs.join(sets, "node"), percent), "found-links")
    labels = components(found, nodes)
    classes = written(nodes.join(labels, "node", "left").select(
        "node", "copies", F.coalesce("label.least", "least").alias("component_id")), "classes")
    total = classes.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    own = ["id", "text_hash", "n_shingles"]
    linked = hot_join(signed.filter("node is not null").select(*own, "node"), classes, "node", "copies", F.col("id"), total)
    alone = signed.filter("node is null").select(*own, F.col("id").alias("component_id"))
    return linked.select(*own, "component_id").union(alone).select(
        F.col("id").alias(id_column), "text_hash", "n_shingles", "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def without_near_copies(docs: DataFrame, id_column: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that ``near_dedup`` keeps, unchanged."""
    kept = near_dedup(docs, id_column, text, **options).filter("kept").select(
        F.col(id_column).alias("_id"), F.col("text_hash").alias("_kept_hash")).distinct()
    return docs.withColumn("_hash", F.xxhash64(text_column(text))).join(
        kept, F.col(id_column).eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_kept_hash")), "left_semi").drop("_hash")
