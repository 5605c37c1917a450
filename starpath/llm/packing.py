"""Best-fit packing of tokenised documents into sequences by best-two-fit.

A document longer than a sequence is cut; all its pieces but the first are whole sequences by themselves.
Pieces are dealt by a hash into groups of about ``GROUP_BYTES`` of text (a byte gives one token at most,
so the bound on a group's memory holds for any text). Each group is packed in one task, and its last,
partly filled sequence is all that grouping costs. The ids move once, as 16-bit numbers.

Best-two-fit: a sequence is filled greedily with the longest pieces that fit. When none fits any more and
room is left, its shortest piece is taken out if two pieces not yet packed fill the wider gap better.
Only lengths matter for this, so a group keeps a count per length, and pieces of one length are alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starpath.llm.common import chunks, text_column
from starpath.llm.tokens import by_size, encoder, tokenizer_file

CAPACITY = 2048
END_ID = 0
GROUP_BYTES = 4_000_000
#: Sequence numbers of a group start at the group's number times this.
GROUP_STRIDE = 1 << 32
#: Prime step from the group of one piece of a document to that of the next.
PIECE_STEP = 1_000_003


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """``bin, offset`` of each length (1 to ``capacity``), packed by best-two-fit."""
    order = np.argsort(lengths, kind="stable")
    counts = np.bincount(lengths, minlength=capacity + 1)
    next_of = np.concatenate([[0], np.cumsum(counts)])[:capacity + 1]
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    #: For each length, the longest available one that is no longer; kept up by path halving.
    down = np.where(counts > 0, np.arange(capacity + 1), np.arange(capacity + 1) - 1)
    down[0] = 0
    down = down.tolist()

    def longest(most: int) -> int:
        while down[most] != most:
            down[most] = down[down[most]]
            most = down[most]
        return most

    def take(length: int) -> None:
        counts[length] -= 1
        if not counts[length]:
            down[length] = length - 1

    def two_for(gap: int) -> tuple[int, int] | None:
        """The two available lengths with the largest sum up to ``gap``."""
        open_ones = np.flatnonzero(counts[:gap])
        if not len(open_ones):
            return None
        mates = np.searchsorted(open_ones, gap - open_ones, side="right") - 1
        mate = np.where(mates >= 0, open_ones[np.maximum(mates, 0)], 0)
        # a length that is there once cannot be its own mate; the next shorter one is
        own = (mate == open_ones) & (counts[open_ones] < 2)
        mate = np.where(own, np.where(mates > 0, open_ones[np.maximum(mates - 1, 0)], 0), mate)
        sums = np.where(mate > 0, open_ones + mate, 0)
        best = int(np.argmax(sums))
        return (int(open_ones[best]), int(mate[best])) if sums[best] else None

    number = 0
    while True:
        length = longest(capacity)
        if not length:
            break
        held, gap = [], capacity
        while length:
            take(length)
            held.append(length)
            gap -= length
            length = longest(gap) if gap else 0
        if gap:
            pair = two_for(gap + held[-1])
            if pair and sum(pair) > held[-1]:
                out = held.pop()
                counts[out] += 1
                down[out] = out
                for length in pair:
                    take(length)
                    held.append(length)
        at = 0
        for length in held:
            row = order[next_of[length]]
            next_of[length] += 1
            bins[row], offsets[row] = number, at
            at += length
        number += 1
    return bins, offsets


PIECES = "id {id}, piece int, start long, ids binary, bucket long"


def pieces(docs: DataFrame, tokenizer: str, end_id: int = END_ID, capacity: int = CAPACITY, groups: int = 1,
           id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, piece, start, ids, bucket``: the pieces and their packing groups; ids as ``wide`` reads them.

    The first piece of a document may be shorter than the others.
    """
    encode = encoder(tokenizer)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 500):
            keys, rows = batch.column(0), batch.column(2).to_numpy()
            at = 0
            for texts in by_size(batch.column(1).to_pylist()):
                source, piece, start, data = [], [], [], []
                for k, ids in enumerate(encode(texts)):
                    ids = np.append(np.frombuffer(ids, "<u4"), np.uint32(end_id)).astype("<u4")
                    cuts = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
                    narrow = ids.astype("<u2") if len(ids) and ids.max() < 1 << 16 else ids
                    for number, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        source.append(at + k)
                        piece.append(number)
                        start.append(a)
                        data.append((b"2" if narrow is not ids else b"4") + narrow[a:b].tobytes())
                at += len(texts)
                source, number = np.array(source, np.int64), np.array(piece, np.int64)
                bucket = (rows[source] + number * PIECE_STEP) % groups
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(source)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(data, pa.binary()), pa.array(bucket)],
                    names=["id", "piece", "start", "ids", "bucket"])

    kind = docs.schema[id_column].dataType.simpleString()
    row = F.shiftrightunsigned(F.xxhash64(id_column, text), 20)
    return docs.select(F.col(id_column), text_column(text), row).mapInArrow(cut, PIECES.format(id=kind))


def wide(ids: bytes) -> np.ndarray:
    """Ids of a piece as unsigned 32-bit numbers."""
    return np.frombuffer(ids, "<u2" if ids[:1] == b"2" else "<u4", offset=1).astype("<u4")


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY,
         group_bytes: int = GROUP_BYTES, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids, sequence_id, offset``: all documents as pieces of sequences.

    ``ids`` holds the piece's ids as little-endian unsigned 32-bit numbers, the last piece ends with
    ``end_id``. A null or empty text is that one id. Repeated rows are packed as often as they occur;
    null ids are allowed; other columns are ignored. No rows in, no rows out.
    """
    tokenizer = tokenizer or tokenizer_file("byte_bpe_50k.json")
    size = F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)) + 1
    total = docs.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    groups = max(1, -(-total // group_bytes))
    cut_up = pieces(docs, tokenizer, end_id, capacity, groups, id_column, text)
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids binary, sequence_id long, offset long"

    def packed(group: pa.Table) -> pa.Table:
        group = group.sort_by([("ids", "ascending"), ("id", "ascending"), ("piece", "ascending")])
        number = group.column("bucket")[0].as_py()
        ids = group.column("ids").to_pylist()
        lengths = np.array([(len(x) - 1) // int(x[:1]) for x in ids], np.int64)
        bins, offsets = pack_lengths(lengths, capacity)
        return pa.table(
            [group.column("id"), group.column("piece"), group.column("start"), pa.array(lengths),
             pa.array([wide(x).tobytes() for x in ids], pa.binary()), pa.array(number * GROUP_STRIDE + bins),
             pa.array(offsets)], names=["id", "piece", "start", "length", "ids", "sequence_id", "offset"])

    return cut_up.groupBy("bucket").applyInArrow(packed, schema).withColumnRenamed("id", id_column)
