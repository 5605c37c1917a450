"""Token files: independent zstandard frames, a trailing seek table and a checksum per frame.

A file holds the ids of consecutive documents. Its frames are ordinary zstandard frames, each with whole
documents: the little-endian unsigned 32-bit ids, one document after the other. The seek table is a
skippable frame at the end, so that any zstandard reader can unpack the file as one stream of ids:

    u32 0x184D2A5E, u32 size of what follows
    the index, zstandard-compressed: per document i64 id, u32 ids; documents in file order
    per frame: u32 compressed bytes, u32 unpacked bytes, u32 documents, u64 XXH64 of the unpacked bytes
    u64 XXH64 of the index and the frame entries, u32 bytes of the index, u32 frames, u32 0x53544B31

All numbers are little-endian. A reader takes the last bytes, then the table, then only the frames that
hold the requested documents, and checks each frame against its checksum.

Files are written by tasks to the shared folder through Arrow's file systems, under a name of their own
for each attempt; a row per finished file is all that counts, so a task that runs twice leaves a file
nobody lists.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from starpath.llm.common import chunks, new_folder, text_column, written
from starpath.llm.tokens import by_size, encoder, tokenizer_file

END_ID = 1
#: Unpacked bytes after which a frame, or a file, is closed.
FRAME_BYTES = 256 << 10
FILE_BYTES = 8 << 20
SKIPPABLE, MAGIC = 0x184D2A5E, 0x53544B31
_ENTRY, _TAIL = struct.Struct("<IIIQ"), struct.Struct("<QIII")


class Writer:
    """Collects documents of one file; ``finish`` gives the file's bytes."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self.frame_bytes, self.packer = frame_bytes, zstandard.ZstdCompressor(level=level)
        self.ids: list[int] = []
        self.sizes: list[int] = []
        self.frames: list[bytes] = []
        self.entries: list[bytes] = []
        self.open: list[bytes] = []
        self.open_bytes = self.unpacked = 0

    def add(self, doc_id: int, tokens: bytes) -> None:
        self.ids.append(doc_id)
        self.sizes.append(len(tokens) // 4)
        self.open.append(tokens)
        self.open_bytes += len(tokens)
        self.unpacked += len(tokens)
        if self.open_bytes >= self.frame_bytes:
            self._close()

    def _close(self) -> None:
        if self.open:
            data = b"".join(self.open)
            packed = self.packer.compress(data)
            self.frames.append(packed)
            self.entries.append(_ENTRY.pack(len(packed), len(data), len(self.open), xxhash.xxh64_intdigest(data)))
            self.open, self.open_bytes = [], 0

    def finish(self) -> bytes:
        self._close()
        index = np.zeros(len(self.ids), [("id", "<i8"), ("size", "<u4")])
        index["id"], index["size"] = self.ids, self.sizes
        packed = self.packer.compress(index.tobytes())
        body = packed + b"".join(self.entries)
        table = body + _TAIL.pack(xxhash.xxh64_intdigest(body), len(packed), len(self.entries), MAGIC)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE, len(table)) + table


class Reader:
    """Random access to a token file through ``read_at(offset, size)``."""

    def __init__(self, read_at, size: int):
        self.read_at = read_at
        total, index_bytes, frames, magic = _TAIL.unpack(read_at(size - _TAIL.size, _TAIL.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        length = index_bytes + frames * _ENTRY.size
        body = read_at(size - _TAIL.size - length, length)
        if xxhash.xxh64_intdigest(body) != total:
            raise ValueError("the seek table is damaged")
        index = zstandard.ZstdDecompressor().decompress(body[:index_bytes])
        self.index = np.frombuffer(index, [("id", "<i8"), ("size", "<u4")])
        entries = [_ENTRY.unpack_from(body, index_bytes + k * _ENTRY.size) for k in range(frames)]
        self.entries = entries
        self.places = np.cumsum([0] + [e[0] for e in entries])
        self.first_doc = np.cumsum([0] + [e[2] for e in entries])

    def frame(self, number: int) -> bytes:
        packed, size, _, check = self.entries[number]
        data = zstandard.ZstdDecompressor().decompress(
            self.read_at(int(self.places[number]), packed), max_output_size=max(size, 1))
        if len(data) != size or xxhash.xxh64_intdigest(data) != check:
            raise ValueError(f"frame {number} is damaged")
        return data

    def documents(self, numbers: Iterable[int] | None = None) -> Iterator[tuple[int, bytes]]:
        """``doc_id, ids`` of the documents at these places (all if None), unpacking only their frames."""
        wanted = range(len(self.index)) if numbers is None else sorted(numbers)
        at, data, offsets = -1, b"", None
        for number in wanted:
            frame = int(np.searchsorted(self.first_doc, number, side="right")) - 1
            if frame != at:
                at, data = frame, self.frame(frame)
                sizes = self.index["size"][self.first_doc[frame]:self.first_doc[frame + 1]].astype(np.int64) * 4
                offsets = np.concatenate([[0], np.cumsum(sizes)])
            k = number - int(self.first_doc[frame])
            yield int(self.index["id"][number]), data[offsets[k]:offsets[k + 1]]


def open_file(uri: str) -> Reader:
    """A reader of one file in the shared folder, for a few documents of it."""
    store, path = fs.FileSystem.from_uri(uri)
    source = store.open_input_file(path)

    def read_at(offset: int, size: int) -> bytes:
        source.seek(offset)
        return source.read(size)

    return Reader(read_at, source.size())


FILES = "path string, task long, number long, documents long, tokens long"


def write_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, frame_bytes: int = FRAME_BYTES,
                file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encodes ``doc_id, text`` and writes token files in ascending id order; one row per file, written down."""
    encode, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base)

        task, number = TaskContext.get().partitionId(), 0

        def close(out: Writer) -> pa.RecordBatch:
            nonlocal number
            name = f"{uuid.uuid4().hex}.tokens"
            with store.open_output_stream(f"{base}/{name}") as target:
                target.write(out.finish())
            number += 1
            counts = [task, number, len(out.ids), sum(out.sizes)]
            return pa.RecordBatch.from_arrays(
                [pa.array([name])] + [pa.array([v], pa.int64()) for v in counts],
                names=["path", "task", "number", "documents", "tokens"])

        out = Writer(frame_bytes)
        for batch in chunks(batches, 500):
            keys, at = batch.column(0).to_pylist(), 0
            for texts in by_size(batch.column(1).to_pylist()):
                for k, ids in enumerate(encode(texts)):
                    out.add(keys[at + k], ids + end)
                    if out.unpacked >= file_bytes:
                        yield close(out)
                        out = Writer(frame_bytes)
                at += len(texts)
        if out.ids:
            yield close(out)

    # equal ids are ordered by text; the row number lets even one row repeated often be dealt to many tasks
    numbered = docs.select("doc_id", text_column().alias("text"), F.monotonically_increasing_id().alias("row"))
    order = ["doc_id", F.xxhash64("text"), "row"]
    files = numbered.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(
        write, FILES)
    return written(files, "token-file-list")


def read_files(files: DataFrame, folder: str) -> DataFrame:
    """``doc_id, start, ids, path``: every document of the listed files, one task per file.

    ``files`` has ``path`` and ``file_start``, the ids in all files before.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, file_start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                reader = open_file(f"{folder}/{path}")
                sizes = reader.index["size"].astype(np.int64)
                start = file_start + np.cumsum(sizes) - sizes
                for first in range(0, len(sizes), 500):
                    last = min(first + 500, len(sizes))
                    rows = list(reader.documents(range(first, last)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r[0] for r in rows], pa.int64()), pa.array(start[first:last]),
                         pa.array([r[1] for r in rows], pa.binary()), pa.array([path] * len(rows))],
                        names=["doc_id", "start", "ids", "path"])

    return files.select("path", "file_start").repartition(max(files.count(), 1), "path").mapInArrow(
        read, "doc_id long, start long, ids binary, path string")


def token_files(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, folder: str | None = None,
                frame_bytes: int = FRAME_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """``doc_id, start, ids, path``: writes all documents as token files and reads them back.

    ``start`` counts the ids of all documents before, in ascending id order; ``ids`` are little-endian
    unsigned 32-bit numbers with ``end_id`` last. A null or empty text is that one id. Rows with the same
    id follow each other by text hash. Ids must be whole numbers; a null id counts as the smallest.
    Other columns are ignored. No rows in, no files and no rows out.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(docs, "tokens")
    smallest = F.lit(-(1 << 63)).cast("long")
    named = docs.select(F.coalesce(F.col("doc_id").cast("long"), smallest).alias("doc_id"), "text")
    files = write_files(named, folder, tokenizer or tokenizer_file("word_bpe_49k.json"), end_id, frame_bytes, file_bytes)
    if not files.head(1):
        return spark.createDataFrame([], "doc_id long, start long, ids binary, path string")
    before = W.orderBy("task", "number").rowsBetween(W.unboundedPreceding, -1)
    starts = files.select("path", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("file_start"))
    return read_files(starts, folder)
