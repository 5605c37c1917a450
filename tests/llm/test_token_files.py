from __future__ import annotations

import numpy as np
import pytest
import zstandard

from starpath.llm.token_files import Reader, Writer, token_files
from starpath.llm.tokens import Coder, tokenizer_file
from tests.llm.helpers import ODD, documents, prose


def reader(data):
    reads = []

    def read_at(offset, size):
        reads.append((offset, size))
        return data[offset:offset + size]

    return Reader(read_at, len(data)), reads


def sample(count=200):
    out = Writer(frame_bytes=2000)
    docs = [(k * 3, np.arange(k % 90, dtype="<u4").tobytes()) for k in range(count)]
    for key, ids in docs:
        out.add(key, ids)
    return docs, out.finish()


def test_round_trip_and_only_needed_frames():
    docs, data = sample()
    file, reads = reader(data)
    assert list(file.documents()) == docs
    del reads[:]
    assert list(file.documents([5, 150])) == [docs[5], docs[150]]
    assert len(reads) == 2 and sum(size for _, size in reads) < len(data) / 4


def test_plain_zstandard_reads_it():
    docs, data = sample()
    unpacked = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    assert unpacked == b"".join(ids for _, ids in docs)


def test_damage_is_found():
    _, data = sample()
    for place in (50, len(data) - 30):
        broken = bytearray(data)
        broken[place] ^= 255
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(reader(bytes(broken))[0].documents())


def test_spark_round_trip(spark):
    texts = ODD + [prose(k, 300) for k in range(25)]
    rows = [(900 - 2 * k, t) for k, t in enumerate(texts)]
    coder = Coder(tokenizer_file("word_bpe_49k.json"))
    got = sorted(token_files(documents(spark, rows, extra=True), frame_bytes=3000, file_bytes=12_000).collect(), key=lambda r: r.doc_id)
    at = 0
    for (key, text), row in zip(sorted(rows), got, strict=True):
        ids = np.append(np.frombuffer(coder.plain(text) if text else b"", "<u4"), 1).astype("<u4")
        assert (row.doc_id, row.start, row.ids) == (key, at, ids.tobytes())
        at += len(ids)
    assert len({r.path for r in got}) > 1
    assert token_files(documents(spark, [])).count() == 0
    assert token_files(documents(spark, [(1, "a"), (1, "a"), (None, "b")])).count() == 3
