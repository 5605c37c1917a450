"""Line dedup by a log-template tree: lines that follow one template in many documents are dropped.

The tree has a fixed depth: a line goes to the leaf of its number of words and its first ``DEPTH`` words,
where words with digits count as variable. Within a leaf, lines are compared word by word: a line that
agrees with a template in at least ``SIMILAR`` of its places joins it, and places that differ become
variable; otherwise it starts a template. A template that occurs in at least ``LEAST_DOCS`` documents, or
with more than ``LONG_WORDS`` words in two, is recurring. Its lines stay in the first document that has it and are dropped from all others.

Distinct lines are counted before they meet in a leaf, so a line that a third of all documents have is one
row there. For the comparison a line is kept as one byte of hash per word. Each leaf is grown whole, whatever
its size, so that the templates do not depend on how large the input is; its lines stream through one task
in order, which keeps only the templates' bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starpath.llm.common import binary_rows, chunks, hot_join, text_column, utf8, written
from starpath.llm.shingles import REMEMBERED, mix

DEPTH = 3
SIMILAR = 0.75
LEAST_DOCS = 3
LONG_WORDS = 50
LEAST_WORDS = 3
LEAF_LINES = 2000

_PLACE = np.uint64(0x9E3779B97F4A7C15)


class _Masked(dict):
    """Word to hash; all words with digits have one hash."""

    def __missing__(self, word: bytes) -> int:
        variable = not word.isalpha() and any(48 <= c <= 57 for c in word)
        value = self[word] = xxhash.xxh3_64_intdigest(b"0" if variable else word)
        return value


_masked = _Masked()


def parsed_lines(docs: DataFrame, id_column: str, text: str, least_words: int = LEAST_WORDS, depth: int = DEPTH) -> DataFrame:
    """``id, text_hash, place, leaf, line, first, words``: lines of at least ``least_words`` words.

    ``first`` marks the first of equal lines in a document; ``words`` has a byte per word.
    """
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 500):
            rows, places, sizes, flat = [], [], [], []
            for row, value in enumerate(utf8(batch.column(1))):
                for place, line in enumerate(value.lower().split(b"\n")):
                    words = line.split()
                    if len(words) >= least_words:
                        rows.append(row)
                        places.append(place)
                        sizes.append(len(words))
                        flat += words
            if not rows:
                continue
            if len(_masked) > REMEMBERED:
                _masked.clear()
            hashes = np.fromiter(map(_masked.__getitem__, flat), np.uint64, len(flat))
            size = np.array(sizes, np.int64)
            offsets = np.concatenate([[0], np.cumsum(size)])
            at = np.arange(len(flat)) - np.repeat(offsets[:-1], size)
            spread = mix(hashes + at.astype(np.uint64) * _PLACE)
            line = mix(np.add.reduceat(spread, offsets[:-1]) + size.astype(np.uint64))
            leaf = mix(np.add.reduceat(np.where(at < depth, spread, np.uint64(0)), offsets[:-1]) + size.astype(np.uint64))
            source = np.array(rows, np.int64)
            order = np.lexsort((np.arange(len(line)), line, source))
            first = np.ones(len(line), bool)
            first[order[1:]] = (line[order[1:]] != line[order[:-1]]) | (source[order[1:]] != source[order[:-1]])
            picked = pa.array(source)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(picked), batch.column(2).take(picked), pa.array(places, pa.int32()),
                 pa.array(leaf.view(np.int64)), pa.array(line.view(np.int64)), pa.array(first),
                 binary_rows((hashes >> np.uint64(56)).astype(np.uint8), offsets)],
                names=["id", "text_hash", "place", "leaf", "line", "first", "words"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("id"), text_column(text), F.xxhash64(text_column(text))).mapInArrow(
        parse, f"id {kind}, text_hash long, place int, leaf long, line long, first boolean, words binary")


def templates(lines: DataFrame, id_kind: str, similar: float = SIMILAR, least_docs: int = LEAST_DOCS,
              leaf_lines: int = LEAF_LINES) -> DataFrame:
    """``line, first_id, occurrences``: the lines of recurring templates, from the distinct lines.

    Every leaf is grown whole, whatever its size: its lines arrive in order of ``docs`` descending, then
    ``line``, and a task keeps only the templates' word bytes and members of the leaf it is in.
    ``leaf_lines`` only tells how many lines to emit at a time.
    """
    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        leaf = None
        words = fixed = None
        members: list[list[int]] = []
        rows: list[tuple] = []

        def flush() -> None:
            for found in members:
                docs = sum(rows[i][1] for i in found)
                first = min((rows[i][2] for i in found if rows[i][2] is not None), default=None)
                if docs >= (min(2, least_docs) if words.shape[1] > LONG_WORDS else least_docs):
                    out.extend((rows[i][0], first, rows[i][3]) for i in found)

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
            for at, (key, line, docs, first_id, own, occurrences) in enumerate(zip(*columns)):
                own = np.frombuffer(own, np.uint8)
                if key != leaf or len(own) != words.shape[1]:
                    if leaf is not None:
                        flush()
                    leaf, members, rows = key, [], []
                    words = np.zeros((64, len(own)), np.uint8)
                    fixed = np.zeros((64, len(own)), bool)
                rows.append((line, docs, first_id, occurrences))
                n = len(members)
                if n:
                    agree = ((words[:n] == own) & fixed[:n]).sum(1)
                    best = int(np.argmax(agree))
                    if agree[best] >= similar * len(own):
                        fixed[best] &= words[best] == own
                        members[best].append(len(rows) - 1)
                        continue
                if n == len(words):
                    words = np.concatenate([words, np.zeros_like(words)])
                    fixed = np.concatenate([fixed, np.zeros_like(fixed)])
                words[n], fixed[n] = own, True
                members.append([len(rows) - 1])
            if len(out) >= leaf_lines:
                yield _emitted(out, fields)
                out.clear()
        if leaf is not None:
            flush()
        if out:
            yield _emitted(out, fields)

    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    fields = [pa.field("line", pa.int64()), pa.field("first_id", kinds.get(id_kind, pa.int64())),
              pa.field("occurrences", pa.int64())]
    ordered = lines.select("leaf", "line", "docs", "first_id", "words", "occurrences").repartition("leaf")
    return ordered.sortWithinPartitions("leaf", F.desc("docs"), "line").mapInArrow(
        grow, f"line long, first_id {id_kind}, occurrences long")


def _emitted(out: list[tuple], fields: list[pa.Field]) -> pa.RecordBatch:
    columns = list(zip(*out))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], names=[f.name for f in fields])


def line_dedup(docs: DataFrame, id_column: str = "doc_id", text: str = "text", similar: float = SIMILAR,
               least_docs: int = LEAST_DOCS, least_words: int = LEAST_WORDS, leaf_lines: int = LEAF_LINES) -> DataFrame:
    """The rows of ``docs`` with cleaned text, ``n_lines`` and ``n_dropped``.

    Lines end at a newline; words are cut at ASCII white space, A-Z lower-cased. Lines of fewer than
    ``least_words`` words, so empty ones too, always stay. A document may end up with an empty text, but
    no row goes. Null texts stay null and have no lines. A row that is repeated counts as a document each
    time; its lines stay where its id is the template's least. Columns of ``docs`` that bear a new column's
    name are replaced. No rows in, no rows out.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.drop("n_lines", "n_dropped")
    lines = written(parsed_lines(rows, id_column, text, least_words), "lines")
    distinct = lines.groupBy("leaf", "line").agg(
        F.count_if("first").alias("docs"), F.count("*").alias("occurrences"), F.min("id").alias("first_id"),
        F.min("words").alias("words"))
    distinct = written(distinct, "distinct-lines")
    recurring = written(templates(distinct, kind, similar, least_docs, leaf_lines), "recurring-lines")
    total = recurring.agg(F.coalesce(F.sum("occurrences"), F.lit(0))).first()[0]
    places = hot_join(
        lines.select("id", "text_hash", "place", "line"), recurring.select("line", "first_id", "occurrences"), "line",
        "occurrences", F.struct("id", "place"), total).filter("occurrences is not null and not id <=> first_id")
    per_doc = places.groupBy(F.col("id").alias("_id"), F.col("text_hash").alias("_text_hash")).agg(
        F.collect_set("place").alias("_dropped"))
    columns = rows.columns
    joined = rows.withColumn("_hash", F.xxhash64(text_column(text))).join(
        per_doc, F.col(id_column).eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_text_hash")), "left")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            texts, counts, gone = [], [], []
            for value, dropped in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                parts = [] if value is None else value.split("\n")
                out = set(dropped or ())
                texts.append("\n".join(x for k, x in enumerate(parts) if k not in out) if out else value)
                counts.append(len(parts))
                gone.append(len(out))
            arrays = list(batch.columns[:-1])
            arrays[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(
                [*arrays, pa.array(counts, pa.int64()), pa.array(gone, pa.int64())],
                names=[*columns, "n_lines", "n_dropped"])

    schema = rows.withColumn(text, F.col(text).cast("string")).withColumns(
        {"n_lines": F.lit(0).cast("long"), "n_dropped": F.lit(0).cast("long")}).schema
    return joined.select(*(F.col(c).cast("string") if c == text else F.col(c) for c in columns), "_dropped").mapInArrow(clean, schema)
