"""Benchmark decontamination by spaced seeds.

A seed is the hash of the words at the fixed places of a mask; the places between don't count, so a copy
with some words replaced still shares seeds with its source. The seeds of all test items are joined with
those of all training texts. A bitmap of fixed size of the test seeds sorts out nearly all training seeds
at the scan; what it lets through is joined exactly. Around each hit the two texts are laid side by side
and the longest ungapped stretch is sought of which at most a quarter of the words differ, wherever they are:
it counts if it is long enough.

Every such stretch has a seed. Of 5 words in a row some have at most one that differs, and a mask that leaves
that one out (or four words in a row), but for 8 words of which the middle two differ; the last mask is for
those. Words are cut at white space and ASCII punctuation, in lower case. Items with fewer than ``SHORT``
words are not sought.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starpath.llm.common import BITS, binary_rows, bitmap, has_bit, text_column, written
from starpath.llm.shingles import mix, word_hashes

#: Masks: 1 for a word that counts.
MASKS = ("1111", "11101", "11011", "10111", "111001")
SHORT = 5
#: A stretch must have so many words, or the whole item if that is shorter.
LEAST_WORDS = 12
#: What a differing word costs, in equal words; stretches agree in at least 3 of 4 words.
PENALTY = 3

_TO_BLANK = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))
_SALT = np.uint64(0xD6E8FEB86659FD93)


def words_of(text: str | None) -> np.ndarray:
    return word_hashes((text or "").lower().encode().translate(_TO_BLANK).split())


def seeds(hashes: np.ndarray, masks: tuple[str, ...] = MASKS) -> list[np.ndarray]:
    """For each mask the seed at every place where it fits."""
    out = []
    for number, mask in enumerate(masks):
        count = max(len(hashes) - len(mask) + 1, 0)
        seed = np.full(count, np.uint64(number + 1)) * _SALT
        for k, used in enumerate(mask):
            if used == "1":
                seed = mix(seed + hashes[k:k + count])
        out.append(seed)
    return out


def test_seeds(tests: DataFrame, id_column: str, text: str, masks: tuple[str, ...]) -> DataFrame:
    """``item, seed, place``."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found, places = [], [], []
            for row, value in enumerate(batch.column(1).to_pylist()):
                hashes = words_of(value)
                for seed in seeds(hashes, masks) if len(hashes) >= SHORT else ():
                    rows.append(np.full(len(seed), row))
                    found.append(seed.view(np.int64))
                    places.append(np.arange(len(seed)))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(np.concatenate(rows).astype(np.int64))), pa.array(np.concatenate(found)),
                     pa.array(np.concatenate(places).astype(np.int64))], names=["item", "seed", "place"])

    kind = tests.schema[id_column].dataType.simpleString()
    return tests.select(id_column, F.col(text).cast("string")).mapInArrow(cut, f"item {kind}, seed long, place long")


def test_words(tests: DataFrame, id_column: str, text: str) -> DataFrame:
    """``item, item_words``: 32-bit word hashes."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [words_of(x).astype("<u4").tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.binary())], names=["item", "item_words"])

    kind = tests.schema[id_column].dataType.simpleString()
    return tests.select(id_column, F.col(text).cast("string")).mapInArrow(cut, f"item {kind}, item_words binary")


def seed_hits(docs: DataFrame, known: np.ndarray, id_column: str, text: str, masks: tuple[str, ...]) -> DataFrame:
    """``id, text_hash, seeds, places, words``: documents with seeds in the bitmap, those seeds, and all their word hashes."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found, places, words = [], [], [], []
            for row, value in enumerate(batch.column(1).to_pylist()):
                hashes = words_of(value)
                hit_seeds, hit_places = [], []
                for seed in seeds(hashes, masks):
                    at = np.flatnonzero(has_bit(known, (seed & np.uint64(BITS - 1)).view(np.int64)))
                    if len(at):
                        hit_seeds.append(seed[at].view(np.int64))
                        hit_places.append(at)
                if hit_seeds:
                    rows.append(row)
                    found.append(np.concatenate(hit_seeds))
                    places.append(np.concatenate(hit_places))
                    words.append(hashes.astype("<u4").tobytes())
            picked = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(picked), batch.column(2).take(picked), pa.array(found, pa.list_(pa.int64())),
                 pa.array(places, pa.list_(pa.int64())), pa.array(words, pa.binary())],
                names=["id", "text_hash", "seeds", "places", "words"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, F.col(text).cast("string"), F.xxhash64(text_column(text))).mapInArrow(
        scan, f"id {kind}, text_hash long, seeds array<long>, places array<long>, words binary")


def best_stretch(same: np.ndarray, penalty: int = PENALTY) -> tuple[int, int]:
    """``start, end`` of the stretch with the most equal words less ``penalty`` per differing one."""
    total = np.concatenate([[0], np.cumsum(np.where(same, 1, -penalty))])
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    start = int(np.argmax(total[:end + 1] == low[end]))
    return start, end


def longest_stretch(same: np.ndarray, penalty: int = PENALTY) -> tuple[int, int]:
    """``start, end`` of the longest stretch whose equal words outweigh ``penalty`` times its differing ones, or equal that."""
    total = np.concatenate([[0], np.cumsum(np.where(same, 1, -penalty))])
    starts = np.searchsorted(-np.minimum.accumulate(total), -total)
    end = int(np.argmax(np.arange(len(total)) - starts))
    return int(starts[end]), end


def overlaps(docs: DataFrame, tests: DataFrame, id_column: str = "doc_id", text: str = "text",
             test_id: str = "item_id", test_text: str = "text", masks: tuple[str, ...] = MASKS,
             least_words: int = LEAST_WORDS) -> DataFrame:
    """``doc_id, text_hash, item_id, doc_start, item_start, n_words, n_equal``: the longest stretch per text and item.

    Starts count words. Null and empty texts overlap with nothing, as do items of fewer than ``SHORT``
    words. Rows repeated with equal id and text, and items repeated with equal id, give one row per pair.
    Null ids are kept as such. Other columns are ignored; an empty table on either side gives no rows.
    """
    known_seeds = written(test_seeds(tests, test_id, test_text, masks).distinct(), "test-seeds")
    known = bitmap(known_seeds, F.col("seed").bitwiseAND(F.lit(BITS - 1)))
    hits = written(seed_hits(docs, known, id_column, text, masks), "seed-hits")
    key = ["id", "text_hash"]
    single = hits.select(*key, F.explode(F.arrays_zip("seeds", "places")).alias("hit")).select(
        *key, F.col("hit.seeds").alias("seed"), F.col("hit.places").alias("doc_place"))
    pairs = written(single.join(known_seeds, "seed").select(
        *key, "item", (F.col("doc_place") - F.col("place")).alias("shift")).distinct(), "seed-pairs")
    doc_words = hits.select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash"), "words").dropDuplicates(["_id", "_hash"])
    items = test_words(tests, test_id, test_text).dropDuplicates(["item"])
    laid = pairs.join(doc_words, F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))).join(
        items.withColumnRenamed("item", "_item"), F.col("item").eqNullSafe(F.col("_item"))).select(
        *key, "item", "shift", "words", "item_words")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, values = [], []
            for row, (shift, mine, item) in enumerate(zip(*(batch.column(c).to_pylist() for c in (3, 4, 5)))):
                mine, item = np.frombuffer(mine, "<u4"), np.frombuffer(item, "<u4")
                first, last = max(0, -shift), min(len(item), len(mine) - shift)
                same = item[first:last] == mine[first + shift:last + shift]
                start, end = longest_stretch(same)
                if end - start >= min(len(item), least_words):
                    rows.append(row)
                    values.append((first + start + shift, first + start, end - start, int(same[start:end].sum())))
            columns = list(zip(*values)) or [[]] * 4
            picked = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(picked) for c in range(3)), *(pa.array(c, pa.int64()) for c in columns)],
                names=["id", "text_hash", "item", "doc_start", "item_start", "n_words", "n_equal"])

    kinds = docs.schema[id_column].dataType.simpleString(), tests.schema[test_id].dataType.simpleString()
    found = laid.mapInArrow(verify, f"id {kinds[0]}, text_hash long, item {kinds[1]}, doc_start long, item_start long, "
                                    "n_words long, n_equal long")
    measures = ["n_equal", "n_words", "doc_start", "item_start"]
    best = found.groupBy("id", "text_hash", "item").agg(F.max(F.struct(*measures)).alias("best"))
    return best.select(F.col("id").alias(id_column), "text_hash", F.col("item").alias(test_id),
                       *(f"best.{m}" for m in ("doc_start", "item_start", "n_words", "n_equal")))


def decontaminated(docs: DataFrame, tests: DataFrame, id_column: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that overlap with no test item, unchanged."""
    bad = overlaps(docs, tests, id_column, text, **options).select(
        F.col(id_column).alias("_id"), F.col("text_hash").alias("_bad_hash")).distinct()
    return docs.withColumn("_hash", F.xxhash64(text_column(text))).join(
        bad, F.col(id_column).eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_bad_hash")), "left_anti").drop("_hash")
