"""Source divergence audit: how far the vocabulary of each source is from the other sources of its language.

A document belongs to the group of its language and source. Each language keeps the terms that are in at
least ``LEAST_DOCS`` of its documents, and each group and each language gives each kept term a smoothed whole
number ``p = 1 + floor(SCALE * (count + 1) / (N + V))``. A term moves a group away from a reference by
``floor((p - q)^2 / q)``.

Counts. Tasks count the terms of each group, which then meet by language and term, once. What is left of a
kept term is its profile: the counts of the groups that have it.

Terms of a group, by dominance skyband. A term's value grows with its count in the group and falls with its
count in the language, and ties go to the earlier term. So a term with at least ``k`` others that have no lower
group count, no higher language count and come earlier is not among the first ``k``. Tasks keep the terms
with fewer such others; what they keep is merged group by group in rounds of ``FAN_IN`` parts, by the same
rule, and only the last skyband is valued and ranked.

Pairs of sources. Kept terms with the same profile are one row with a multiplicity. Most terms are in neither
or one group of a pair; their sum follows from how many terms have which count in a group, so only terms that
both groups have are met pair by pair. All arithmetic is in whole numbers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from starpath.llm.common import hot_join, text_column, utf8, written

LEAST_DOCS = 3
SCALE = 1_000_000_000
TOP = 200
#: Rows a task holds before it sends counts on, or reduces terms to skybands.
HELD_COUNTS, HELD_ROWS = 1_200_000, 200_000
#: Bytes of text whose words are held at once.
PIECE = 1 << 20
#: Parts of a group that are merged into one.
FAN_IN = 16
#: Rows whose dominators are counted at once, and buckets a coordinate is cut into for bounds on their number.
_STEP, _BUCKETS = 256, 64

#: Letters A-Z as a-z, all other ASCII as a blank; what is above ASCII stays.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, some at a time."""
    start = 0
    while start < len(text):
        end = start + PIECE
        while end < len(text) and _FOLD[text[end]] != 32:
            end += 1
        yield text[start:end].translate(_FOLD).split()
        start = end


def _counted(groups: list[int], texts: list[bytes]) -> pa.Table:
    """``group, term, n, docs`` of whole texts."""
    words: list[bytes] = []
    sizes = []
    for text in texts:
        found = text.translate(_FOLD).split()
        words += found
        sizes.append(len(found))
    terms = pa.array(words, pa.binary()).dictionary_encode()
    many = len(terms.dictionary) or 1
    # first per document and term, then per group and term
    pairs, times = np.unique(np.repeat(np.arange(len(texts)), sizes) * many + terms.indices.to_numpy(), return_counts=True)
    keys, places = np.unique(np.array(groups, np.int64)[pairs // many] * many + pairs % many, return_inverse=True)
    return _count_rows(keys // many, terms.dictionary.take(pa.array(keys % many)),
                       np.bincount(places, times, len(keys)).astype(np.int64), np.bincount(places, minlength=len(keys)))


def _counted_long(group: int, text: bytes) -> pa.Table:
    """The same for one very long text, piece by piece."""
    times: Counter[bytes] = Counter()
    for terms in terms_of(text):
        times.update(terms)
    return _count_rows(np.full(len(times), group), pa.array(list(times), pa.binary()),
                       np.fromiter(times.values(), np.int64, len(times)), np.ones(len(times), np.int64))


def _count_rows(groups: np.ndarray, terms: pa.Array, n: np.ndarray, docs: np.ndarray) -> pa.Table:
    return pa.table([pa.array(groups, pa.int64()), terms, pa.array(n), pa.array(docs)], names=["group", "term", "n", "docs"])


def group_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """``lang, source, term, n, docs``: partial counts of each group's terms and of the documents with them."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[tuple[bytes, bytes], int] = {}
        held: list[pa.Table] = []
        groups: list[int] = []
        texts: list[bytes] = []
        size = 0

        def summed() -> pa.Table:
            total = pa.concat_tables(held).group_by(["group", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
            return total.select(["group", "term", "n_sum", "docs_sum"]).rename_columns(["group", "term", "n", "docs"])

        def sent(table: pa.Table) -> Iterator[pa.RecordBatch]:
            own = [pa.array([name[k] for name in names], pa.binary()).cast(pa.string()) for k in range(2)]
            for batch in table.to_batches(50_000):
                yield pa.RecordBatch.from_arrays(
                    [*(column.take(batch.column(0)) for column in own), batch.column(1).cast(pa.string()), *batch.columns[2:]],
                    names=["lang", "source", "term", "n", "docs"])

        def take() -> None:
            held.append(_counted(groups, texts))
            groups.clear()
            texts.clear()

        for batch in batches:
            for language, origin, value in zip(*(utf8(batch.column(k)) for k in range(3))):
                group = names.setdefault((language, origin), len(names))
                if len(value) > PIECE:
                    held.append(_counted_long(group, value))
                else:
                    groups.append(group)
                    texts.append(value)
                    size += len(value) + 64
                    if size > PIECE:
                        take()
                        size = 0
                if sum(table.num_rows for table in held) > HELD_COUNTS:
                    held = [summed()]
                    if held[0].num_rows > HELD_COUNTS // 2:
                        yield from sent(held.pop())
        if texts:
            take()
        if held:
            yield from sent(summed())

    return docs.select(text_column(lang), text_column(source), text_column(text)).mapInArrow(
        count, "lang string, source string, term string, n long, docs long")


def profiles(counts: DataFrame, least_docs: int) -> DataFrame:
    """``lang, term, lang_n, profile``: kept terms; a profile is ``(source, n)`` of the groups that have the term."""
    # one exchange serves both sums, as all rows of a term are together
    summed = counts.repartition("lang", "term").groupBy("lang", "term", "source").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return summed.groupBy("lang", "term").agg(
        F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("profile"),
    ).filter(F.col("docs") >= least_docs).drop("docs")


def skyband(groups: np.ndarray, n: np.ndarray, lang_n: np.ndarray, late: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows with fewer than ``k`` others of their group that dominate them; ``late`` is the rank of the term.

    Rows are met in an order in which those that dominate a row come before it. Of a row's dominators, the
    first ``k`` in that order have fewer than ``k`` themselves, so it is enough to count those kept so far.
    Most rows are settled by bounds: how many kept rows are in lower buckets of both coordinates, and how
    many in no higher ones. The others are compared with all that are kept.
    """
    order = np.lexsort((late, lang_n, -n, groups))
    cuts = np.flatnonzero(np.append(True, groups[order][1:] != groups[order][:-1]))
    return np.concatenate([order[:0], *(own[_few_ahead(lang_n[own], late[own], k)] for own in np.split(order, cuts[1:]))])


def _few_ahead(low: np.ndarray, late: np.ndarray, k: int) -> np.ndarray:
    """Places with fewer than ``k`` earlier places that have no higher ``low`` and a lower ``late``."""
    def buckets(values: np.ndarray) -> np.ndarray:
        ranks = np.unique(values, return_inverse=True)[1]
        return ranks * _BUCKETS // (ranks.max() + 1) if len(ranks) else ranks

    rows, columns = buckets(low), buckets(late)
    cells = np.zeros((_BUCKETS, _BUCKETS), np.int64)
    below = np.zeros((_BUCKETS + 1, _BUCKETS + 1), np.int64)
    earlier = np.tri(_STEP, k=-1, dtype=bool)
    kept, held = [], [low[:0], late[:0]]
    for at in range(0, len(low), _STEP):
        a, b, i, j = (values[at:at + _STEP] for values in (low, late, rows, columns))
        ahead = ((a <= a[:, None]) & (b < b[:, None]) & earlier[:len(a), :len(a)]).sum(1)
        least, most = ahead + below[i, j], ahead + below[i + 1, j + 1]
        open_ = np.flatnonzero((least < k) & (most >= k))
        if len(open_):
            most[open_] = ahead[open_] + ((held[0] <= a[open_, None]) & (held[1] < b[open_, None])).sum(1)
        stays = np.flatnonzero(most < k)
        kept.append(at + stays)
        held = [np.concatenate([held[0], a[stays]]), np.concatenate([held[1], b[stays]])]
        np.add.at(cells, (i[stays], j[stays]), 1)
        below[1:, 1:] = cells.cumsum(0).cumsum(1)
    return np.concatenate(kept) if kept else np.zeros(0, np.int64)


def _reduced(rows: pa.Table, k: int) -> pa.Table:
    langs, sources, terms = (rows[c].combine_chunks() for c in ("lang", "source", "term"))
    names = [column.dictionary_encode().indices.to_numpy().astype(np.int64) for column in (langs, sources)]
    groups = names[0] * (names[1].max(initial=0) + 1) + names[1]
    late = pc.rank(terms.cast(pa.binary()), "ascending", tiebreaker="dense").to_numpy().astype(np.int64)
    return rows.take(pa.array(skyband(groups, rows["n"].to_numpy(), rows["lang_n"].to_numpy(), late, k)))


def skybands(kept: DataFrame, k: int) -> DataFrame:
    """``lang, source, term, n, lang_n``: each group's terms that fewer than ``k`` others dominate, from profiles."""
    schema = "lang string, source string, term string, n long, lang_n long"

    def opened(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(3)
        own = lists.flatten()
        rows = pc.list_parent_indices(lists)
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(rows), own.field("source"), batch.column(1).take(rows), own.field("n"), batch.column(2).take(rows)],
            names=["lang", "source", "term", "n", "lang_n"])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(opened(batch))
            if sum(b.num_rows for b in held) > HELD_ROWS:
                held = _reduced(pa.Table.from_batches(held), k).combine_chunks().to_batches()
                if sum(b.num_rows for b in held) > HELD_ROWS // 2:
                    yield from held
                    held = []
        held = [b for b in held if b.num_rows]
        if held:
            yield from _reduced(pa.Table.from_batches(held), k).to_batches()

    found = written(kept.select("lang", "term", "lang_n", "profile").mapInArrow(keep, schema).withColumn("part", F.spark_partition_id()), "skyband")
    parts = found.agg(F.coalesce(F.max("part"), F.lit(0))).first()[0] + 1
    while True:
        parts = -(-parts // FAN_IN)
        merged = found.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int")).groupBy("lang", "source", "part").applyInArrow(
            lambda rows: _reduced(rows, k), schema + ", part int")
        found = written(merged, "skyband")
        if parts <= 1:
            return found.drop("part")


def _whole(a: Column, b: Column) -> Column:
    """``a / b`` rounded down, for whole numbers from zero on."""
    return F.call_function("div", a, b)


def share(n: Column, total: Column, vocabulary: Column) -> Column:
    """A term's smoothed share of a group in parts of ``SCALE``; null where no term is kept."""
    all_terms = F.nullif(total + vocabulary, F.lit(0))
    wide = F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)")
    # the same number either way; few counts need more than 63 bits
    return 1 + F.when(n < (1 << 62) // SCALE, _whole(SCALE * (n + 1), all_terms)).otherwise(
        _whole(wide, all_terms.cast("decimal(20,0)")))


def moved(p: Column, q: Column) -> Column:
    return _whole((p - q) * (p - q), q)


def audited_groups(docs: DataFrame, kept: DataFrame, lang: str, source: str) -> DataFrame:
    """``lang, source, total, vocabulary, lang_total, none``: every group; ``none`` is the share of a term it lacks."""
    seen = docs.select(text_column(lang).alias("lang"), text_column(source).alias("source")).distinct()
    own = kept.select("lang", F.explode("profile").alias("own")).groupBy("lang", F.col("own.source").alias("source")).agg(
        F.sum("own.n").alias("total"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("vocabulary"), F.sum("lang_n").alias("lang_total"))
    joined = seen.join(own, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    return joined.withColumn("none", share(F.lit(0), F.col("total"), F.col("vocabulary")))


def pair_values(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, item, value``: how far each group is from each other one of its language, over all kept terms."""
    patterns = written(kept.groupBy("lang", "profile").agg(F.count("*").alias("m")), "patterns")
    single = patterns.select("lang", "m", F.explode("profile").alias("own"))
    counts = written(single.groupBy("lang", F.col("own.source").alias("source"), F.col("own.n").alias("n")).agg(
        F.sum("m").alias("m")), "counts")
    # two sources of a profile once, whichever is which; the few rows of their counts then stand for both
    met = patterns.select("lang", "m", "profile", F.posexplode("profile").alias("place", "own")).select(
        "lang", "m", "own", F.explode(F.slice("profile", F.col("place") + 2, F.size("profile"))).alias("other")).groupBy(
        "lang", F.col("own.source").alias("a"), F.col("other.source").alias("b"),
        F.col("own.n").alias("n_a"), F.col("other.n").alias("n_b")).agg(F.sum("m").alias("m"))
    sides = F.array(*[F.struct(F.col(x).alias("source"), F.col(y).alias("item"), F.col(f"n_{x}").alias("n"), F.col(f"n_{y}").alias("other_n"))
                      for x, y in ("ab", "ba")])
    both = met.select("lang", "m", F.explode(sides).alias("side")).select("lang", "m", "side.*")
    others = groups.select("lang", F.col("source").alias("item"), F.col("total").alias("other_total"), F.col("none").alias("other_none"))
    pairs = written(groups.join(others, "lang").filter("source <> item").drop("lang_total"), "pairs")

    p = share(F.col("n"), F.col("total"), F.col("vocabulary"))
    q = share(F.col("other_n"), F.col("other_total"), F.col("vocabulary"))
    p0, q0 = F.col("none"), F.col("other_none")
    neither = moved(p0, q0)

    def summed(rows: DataFrame, value: Column) -> DataFrame:
        wide = F.col("m").cast("decimal(19,0)") * value.cast("decimal(19,0)")
        return rows.groupBy("lang", "source", "item").agg(F.sum(wide.cast("decimal(38,0)")).alias("value"))

    parts = [
        summed(pairs.withColumn("m", F.col("vocabulary")), F.coalesce(neither, F.lit(0))),
        summed(pairs.join(counts, ["lang", "source"]), moved(p, q0) - neither),
        summed(pairs.join(counts.select("lang", F.col("source").alias("item"), F.col("n").alias("other_n"), "m"), ["lang", "item"]),
               moved(p0, q) - neither),
        summed(both.join(pairs, ["lang", "source", "item"]), moved(p, q) - moved(p, q0) - moved(p0, q) + neither),
    ]
    union = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return union.groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))


def term_values(kept: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """``lang, source, item, value``: what may be among each group's first ``top`` terms, its skyband."""
    found = skybands(kept, top)
    sizes = found.groupBy("lang", "source").agg(F.count("*").alias("rows"))
    keyed = written(groups.join(sizes, ["lang", "source"]).select(
        F.struct("lang", "source").alias("key"), "total", "vocabulary", "lang_total", "rows"), "sizes")
    total = keyed.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    met = hot_join(found.withColumn("key", F.struct("lang", "source")), keyed, "key", "rows", F.col("term"), total)
    p = share(F.col("n"), F.col("total"), F.col("vocabulary"))
    q = share(F.col("lang_n"), F.col("lang_total"), F.col("vocabulary"))
    return met.filter(p > q).select("lang", "source", F.col("term").alias("item"), moved(p, q).alias("value"))


def source_divergence(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text",
                      least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank``: other sources (``pair``) and terms (``term``) of each group, farthest first.

    Terms are runs of letters A-Z, lower-cased, and of anything above ASCII. Null languages, sources and
    texts count as empty. A group without terms has a smoothed share of each kept term like any other; in a
    language without kept terms all pairs have the value 0. All pairs are listed, and of each group's terms
    with a larger share than in the language the first ``top``. Ties go to the earlier item in UTF-8. A
    repeated row is a document of its own. Other columns are ignored; no rows in, no rows out.
    """
    kept = written(profiles(group_counts(docs, lang, source, text), least_docs), "profiles")
    groups = written(audited_groups(docs, kept, lang, source), "groups")
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")

    def ranked(values: DataFrame, part: str, most: int | None) -> DataFrame:
        rows = values.withColumn("rank", F.row_number().over(order))
        rows = rows if most is None else rows.filter(F.col("rank") <= most)
        return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")

    return ranked(pair_values(kept, groups), "pair", None).unionByName(ranked(term_values(kept, groups, top), "term", top))
