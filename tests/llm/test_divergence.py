from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from starpath.llm import divergence
from starpath.llm.divergence import skyband, source_divergence, terms_of
from tests.llm.helpers import ODD, SCHEMA

_TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, top=200):
    docs = [(lang or "", source or "", [t.translate(_LOWER) for t in _TERM.findall(text or "")]) for _, text, lang, source, _ in rows]
    groups, langs, spread = {}, {}, {}
    for lang, source, terms in docs:
        groups.setdefault((lang, source), Counter()).update(terms)
        langs.setdefault(lang, Counter()).update(terms)
        spread.setdefault(lang, Counter()).update(set(terms))
    kept = {lang: [t for t, n in spread[lang].items() if n >= 3] for lang in langs}

    def shares(counts, lang):
        total = sum(counts[t] for t in kept[lang]) + len(kept[lang])
        return {t: 1 + 10**9 * (counts[t] + 1) // total for t in kept[lang]}

    out = []
    for (lang, source), counts in groups.items():
        p, q = shares(counts, lang), shares(langs[lang], lang)
        pairs = [(other, sum((p[t] - o) ** 2 // o for t, o in shares(groups[lang, other], lang).items()))
                 for at, other in groups if at == lang and other != source]
        terms = [(t, (p[t] - q[t]) ** 2 // q[t]) for t in kept[lang] if counts[t] and p[t] > q[t]]
        for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
            found.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, rank) for rank, (item, value) in enumerate(found[:most], 1)]
    return sorted(out)


def found(frame):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in frame.collect())


def made(seed, size=400):
    draw = random.Random(seed)
    words = [f"{a}{b}" for a in ("ka", "Lo", "mé", "zu", "漢", "Ti", "ra", "no") for b in ("n", "r", "s", "", "ß", "ll", "é", "X")]
    rows = []
    for k in range(size):
        text = " ".join(words[int(draw.paretovariate(0.7)) % len(words)] + draw.choice(["", ",", "7", "_x"]) for _ in range(draw.randrange(25)))
        source = "hot" if k % 3 == 0 else draw.choice(["s1", "s2", "", None, "é", "lone" if k == 100 else "s3"])
        rows.append((k, text, draw.choice(["en", "en", "fr", "", None]), source, len(text)))
    return rows + [(None, text, "odd", f"s{k % 3}", 0) for k, text in enumerate(ODD)] + [
        (1, "zz", "rare", "a", 1), (2, "yy", "rare", "b", 1), (3, None, "none", "a", 1), (4, "x y z", "single", "a", None),
        (5, "x y", "single", "a", None), (5, "x y", "single", "a", None)]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS term", "1 AS n", "2 AS item", "3 AS part", "4 AS total", "5 AS profile")


@pytest.mark.parametrize("seed, parts", [(1, 1), (2, 40)])
def test_against_all_terms(spark, seed, parts):
    rows = made(seed)
    assert found(source_divergence(frame(spark, rows).repartition(parts))) == brute(rows)


@pytest.mark.parametrize("top", [1, 5])
def test_few_ranks_with_many_parts_and_small_batches(spark, monkeypatch, top):
    monkeypatch.setattr(divergence, "FAN_IN", 2)
    monkeypatch.setattr(divergence, "HELD_ROWS", 30)
    monkeypatch.setattr(divergence, "HELD_COUNTS", 20)
    monkeypatch.setattr(divergence, "PIECE", 60)
    rows = made(3)
    assert found(source_divergence(frame(spark, rows).repartition(9), top=top)) == brute(rows, top)


def test_skyband_keeps_those_with_few_dominators():
    draw = np.random.default_rng(4)
    for size, k, most in ((1, 1, 5), (900, 1, 12), (900, 3, 2), (2500, 20, 12), (2500, 200, 900), (3000, 7, 1)):
        groups, n, lang_n = draw.integers(0, 2, size), draw.integers(1, most + 1, size), draw.integers(3, 3 * most + 4, size)
        late = draw.permutation(size)
        ahead = ((groups == groups[:, None]) & (n >= n[:, None]) & (lang_n <= lang_n[:, None]) & (late < late[:, None])).sum(1)
        assert sorted(skyband(groups, n, lang_n, late, k)) == np.flatnonzero(ahead < k).tolist()


def test_terms_in_pieces(monkeypatch):
    text = "Ab1cD éÉ__x漢字 " * 50
    whole = [t for part in terms_of(text.encode()) for t in part]
    assert whole == [t.translate(_LOWER).encode() for t in _TERM.findall(text)]
    for piece in (1, 5, 64):
        monkeypatch.setattr(divergence, "PIECE", piece)
        assert [t for part in terms_of(text.encode()) for t in part] == whole


def test_one_long_text_among_short_ones(spark):
    rows = [(0, "alpha beta " * 60_000 + "gamma", "en", "a", 1)] + [(k, "gamma alpha", "en", "b", 1) for k in range(1, 200)]
    assert found(source_divergence(frame(spark, rows))) == brute(rows)


def test_empty(spark):
    assert source_divergence(spark.createDataFrame([], SCHEMA)).collect() == []
