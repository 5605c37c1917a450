from __future__ import annotations

from itertools import combinations

from starpath.llm.near_dedup import near_dedup, without_near_copies
from tests.llm.helpers import ODD, documents, prose


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """Every pair by full sets, then components."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            root[top(b)] = top(a)
    least = {}
    for k, (key, _) in enumerate(rows):
        least[top(k)] = min(least.get(top(k), key), key)
    return sorted((key, len(sets[k]), least[top(k)], key == least[top(k)]) for k, (key, _) in enumerate(rows))


def found(frame):
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in frame.collect())


def changed(text, places):
    words = text.split()
    for p in places:
        words[p % len(words)] = f"new{p}"
    return " ".join(words)


def test_against_all_pairs(spark):
    base = [prose(k, 120) for k in range(12)]
    texts = ODD + base
    for k, text in enumerate(base):
        texts += [changed(text, range(j * 7, j * 7 + 13 * n, 13)) for j, n in enumerate(range(k % 6 + 1))]
    rows = [(1000 - k, t) for k, t in enumerate(texts)]
    assert found(near_dedup(documents(spark, rows, extra=True))) == brute(rows)


def test_hot_group_in_blocks(spark):
    text = prose(5, 150)
    texts = [changed(text, [k, (k * 31) % 150, 75]) for k in range(90)] + [text] * 60 + [prose(k + 50, 40) for k in range(30)]
    rows = list(enumerate(texts))
    assert found(near_dedup(documents(spark, rows), block=16)) == brute(rows)


def test_chain_of_links(spark):
    texts, text = [], prose(8, 100)
    for k in range(14):
        texts.append(text)
        text = changed(text, [k * 7, k * 7 + 3])
    rows = list(enumerate(texts))
    assert found(near_dedup(documents(spark, rows))) == brute(rows)


def test_odd_tables(spark):
    assert near_dedup(documents(spark, [])).count() == 0
    repeated = [(3, "a b c d e f"), (3, "a b c d e f"), (4, "a b c d e f"), (5, None)]
    assert sorted(r.doc_id for r in without_near_copies(documents(spark, repeated)).collect()) == [3, 3, 5]
