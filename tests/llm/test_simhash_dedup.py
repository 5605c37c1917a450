from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import xxhash

from starpath.llm import golay, simhash_dedup
from starpath.llm.simhash_dedup import fingerprint, links, lists
from tests.llm.helpers import ODD, documents, prose


def plain(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    size = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[k:k + size]), seed=42) for k in range(len(words) - size + 1)]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def close(nodes):
    """Components of numbers that differ in at most three bits, each as its least place."""
    root = list(range(len(nodes)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(nodes)), 2):
        if (nodes[a] ^ nodes[b]).bit_count() <= 3:
            root[top(b)] = top(a)
    return [top(k) for k in range(len(nodes))]


def signed(value):
    return value - (1 << 64) if value >> 63 else value


def brute(rows):
    prints = [plain(t) for _, t in rows]
    roots, least = close(prints), {}
    for (key, _), top in zip(rows, roots):
        if key is not None:
            least[top] = min(least.get(top, key), key)
    return sorted(((key, f"{p:016x}", least.get(top)) for (key, _), p, top in zip(rows, prints, roots)), key=str)


def found(frame):
    return sorted([(r.doc_id, r.fingerprint, r.component_id) for r in frame.collect()], key=str)


def test_the_code_is_perfect():
    words = np.arange(1 << 23, dtype=np.int64)
    near = golay.codewords(words[::97])
    assert set(np.unique((near >= 0).sum(1))) == {1, 6}
    exact = golay.codewords(words)[:, 0]
    assert np.bincount(exact).tolist() == [2048] * 4096


def test_nearby_fingerprints_share_a_key():
    draw = random.Random(5)
    for width in (1, 2, 3):
        a = [draw.getrandbits(64) for _ in range(300)]
        b = [x ^ sum(1 << bit for bit in draw.sample(range(64), width)) for x in a]
        rows, keys, sides = golay.keys(np.array(a + b, np.uint64))
        held = [{} for _ in range(600)]
        for row, key, side in zip(rows.tolist(), keys.tolist(), sides.tolist()):
            held[row][key] = held[row].get(key, 0) | side
        for k in range(300):
            one, other = held[k], held[300 + k]
            assert any(one[key] | other.get(key, 0) == 3 and other.get(key, 0) for key in one), (width, k)


def test_links_of_planted_numbers(spark):
    """Pairs at one to five bits, chains, and a crowd within a few bits that is dealt into blocks."""
    draw = random.Random(9)

    def off(value, bits):
        return value ^ sum(1 << bit for bit in draw.sample(range(64), bits))

    numbers = [draw.getrandbits(64) for _ in range(60)]
    numbers += [off(x, k % 5 + 1) for k, x in enumerate(numbers)]
    chain = [draw.getrandbits(64)]
    for _ in range(8):
        chain.append(off(chain[-1], 3))
    base = draw.getrandbits(64)
    crowd = [base ^ draw.getrandbits(9) << 20 for _ in range(150)]
    numbers = sorted(set(numbers + chain + crowd + [0, 1, (1 << 64) - 1]))
    roots = close(numbers)
    nodes = spark.createDataFrame([(signed(x),) for x in numbers], "node long")
    expected = {}
    for value, top in zip(numbers, roots):
        expected.setdefault(top, set()).add(signed(value))
    for block in (512, 16):
        edges = [(r.a, r.b) for r in links(lists(nodes, block), 3).collect()]
        joined = {signed(x): {signed(x)} for x in numbers}
        for a, b in edges:
            if joined[a] is not joined[b]:
                joined[a] |= joined[b]
                for x in joined[b]:
                    joined[x] = joined[a]
        assert {frozenset(s) for s in joined.values()} == {frozenset(s) for s in expected.values()}


def test_against_all_pairs(spark):
    base = [prose(k, 200) for k in range(10)]
    texts = ODD + base
    for k, text in enumerate(base):
        words = text.split()
        for n in range(1, 5):
            for j in range(n):
                words[(k * 31 + j * 17) % len(words)] = f"new{n}"
            texts.append(" ".join(words))
    rows = [(1000 - k, t) for k, t in enumerate(texts)] + [(None, base[0]), (None, "only here without an id"), (7, "twice"), (7, "twice")]
    docs = documents(spark, rows, extra=True)
    got = simhash_dedup.simhash_dedup(docs, block=8)
    assert found(got) == brute(rows)
    assert got.filter("kept and component_id is not null").select("component_id").distinct().count() == got.filter(
        "component_id is not null").select("component_id").distinct().count()


def test_copies_are_one_node(spark):
    rows = [(k, prose(1, 50)) for k in range(500)] + [(1000, prose(2, 50)), (1001, None), (1002, " ")]
    assert found(simhash_dedup.simhash_dedup(documents(spark, rows))) == brute(rows)


def test_long_texts_are_read_in_pieces(monkeypatch):
    text = (prose(3, 4000) + "  \n\t  " + prose(4, 4000)).encode() + b" " * 200
    whole = fingerprint(text)
    assert whole == signed(plain(text.decode()))
    for piece in (1, 7, 100, 5000):
        monkeypatch.setattr(simhash_dedup, "PIECE", piece)
        assert fingerprint(text) == whole
        assert fingerprint(b"one two") == signed(plain("one two"))
        assert fingerprint(b" \n ") == 0


def test_empty(spark):
    assert simhash_dedup.simhash_dedup(documents(spark, [])).collect() == []
