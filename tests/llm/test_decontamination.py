from __future__ import annotations

import numpy as np

from starpath.llm.decontamination import best_stretch, decontaminated, longest_stretch, overlaps, words_of
from tests.llm.helpers import ODD, documents, prose


def items(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def brute(texts, tests, least=12):
    """Every alignment of every pair."""
    found = set()
    for d, text in enumerate(texts):
        mine = words_of(text)
        for t, test in enumerate(tests):
            item = words_of(test)
            for shift in range(-len(item) + 1, len(mine)):
                first, last = max(0, -shift), min(len(item), len(mine) - shift)
                start, end = best_stretch(item[first:last] == mine[first + shift:last + shift])
                if len(item) >= 5 and end - start >= min(len(item), least):
                    found.add((d, t))
    return found


def test_substitutions_case_and_marks(spark):
    tests = [prose(k, 18 + k) for k in range(10)] + ["one two three four five six seven", "too short", "", None]
    texts = list(ODD)
    for k, test in enumerate(tests[:10]):
        words = test.split()
        for at in range(k % 4):
            words[(at * 5 + 2) % len(words)] = "changed"
        texts.append(prose(500 + k, 30) + " " + " ".join(w.upper() + "!!" for w in words) + " " + prose(700 + k, 9))
    texts += ["x One, two three four five six seven. y", prose(900, 60), " ".join(tests[3].split()[:8])]
    frame = overlaps(documents(spark, texts, extra=True), items(spark, tests))
    got = {(r.doc_id, r.item_id) for r in frame.collect()}
    assert got == brute(texts, tests)
    assert len(got) == 12


def test_kept_rows_are_unchanged(spark):
    rows = [(1, prose(1, 40)), (1, "clean"), (1, "clean"), (None, "clean"), (2, prose(1, 40))]
    kept = decontaminated(documents(spark, rows), items(spark, [prose(1, 40)])).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == [("1", "clean"), ("1", "clean"), ("None", "clean")]
    assert overlaps(documents(spark, []), items(spark, [prose(1, 40)])).count() == 0
    assert decontaminated(documents(spark, rows), items(spark, [])).count() == 5


def test_best_stretch():
    assert best_stretch(np.array([1, 0, 1, 1, 1, 1, 0, 1, 1, 1, 1], bool)) == (2, 11)
    assert best_stretch(np.zeros(3, bool)) == (0, 0)


def test_every_copy_with_a_quarter_of_its_words_replaced(spark):
    """Copies of each length with each number of replaced words up to a quarter and one more, against counted agreement."""
    rng = np.random.default_rng(3)
    tests = [" ".join(f"t{n}w{k}" for k in range(n)) for n in (5, 6, 7, 8, 9, 11, 12, 13, 15, 18, 20, 24)]
    texts, expected = [], set()
    for t, test in enumerate(tests):
        n = len(test.split())
        for wrong in range(n // 4 + 2):
            ways = [rng.choice(n, wrong, replace=False) for _ in range(12)]
            ways += [np.arange(wrong), np.arange(wrong) + (n - wrong) // 2, n - 1 - np.arange(wrong)]
            for way in ways:
                words = test.split()
                for at in way:
                    words[at] = "changed"
                same = [a == b for a, b in zip(words, test.split())]
                if any(4 * sum(same[a:b]) >= 3 * (b - a) for b in range(n + 1) for a in range(b - min(n, 12) + 1)):
                    expected.add((len(texts), t))
                texts.append(f"x{len(texts)} before " + " ".join(words) + " after it")
    got = {(r.doc_id, r.item_id) for r in overlaps(documents(spark, texts), items(spark, tests)).collect()}
    assert got == expected


def test_longest_stretch():
    assert longest_stretch(np.array([1, 0, 1, 1, 0, 0, 1], bool)) == (0, 4)
    assert longest_stretch(np.array([0, 1, 1, 1, 1, 1, 0, 1], bool)) == (0, 8)
    assert longest_stretch(np.zeros(3, bool)) == (0, 0)
