from __future__ import annotations

from starpath.llm.line_dedup import line_dedup
from tests.llm.helpers import ODD, documents, prose


def cleaned(frame):
    return {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in frame.collect()}


def test_exact_lines_and_templates(spark):
    texts = []
    for k in range(6):
        texts.append("\n".join([prose(k, 12), "Licensed under the open licence here.",
                                f"Page {k} of 90 printed by user{k}", "ok",
                                f"Error while reading the big file called {'abcdef'[k]}x from disk"]))
    got = cleaned(line_dedup(documents(spark, texts, extra=True)))
    assert got[0] == (texts[0], 5, 0)
    for k in range(1, 6):
        assert got[k] == ("\n".join([prose(k, 12), "ok"]), 5, 3)


def test_below_the_limit_nothing_goes(spark):
    texts = ["the same line in two\n" + prose(k, 9) for k in range(2)] + ODD
    got = cleaned(line_dedup(documents(spark, texts)))
    assert {k: t for k, (t, _, _) in got.items()} == dict(enumerate(texts))


def test_long_passage_in_many_documents(spark):
    passage = prose(77, 60)
    texts = [prose(k, 15) + "\n" + passage + "\n" + prose(k + 100, 15) for k in range(30)]
    got = cleaned(line_dedup(documents(spark, texts)))
    assert got[0][0] == texts[0]
    assert all(got[k][0] == prose(k, 15) + "\n" + prose(k + 100, 15) for k in range(1, 30))


def test_crowded_leaves_are_parted(spark):
    texts = [f"start of line {'abcdefghij'[k % 10]}{k} " + prose(k, 6) for k in range(60)] + ["start of line same a b c d e f"] * 5
    got = cleaned(line_dedup(documents(spark, texts), leaf_lines=4))
    assert [got[k][2] for k in range(60)] == [0] * 60
    assert [got[60 + k][2] for k in range(5)] == [0, 1, 1, 1, 1]


def test_odd_tables(spark):
    assert line_dedup(documents(spark, [])).count() == 0
    rows = [(5, "a b c d"), (5, "a b c d"), (6, "a b c d"), (7, None), (None, "a b c d")]
    got = line_dedup(documents(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == [
        ("5", "a b c d"), ("5", "a b c d"), ("6", ""), ("7", None), ("None", "")]


def test_a_template_spread_over_parts_is_the_unparted_one(spark):
    names = "anna bert carl dora emil fred gina hans".split()
    texts = [f"signed and sent by {name} on the first day of the month\nown {prose(k, 5)}" for k, name in enumerate(names)]
    texts += [f"signed and sent {prose(k + 50, 9)}" for k in range(12)]
    frame = documents(spark, texts)
    parted = cleaned(line_dedup(frame, leaf_lines=4))
    assert parted == cleaned(line_dedup(frame))
    assert [parted[k][2] for k in range(8)] == [0] + [1] * 7


def test_long_passage_in_two_documents(spark):
    passage = prose(77, 60)
    nearly = " ".join("other" if k in (20, 40) else w for k, w in enumerate(passage.split()))
    texts = [prose(k, 15) + "\n" + (nearly if k else passage) + "\nshort line in both" for k in range(2)]
    got = cleaned(line_dedup(documents(spark, texts)))
    assert got[0][0] == texts[0] and got[1][0] == prose(1, 15) + "\nshort line in both"


def test_a_crowded_leaf_is_grown_whole(spark):
    a = "alpha beta gamma delta epsilon zeta eta theta"
    b = "alpha beta gamma delta epsilon zeta iota kappa"
    c = "alpha beta gamma delta lambda mu eta theta"
    frame = documents(spark, [a] * 4 + [b] * 2 + [c])
    for limit in (1, 4, 2000):
        got = cleaned(line_dedup(frame, leaf_lines=limit))
        assert [got[k][2] for k in range(7)] == [0, 1, 1, 1, 1, 1, 0]
