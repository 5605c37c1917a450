"""Word counts and range sums."""

from __future__ import annotations

from starpath.operators import sums, words


def test_words_split_like_people_expect(spark):
    text = ["And\tand  And so", "", "  and so\x1cit ", "ändern Apfel"]
    counts = words.count_words(spark.createDataFrame([(line,) for line in text], "value string"))
    expected = [(w, c) for w, c in sorted(
        {w: " ".join(text).split().count(w) for w in " ".join(text).split()}.items(), key=lambda e: (-e[1], e[0]))]
    assert [tuple(row) for row in words.by_count(counts).collect()] == expected
    assert [row.word for row in words.top_with_letter(counts, "A").collect()] == ["And", "and", "Apfel"]
    assert len(words.top_with_letter(counts, "a", 2).collect()) == 2


def test_letter_filter_reaches_below_the_aggregate(spark):
    counts = words.count_words(spark.createDataFrame([("a b",)], "value string"))
    plan = words.top_with_letter(counts, "a")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("lower(substring(")
    physical = words.top_with_letter(counts, "a")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in physical


def test_column_sum(spark):
    assert sums.column_sum(spark.range(100_000), "id").first().total == 4_999_950_000
    assert sums.column_sum(spark.range(0), "id").first().total == 0


def test_sums_do_not_overflow(spark):
    big = spark.createDataFrame([(2**62,)] * 8, "n bigint")
    assert sums.column_sum(big, "n").first().total == 2**65
