"""Ratings: parsing, validation, cap, split, seasons."""

from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from starpath.functions import numbers, text
from starpath.functions.ratings import season_of
from starpath.operators import ratings as ops
from starpath.operators.rejects import accepted, rejected
from starpath.plans.load import load_ratings
from starpath.sources.lines import write_lines

LINES = [
    "1::10::4.5::1479945678",
    "1::10::4.5::1479945678",
    " 2::11::3::2016-11-23::more",
    "3::12::2::147994567",
    "4::13::5",
    "x::13::5::2016-11-23",
    "5::14::five::2016-11-23",
    "6::15::4.0d::2016-11-23",
]


def lines_of(spark, values):
    return spark.createDataFrame([(value,) for value in values], "value string")


def test_parse_types_buckets_and_rejects(spark):
    parsed = ops.parse_ratings(lines_of(spark, LINES))
    good = sorted(tuple(row)[1:] for row in accepted(parsed).collect())
    assert good == [(1, 10, 4.5, "1479945678", 8), (1, 10, 4.5, "1479945678", 8), (2, 11, 3.0, "2016-11-23", 3)]
    assert sorted((row.value[0], row.reject_reason) for row in rejected(parsed).collect()) == [
        ("3", "bad_date"), ("4", "missing_field"), ("5", "bad_rating"), ("6", "bad_rating"), ("x", "bad_id")]


def test_lines_and_parse_are_inverse(spark):
    ratings = spark.createDataFrame([(1, 2, 4.0, "2016-11-23"), (3, 4, 2.5, "1479945678")],
                                    "user_id bigint, item_id bigint, rating double, rated_at string")
    lines = ops.rating_lines(ratings)
    assert sorted(row.value for row in lines.collect()) == ["1::2::4::2016-11-23", "3::4::2.5::1479945678"]
    back = accepted(ops.parse_ratings(lines)).select("user_id", "item_id", "rating", "rated_at")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, ratings.collect()))


def test_timestamps(spark):
    df = spark.createDataFrame([("1479945678",), ("2016-11-23",), ("soon",)], "rated_at string")
    got = [row.ts for row in ops.with_timestamp(df).select(F.date_format("rated_ts", "yyyy-MM-dd").alias("ts")).collect()]
    assert got == ["2016-11-24", "2016-11-23", None]


def test_typed_stars(spark):
    raw = ["0", "1", "5", "6", "05", "00", "", "x", "-1", "4.0", " 3", "99999999999999999999", None]
    df = spark.createDataFrame([(value,) for value in raw], "raw string")
    got = {row.raw: (row.stars, row.reject_reason) for row in ops.validate_stars(df).collect()}
    bad = (None, "not_a_number")
    assert got == {
        "0": (None, "not_visited"), "1": (1, None), "5": (5, None), "6": (None, "out_of_range"), "05": (5, None),
        "00": (None, "not_visited"), "": bad, "x": bad, "-1": bad, "4.0": bad, " 3": bad, None: bad,
        "99999999999999999999": (None, "out_of_range")}


def test_cap_per_user(spark):
    df = spark.createDataFrame([(user, n) for user in (1, 2) for n in range(12 if user == 1 else 3)],
                               "user_id bigint, n int")
    capped = ops.cap_per_user(df, [F.col("n")]).collect()
    assert sorted(row.n for row in capped if row.user_id == 1) == list(range(11))
    assert len(capped) == 14
    assert len(ops.cap_per_user(df, [F.col("n")], cap=2).collect()) == 4


def test_split_is_a_partition(spark):
    df = spark.range(10).select(F.col("id").cast("int").alias("bucket"))
    assert {row.split: row.n_ratings for row in ops.split_sizes(df).collect()} == {
        "train": 6, "validation": 2, "test": 2}


@pytest.mark.parametrize("month,season", [
    (12, "winter"), (2, "winter"), (3, "spring"), (5, "spring"), (6, "summer"), (9, "autumn"), (11, "autumn")])
def test_seasons(spark, month, season):
    df = spark.createDataFrame([(date(2016, month, 1), datetime(2016, month, 28))], "d date, t timestamp")
    assert tuple(df.select(season_of(F.col("d")), season_of(F.col("t"))).first()) == (season, season)


def test_summary(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (2, 2)], "user_id bigint, item_id bigint")
    assert tuple(ops.summary(df).first()) == (4, 2, 2)


def test_text_functions(spark):
    df = spark.createDataFrame([("  Café 　",)], "t string")
    row = df.select(text.strip(F.col("t")), text.ascii_only(text.strip(F.col("t"))), text.choice(F.col("t"))).first()
    assert tuple(row) == ("Café", "Caf", "café")


def test_dot_of_unequal_lengths_is_null(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [4.0, 5.0, 6.0])], "a array<float>, b array<float>")
    row = df.select(numbers.dot(F.col("a"), F.col("b")), numbers.dot(F.col("a"), F.slice("b", 1, 2))).first()
    assert tuple(row) == (32.0, None)


def test_load_lays_ratings_out_by_slice(spark, tmp_path):
    write_lines(lines_of(spark, LINES + ["9::10::1::2016-07-01", "2::11::3::2016-99-99"]), str(tmp_path / "in"))
    users = spark.createDataFrame([(1, "NV"), (2, "QC")], "user_id bigint, state string")
    load_ratings(spark, str(tmp_path / "in"), users, str(tmp_path / "out"), str(tmp_path / "bad"))
    loaded = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.season, r.state, r.n) for r in loaded.groupBy("season", "state").agg(F.count("*").alias("n")).collect()} == {
        ("autumn", "NV", 2), ("autumn", "QC", 1)}
    reasons = sorted(row.reject_reason for row in spark.read.parquet(str(tmp_path / "bad")).collect())
    assert reasons == sorted(["bad_date"] * 2 + ["missing_field", "bad_id", "bad_rating", "bad_rating", "unknown_user"])
