"""Rules about ratings: buckets, splits, seasons, valid stars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bucket_digit(rated_at: Column) -> Column:
    """Tenth character of the date field, null where it is no digit."""
    char = F.substring(rated_at, 10, 1)
    return F.when(char.rlike("^[0-9]$"), char.try_cast("int"))


def split_name(bucket: Column) -> Column:
    """60/20/20 by bucket: below 6 train, 6 and 7 validation, 8 and 9 test."""
    return (
        F.when(bucket < 6, F.lit("train"))
        .when(bucket < 8, F.lit("validation"))
        .when(bucket >= 8, F.lit("test"))
    )


def season_of(date: Column) -> Column:
    month = F.month(date)
    return (
        F.when(month.between(3, 5), F.lit("spring"))
        .when(month.between(6, 8), F.lit("summer"))
        .when(month.between(9, 11), F.lit("autumn"))
        .when(month.isNotNull(), F.lit("winter"))
    )


def typed_number(raw: Column) -> Column:
    """The number in a typed rating: digits only, null for anything else; too long for a number counts as 9."""
    return F.when(raw.rlike("^[0-9]+$"), F.coalesce(raw.try_cast("bigint"), F.lit(9)))


def star_problem(number: Column) -> Column:
    """Why a typed number is no rating; null where it is one. Zero stands for a store never visited."""
    return (
        F.when(number.isNull(), F.lit("not_a_number"))
        .when(number == 0, F.lit("not_visited"))
        .when(number > 5, F.lit("out_of_range"))
    )


def stars(number: Column) -> Column:
    """The typed number as 1 to 5, null where ``star_problem`` has a reason."""
    return F.when(number.between(1, 5), number.cast("int"))
