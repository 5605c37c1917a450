"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as blank (Unicode white space and the four separators U+001C to U+001F).
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
BLANK_RUN = r"(?U)[\s\x1c-\x1f]+"


def strip(column: Column) -> Column:
    """Cut blanks at both ends."""
    return F.btrim(column, F.lit(BLANKS))


def ascii_only(column: Column) -> Column:
    """Drop every character outside ASCII."""
    return F.regexp_replace(column, r"[^\x00-\x7F]+", "")


def choice(column: Column) -> Column:
    """A menu choice as typed by a person: blanks cut, lower case."""
    return F.lower(strip(column))


def tokens(column: Column) -> Column:
    """Pieces between runs of blanks; the first or last one is empty where the text starts or ends with a blank."""
    return F.split(column, BLANK_RUN)


def starts_with_letter(word: Column, letter: str) -> Column:
    """First letter equal, upper and lower case alike."""
    return F.lower(F.substring(word, 1, 1)) == F.lit(letter.lower())


def fields(line: Column, limit: int = -1) -> Column:
    """The ``::`` separated fields of a line."""
    return F.split(strip(line), "::", limit)


def first_field(text: Column) -> Column:
    return F.split_part(text, F.lit("::"), F.lit(1))


def once(column: Column) -> Column:
    """A one-row generator around a costly column: select it as a column of its own.

    Spark copies an expression into every place that uses it and pushes filters on it below joins,
    which would split a line again for each of its fields. Nothing is copied through a generator.
    """
    return F.explode(F.array(column))
