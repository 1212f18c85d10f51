"""The word classes that the text operators share, as column expressions and as Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space between words: space and the controls 9 to 13; bytes.split() splits at exactly these.
SPACE = " \t\n\x0b\x0c\r"
_RUN = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """array<string> of the runs without white space; empty for null, empty or blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _RUN))


def n_words(text: Column) -> Column:
    """Number of words without building them: each run becomes one letter, white space goes."""
    ones = F.regexp_replace(F.coalesce(text, F.lit("")), _WORD, "x")
    return F.length(F.translate(ones, SPACE, "")).cast("long")


def count_chars(text: Column, chars: str) -> Column:
    """How many characters of the text are among chars."""
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")
