"""What counts as no value: nulls, blanks, and entries that only stand in for a value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Entries that stand in for a missing text, in lower case with punctuation as one space.
PLACEHOLDERS = (
    "", "unknown", "unk", "unkn", "unknwn", "not known", "no data", "nodata", "n a", "na", "nan", "null", "nil", "none", "missing",
    "tbc", "tba", "tbd", "to be confirmed", "x", "xx", "xxx", "not recorded", "not entered", "not available", "not stated", "not given",
    "not specified", "not applicable", "not noted", "not supplied", "not provided", "no record", "no entry", "no value", "unspecified",
    "undefined", "n r", "nr", "n d", "nd", "n k", "nk", "blank", "empty", "error", "ref", "unsure", "not sure", "dont know", "don t know",
    "no info", "no information", "pending", "see notes", "see comments",
)


def plain_words(text: Column) -> Column:
    """Lower case, every run of other characters than letters and digits as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def text_missing(text: Column, placeholders: tuple[str, ...] = PLACEHOLDERS) -> Column:
    """True for null, blank or punctuation-only text, placeholders, and runs of nines (99, -9999).

    Never null.
    """
    plain = plain_words(text)
    return F.coalesce(plain.isin(*placeholders) | plain.rlike(r"^9{2,}( 0+)?$"), F.lit(True))


def count_missing(value: Column, low: float = 0.0, high: float = 100.0) -> Column:
    """True unless the value is a number in [low, high]; NaN is no number. Never null."""
    return ~F.coalesce(value.between(low, high) & ~F.isnan(value.cast("double")), F.lit(False))
