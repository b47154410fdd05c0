"""Austral season calendar: December opens the Summer of the next year."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEASONS = ("Summer", "Autumn", "Winter", "Spring")

# Season spellings that name months or that do not share a season's first two letters.
SEASON_ALIASES = {
    "djf": 0, "decfeb": 0, "mam": 1, "marmay": 1, "fall": 1, "jja": 2, "junaug": 2, "son": 3, "sepnov": 3,
    "decemberfebruary": 0, "marchmay": 1, "juneaugust": 2, "septembernovember": 3,
}
SEASON_STARTS = {"su": 0, "au": 1, "wi": 2, "sp": 3}


def season_index(month: Column) -> Column:
    """0 Summer (Dec-Feb), 1 Autumn, 2 Winter, 3 Spring; null for a null month."""
    return F.floor((month % 12) / 3).cast("int")


def year_adj(date: Column) -> Column:
    """Calendar year, December counted to the next one."""
    return F.year(date) + F.when(F.month(date) == 12, 1).otherwise(0)


def season_ord(date: Column) -> Column:
    """Integer that orders seasons in time: year_adj * 4 + season index."""
    return (year_adj(date) * 4 + season_index(F.month(date))).cast("int")


def season_name(index: Column) -> Column:
    """Season of an index 0 to 3; null outside."""
    out = F.when(index == 0, SEASONS[0])
    for i, name in enumerate(SEASONS[1:], 1):
        out = out.when(index == i, name)
    return out


def ord_name(ordinal: Column) -> Column:
    return season_name(F.pmod(ordinal, F.lit(4)))


def ord_year(ordinal: Column) -> Column:
    return F.floor(ordinal / 4).cast("int")


def ord_label(ordinal: Column) -> Column:
    """'Season-YYYY'."""
    return F.concat_ws("-", ord_name(ordinal), ord_year(ordinal).cast("string"))


def parse_season(text: Column) -> Column:
    """Index of a freely spelt season ('DJF', 'Sprng', 'sum', 'Mar-May'), null where none is meant."""
    plain = F.regexp_replace(F.lower(text), "[^a-z]", "")
    table = F.create_map(*[F.lit(x) for kv in SEASON_ALIASES.items() for x in kv])
    starts = F.create_map(*[F.lit(x) for kv in SEASON_STARTS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, plain), F.try_element_at(starts, F.substring(plain, 1, 2)))


def parse_label(text: Column) -> Column:
    """Ordinal of a season label with a year ('Summer-2019', 'DJF 2019'); null if either part is missing."""
    year = F.regexp_extract(text, r"(\d{4})", 1)
    return (F.when(year != "", year).cast("int") * 4 + parse_season(F.regexp_replace(text, r"\d", ""))).cast("int")


def label_mid_date(ordinal: Column) -> Column:
    """15th of the season's middle month: January, April, July, October."""
    return F.make_date(ord_year(ordinal), F.pmod(ordinal, F.lit(4)) * 3 + 1, F.lit(15))
