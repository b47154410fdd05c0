"""Row and group filters with the reference's null rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrat.functions.nullsafe import is_in, join_ns, not_in


def exclude(df: DataFrame, drop: dict[str, tuple], *, drop_null: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose columns hold none of the listed values; nulls stay, but for the columns of ``drop_null``."""
    conds = [not_in(F.col(c), *v) for c, v in drop.items() if v] + [F.col(c).isNotNull() for c in drop_null]
    return df.where(reduce(lambda a, b: a & b, conds)) if conds else df


def keep_groups(df: DataFrame, keys: list[str], value: str, at_least: object) -> DataFrame:
    """Rows of the groups whose maximum reaches a bound; a group with a null value is dropped.

    Groups are aggregated and joined back null-safely, so no group is gathered in one window.
    """
    g = df.groupBy(*keys).agg(F.max(value).alias("__m"), F.count_if(F.col(value).isNull()).alias("__n"))
    return join_ns(df, g.where((F.col("__n") == 0) & (F.col("__m") >= at_least)).select(*keys), keys, "left_semi")


def drop_known(df: DataFrame, column: str, values: tuple, day: str, on: object) -> DataFrame:
    """All rows but those with a listed value on a day; a listed value with a null day goes too, a null value stays."""
    listed = is_in(F.col(column), *values)
    return df.where(~listed | (listed & F.coalesce(F.col(day) != on, F.lit(False))))


def without_text(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows whose text doesn't match; a null text matches nothing. Case does not matter."""
    return df.where(~F.coalesce(F.col(column).rlike(f"(?i){pattern}"), F.lit(False)))


def any_column_matches(df: DataFrame, columns: list[str], pattern: str) -> DataFrame:
    return df.where(reduce(lambda a, b: a | b, [F.coalesce(F.col(c).rlike(f"(?i){pattern}"), F.lit(False)) for c in columns]))


def ordinal_between(c: Column, after: int | None, before: int | None) -> Column:
    """Strictly between two ordinals; null ordinals are outside."""
    ok = c.isNotNull()
    if after is not None:
        ok = ok & (c > after)
    return ok & (c < before) if before is not None else ok


def min_observed(df: DataFrame, keys: list[str], value: str, more_than: int) -> DataFrame:
    """Rows of groups with more than so many non-null values."""
    g = df.groupBy(*keys).agg(F.count(value).alias("__k")).where(F.col("__k") > more_than).select(*keys)
    return join_ns(df, g, keys, "left_semi")


def repeated(df: DataFrame, keys: list[str], count: str = "n_rows") -> DataFrame:
    """Rows whose keys occur more than once, with how often."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count)).where(F.col(count) > 1)
    return join_ns(df, g, keys, "inner")


def latest(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows that hold their group's greatest value, ties kept; nulls never do."""
    g = df.groupBy(*keys).agg(F.max(value).alias("__m"))
    return join_ns(df, g, keys, "inner").where(F.col(value) == F.col("__m")).drop("__m")


def step_log(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """(step_no, step, n_before, n_removed, pct_removed) of filters applied one after the other, in one pass."""
    passed = F.lit(True)
    aggs = [F.count(F.lit(1)).alias("c0")]
    for i, (_, keep) in enumerate(steps, 1):
        passed = passed & F.coalesce(keep, F.lit(False))
        aggs.append(F.count_if(passed).alias(f"c{i}"))
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(i).alias("step_no"), F.lit(n).alias("step"), F.col(f"c{i - 1}").alias("n_before"), (F.col(f"c{i - 1}") - F.col(f"c{i}")).alias("n_removed")) for i, (n, _) in enumerate(steps, 1)])
    return one.select(F.inline(rows)).withColumn("pct_removed", F.round(F.col("n_removed") * 100.0 / F.nullif("n_before", F.lit(0)), 4))


def ever_positive(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows of the groups whose sum is above zero, nulls skipped."""
    g = df.groupBy(*keys).agg(F.sum(value).alias("__s")).where(F.col("__s") > 0).select(*keys)
    return join_ns(df, g, keys, "left_semi")


def last_steps(df: DataFrame, step: str, n: int) -> DataFrame:
    """Rows of the last n integer steps of the whole table; the maximum is a scalar, not a window."""
    top = df.agg(F.max(step).alias("m")).scalar()
    return df.where(F.col(step).isNotNull() & (F.col(step) > top - n))


def last_rows(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group in a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")
