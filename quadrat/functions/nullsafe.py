"""Joins, memberships and aggregates with the null rules of the reference's verbs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_ns(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", suffix: str = "_right") -> DataFrame:
    """Equi-join in which null keys meet null keys; planned as a hashable join.

    ``how``: inner, left, full, left_semi or left_anti. Keys appear once (for ``full`` the one that is
    present); other columns of ``right`` that clash with ``left`` get ``suffix``.
    """
    keep = [c for c in right.columns if c not in keys]
    names = {c: (c + suffix if c in left.columns else c) for c in keep}
    r = right.select(*[F.col(k).alias(f"__r_{i}") for i, k in enumerate(keys)], *[F.col(c).alias(names[c]) for c in keep], F.lit(True).alias("__r"))
    left = left.withColumn("__l", F.lit(True)) if how == "full" else left
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{i}")) for i, k in enumerate(keys)])
    out = left.join(r, cond, how)
    if how in ("left_semi", "left_anti"):
        return out
    if how == "full":
        for i, k in enumerate(keys):
            out = out.withColumn(k, F.when(F.col("__l"), F.col(k)).otherwise(F.col(f"__r_{i}")))
    return out.drop("__l", "__r", *[f"__r_{i}" for i in range(len(keys))])


def is_in(c: Column, *values: object) -> Column:
    """Membership that is never null: a null is in no set of values."""
    return F.coalesce(c.isin(*values), F.lit(False))


def not_in(c: Column, *values: object) -> Column:
    """Negated membership that keeps nulls."""
    return ~is_in(c, *values)


def _strict(c: Column, agg: Column) -> Column:
    return F.when(F.count(c) == F.count(F.lit(1)), agg)


def strict_sum(c: Column) -> Column:
    """Sum that is null if any value of the group is null."""
    return _strict(c, F.sum(c))


def strict_mean(c: Column) -> Column:
    return _strict(c, F.avg(c))


def strict_min(c: Column) -> Column:
    return _strict(c, F.min(c))


def strict_max(c: Column) -> Column:
    return _strict(c, F.max(c))


def clamp(c: Column, low: float, high: float) -> Column:
    """Value held within [low, high]; null stays null, unlike with bare least and greatest."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def pct_deviation(c: Column, normal: Column) -> Column:
    """(c - normal) / normal * 100; null where the normal is 0 or null."""
    return (c - normal) / F.nullif(normal, F.lit(0.0)) * 100
