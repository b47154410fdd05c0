"""Join shapes of the reference; null-safe keys are in functions.nullsafe."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.functions.nullsafe import join_ns


def star(fact: DataFrame, dims: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """Left joins of a fact to dimensions (table, fact key, dimension key); clashing columns get the dimension's number."""
    out = fact
    for i, (dim, k, dk) in enumerate(dims):
        cols = [F.col(c).alias(c if c not in out.columns else f"{c}_{i + 1}") for c in dim.columns if c != dk]
        out = out.join(dim.select(F.col(dk).alias(f"__k{i}"), *cols), F.col(k) == F.col(f"__k{i}"), "left").drop(f"__k{i}")
    return out


def full_outer_all(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """Full outer join of several tables on null-safe keys, each key once."""
    return reduce(lambda a, b: join_ns(a, b, keys, "full"), tables)


def natural(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    """Join on all columns that both have, null-safely."""
    return join_ns(left, right, [c for c in left.columns if c in right.columns], how)


def first_match(left: DataFrame, right: DataFrame, key: str, order: str, take: list[str]) -> DataFrame:
    """Columns of the first row of ``right`` (by ``order``) with the same key; null without one."""
    one = right.groupBy(key).agg(F.min_by(F.struct(*take), order).alias("__t"))
    return left.join(one, key, "left").select(*left.columns, *[F.col(f"__t.{c}").alias(c) for c in take])


def representative(df: DataFrame, keys: list[str], order: str, take: list[str]) -> DataFrame:
    """``df`` with ``take`` replaced by the values of its group's first row by ``order``."""
    one = df.groupBy(*keys).agg(F.min_by(F.struct(*take), order).alias("__t"))
    return join_ns(df.drop(*take), one, keys, "left").withColumns({c: F.col(f"__t.{c}") for c in take}).drop("__t")


def expand_steps(df: DataFrame, first: Column, last: Column, name: str) -> DataFrame:
    """Each row once for each integer from first to last: a grid without a cross join. Null bounds give no row."""
    return df.where(first.isNotNull() & last.isNotNull() & (first <= last)).select("*", F.explode(F.sequence(first, last)).alias(name))
