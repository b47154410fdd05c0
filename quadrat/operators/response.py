"""Response and covariate columns of a model table."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.functions.nullsafe import clamp


def beta_response(success: Column, trial: Column, *, legacy: bool = False) -> dict[str, Column]:
    """n_success held to n_trial, and its share within [0.001, 0.999].

    A missing success stays missing; with ``legacy`` it counts as full success, as a minimum that skips nulls has it.
    """
    s = F.least(success, trial) if legacy else F.when(success.isNotNull(), F.least(success, trial))
    return {"n_success": s, "mice_prop": clamp(s / F.nullif(trial, F.lit(0.0)), 0.001, 0.999)}


def series_key(*parts: Column) -> Column:
    """Parts joined with '_', nulls written as NA."""
    return F.concat_ws("_", *[F.coalesce(p.cast("string"), F.lit("NA")) for p in parts])


def zscore(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns centred and scaled by the sample deviation of the whole table; null where it is 0."""
    stats = df.agg(F.struct(*[F.struct(F.avg(c).alias("m"), F.stddev_samp(c).alias("s")).alias(c) for c in columns]).alias("x")).scalar()
    return df.withColumns({c: (F.col(c) - stats[c]["m"]) / F.nullif(stats[c]["s"], F.lit(0.0)) for c in columns})


def centred(df: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """``name``: the column less its group's mean."""
    from quadrat.functions.nullsafe import join_ns

    return join_ns(df, df.groupBy(*keys).agg(F.avg(column).alias("__m")), keys, "left").withColumn(name, F.col(column) - F.col("__m")).drop("__m")


def truncate_matching(df: DataFrame, pattern: str, *, keep: str | None = None) -> DataFrame:
    """Numeric columns whose name matches as integers, cut towards zero; names matching ``keep`` stay as they are."""
    cols = [c for c, t in df.dtypes if re.search(pattern, c) and t in ("double", "float", "bigint", "int") and not (keep and re.search(keep, c))]
    return df.withColumns({c: F.col(c).try_cast("int") for c in cols})


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def survey_covariates(trap: Column, latitude: Column, night: Column, *, standard: str = "longworth", weight: float = 1.0, other: float = 0.25, parallel: float = -30.0) -> dict[str, Column]:
    """Columns of a model table: the weight of an observation by its trap, the side of a parallel (south without a latitude), and the method's name."""
    lat = F.nanvl(latitude, F.lit(None).cast("double"))
    return {"obs_weight": F.when(trap == standard, weight).otherwise(other), "north": F.when(lat > parallel, "north").otherwise("south"), "survey_method": F.concat(F.lit("traps_night"), night.cast("string"))}


def burrow_methods(age: Column, *, old: str = "old") -> Column:
    """Method of a burrow search by the crop it was made in: 'burrows_old' or 'burrows_young', null where the age is not known."""
    return F.when(age == old, "burrows_old").when(age.isNotNull(), "burrows_young")
