"""Summaries of posterior draws: a long table (group, draw, time, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrat.functions.nullsafe import join_ns

LEVELS = ("Low", "Moderate", "High")


def average_draws(draws: DataFrame, members: DataFrame, member: str, area: str) -> DataFrame:
    """(area, draw, time, value): mean over the members of an area, draw by draw."""
    return draws.join(members.select(member, area).distinct(), member).groupBy(area, "draw", "time").agg(F.avg("value").alias("value"))


def summarise_draws(draws: DataFrame, group: str, threshold: Column | None = None) -> DataFrame:
    """(group, time, mean, median, q025, q975[, exceedance]): linear-interpolation quantiles, share of draws above the threshold."""
    x = F.col("value")
    aggs = [F.avg(x).alias("mean"), F.median(x).alias("median"), F.percentile(x, 0.025).alias("q025"), F.percentile(x, 0.975).alias("q975")]
    if threshold is not None:
        aggs.append(F.avg((x > F.col("__t")).cast("double")).alias("exceedance"))
        draws = draws.withColumn("__t", threshold)
    return draws.groupBy(group, "time").agg(*aggs)


def quantile_of(df: DataFrame, column: str, q: float) -> Column:
    """A quantile of the whole column as a scalar."""
    return df.agg(F.percentile(F.col(column), q).alias("q")).scalar()


def cut3(x: Column, low: Column, high: Column) -> Column:
    """Low up to ``low``, Moderate up to ``high`` (both included), High above; null for null."""
    return F.when(x <= low, LEVELS[0]).when(x <= high, LEVELS[1]).when(x > high, LEVELS[2])


def with_change(df: DataFrame, group: str, time: str, value: str) -> DataFrame:
    """``df`` with ``change`` (ratio to the step before) and ``pct_change``; null at the first step or after a 0."""
    before = F.lag(value).over(Window.partitionBy(group).orderBy(time))
    r = F.col(value) / F.nullif(before, F.lit(0.0))
    return df.withColumns({"change": r, "pct_change": (r - 1) * 100})


def group_levels(df: DataFrame, group: str, value: str, low: float = 0.25, high: float = 0.75) -> DataFrame:
    """``df`` with ``level`` relative to its own group's quantiles."""
    q = df.groupBy(group).agg(F.percentile(F.col(value), low).alias("__a"), F.percentile(F.col(value), high).alias("__b"))
    return join_ns(df, q, [group], "left").withColumn("level", cut3(F.col(value), F.col("__a"), F.col("__b"))).drop("__a", "__b")


def hit_rate(df: DataFrame, group: str, actual: str, predicted: str, q: float = 0.75) -> DataFrame:
    """(group, n_top, n_hit, rate): of the periods whose actual value is above its group's quantile, the share predicted so too."""
    t = df.groupBy(group).agg(F.percentile(F.col(actual), q).alias("__a"), F.percentile(F.col(predicted), q).alias("__p"))
    j = join_ns(df, t, [group], "left")
    top = F.col(actual) > F.col("__a")
    g = j.groupBy(group).agg(F.count_if(top).alias("n_top"), F.count_if(top & (F.col(predicted) > F.col("__p"))).alias("n_hit"))
    return g.withColumn("rate", F.col("n_hit") / F.nullif("n_top", F.lit(0)))


def best_available(df: DataFrame, group: str, ordinal: str, value: str, now: int, back: int = 2) -> DataFrame:
    """(group, value, used, is_current): the value of season ``now``, else of the one before, and so on; null if none of them has one."""
    near = df.where(F.col(ordinal).between(now - back, now) & F.col(value).isNotNull()).groupBy(group).agg(F.max_by(value, ordinal).alias("value"), F.max(ordinal).alias("used"))
    out = join_ns(df.select(group).distinct(), near, [group], "left")
    return out.withColumn("is_current", F.coalesce(F.col("used") == now, F.lit(False)))


def attach_surveys(predictions: DataFrame, surveys: DataFrame, keys: list[str], counts: list[str], time: str, n: int = 2) -> DataFrame:
    """The last ``n`` steps of each group's predictions with the survey counts of the same keys, 0 where there are none."""
    group = [k for k in keys if k != time]
    w = Window.partitionBy(*group).orderBy(F.col(time).desc())
    last = predictions.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")
    return join_ns(last, surveys, keys, "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in counts})


def effect_grid(effects: DataFrame, key: list[str], estimate: str, error: str) -> DataFrame:
    """``effects`` with lower and upper (1.96 standard errors)."""
    return effects.withColumns({"lower": F.col(estimate) - 1.96 * F.col(error), "upper": F.col(estimate) + 1.96 * F.col(error)})


def sentence_list(names: Column) -> Column:
    """'a', 'a and b', 'a, b and c' of an array; empty text for an empty array."""
    n = F.size(names)
    return F.when(n == 0, "").when(n == 1, F.get(names, F.lit(0))).otherwise(F.concat(F.array_join(F.slice(names, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(" and "), F.element_at(names, -1)))


def lag_effects(effects: DataFrame, keys: list[str], lag: str, estimate: str, error: str) -> DataFrame:
    """(keys, n_lags, estimate, se, lower, upper): effects summed over the lags, their standard errors as the root of the sum of squares, 1.96 of them on both sides."""
    g = effects.groupBy(*keys).agg(F.count_distinct(lag).alias("n_lags"), F.sum(estimate).alias("estimate"), F.sqrt(F.sum(F.col(error) * F.col(error))).alias("se"))
    return effect_grid(g, keys, "estimate", "se")


def lag_grid(lags: DataFrame, lag: str, template: DataFrame, column: str, values: list[float]) -> DataFrame:
    """Every lag with every listed value of a column on one row of template columns: a grid for predictions, as long as lags times values."""
    base = template.drop(lag, column).limit(1).select(F.struct("*").alias("b")).scalar()
    return lags.select(lag).distinct().select(lag, F.explode(F.lit([float(v) for v in values])).alias(column), base.alias("__b")).select(lag, column, "__b.*")


def _sentence(names: Column, before: str, after: str, none: str) -> Column:
    return F.when(F.size(names) > 0, F.concat(F.lit(before), sentence_list(names), F.lit(after))).otherwise(F.lit(none))


def _sorted(condition: Column, name: Column) -> Column:
    return F.array_sort(F.collect_list(F.when(condition, name)))


def range_of_levels(df: DataFrame, level: str, subject: str = "abundance") -> DataFrame:
    """(sentence): 'predicted ... to be low', 'to range from low to high', or that there is none; one row."""
    has = F.array(*[F.coalesce(F.bool_or(F.col(level) == n), F.lit(False)) for n in LEVELS])
    present = F.transform(F.filter(F.arrays_zip(has.alias("h"), F.lit([n.lower() for n in LEVELS]).alias("n")), lambda x: x["h"]), lambda x: x["n"])
    one = df.agg(present.alias("p"))
    n, lo, hi = F.size("p"), F.get("p", F.lit(0)), F.element_at("p", -1)
    text = F.when(n == 0, f"No predictions of {subject} are available.").when(n == 1, F.concat(F.lit(f"Current {subject} is predicted to be "), lo, F.lit(".")))
    return one.select(text.otherwise(F.concat(F.lit(f"Current {subject} is predicted to range from "), lo, F.lit(" to "), hi, F.lit("."))).alias("sentence"))


def areas_by_level(df: DataFrame, area: str, level: str, subject: str = "abundance") -> DataFrame:
    """(sentence): the areas with moderate and with high levels, in order of name; one row. Lists are as long as there are areas."""
    pick = lambda n: _sentence(_sorted(F.col(level) == n, F.col(area)), f"{n.lower()} in ", "", "")
    both = df.agg(F.filter(F.array(pick("Moderate"), pick("High")), lambda x: x != "").alias("p"))
    return both.select(_sentence(F.col("p"), f"Current {subject} is predicted to be ", ".", f"No area is predicted to have moderate or high {subject}.").alias("sentence"))


def areas_that_change(df: DataFrame, area: str, ratio: str, *, up: bool, high: float = 1.25, low: float = 0.75, subject: str = "abundance") -> DataFrame:
    """(sentence): the areas whose ratio to the step before is above ``high`` (or below ``low``), each with its change in whole per cent; one row."""
    word = "increase" if up else "decrease"
    far = F.col(ratio) > high if up else F.col(ratio) < low
    name = F.concat(F.col(area), F.lit(" (by "), F.round(F.abs(F.col(ratio) - 1) * 100).cast("int").cast("string"), F.lit("%)"))
    return df.agg(_sorted(far, name).alias("p")).select(_sentence(F.col("p"), f"Next season {subject} is forecast to {word} in ", ".", f"No area is forecast to {word} next season.").alias("sentence"))


def range_of_chance(df: DataFrame, chance: str, subject: str = "high abundance") -> DataFrame:
    """(sentence): from the least to the greatest chance, in whole per cent; one row, null without values."""
    pct = lambda c: F.round(c * 100).cast("int").cast("string")
    return df.agg(F.concat(F.lit(f"The chance of {subject} next season ranges from "), pct(F.min(chance)), F.lit("% to "), pct(F.max(chance)), F.lit("%.")).alias("sentence"))
