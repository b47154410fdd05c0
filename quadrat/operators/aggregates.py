"""Group summaries with strict-period, validity and two-level rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.functions.nullsafe import join_ns

# The summaries a period may have, by name.
PERIOD_FUNCTIONS: dict[str, Callable[[Column], Column]] = {"sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min, "median": F.median}


def detection_by_area(df: DataFrame, area: list[str], site: list[str], value: str) -> DataFrame:
    """(area, n_sites, n_detected, prop): a site is detected if any value is above zero; one without values is not."""
    s = df.groupBy(*area, *site).agg(F.coalesce(F.bool_or(F.col(value) > 0), F.lit(False)).alias("__d"))
    out = s.groupBy(*area).agg(F.count(F.lit(1)).alias("n_sites"), F.sum(F.col("__d").cast("int")).alias("n_detected"))
    return out.withColumn("prop", F.round(F.col("n_detected") / F.col("n_sites"), 4))


def mean_of_ratios(df: DataFrame, area: list[str], site: list[str], num: str, den: str) -> DataFrame:
    """Mean over sites of their total ratio, rounded to four places; sites without effort are left out."""
    s = df.groupBy(*area, *site).agg((F.sum(num) / F.nullif(F.sum(den), F.lit(0.0))).alias("__r"))
    return s.groupBy(*area).agg(F.round(F.avg("__r"), 4).alias("mean_ratio"))


def weighted_mean_valid(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """Weighted mean over rows with a value and a positive weight; null if there is none; four places."""
    ok = F.col(value).isNotNull() & (F.col(weight) > 0)
    w = F.sum(F.when(ok, F.col(weight)))
    return df.groupBy(*keys).agg(F.round(F.sum(F.when(ok, F.col(value) * F.col(weight))) / F.nullif(w, F.lit(0.0)), 4).alias("weighted_mean"))


def seasonal_strict(df: DataFrame, keys: list[str], season: str, month: str, summaries: dict[str, tuple[str, str]], *, months: int = 3, order: str | None = None) -> DataFrame:
    """One row for each key and season: summaries (name -> (column, function)) of one value a month.

    A month's value is its first non-null one by ``order``. A summary is null unless exactly ``months`` distinct
    months have a value. An unknown function raises a KeyError.
    """
    cols = sorted({c for c, _ in summaries.values()})
    first = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order) if order else F.lit(0))).alias(c) for c in cols]
    monthly = df.groupBy(*keys, season, month).agg(*first)
    return monthly.groupBy(*keys, season).agg(*[F.when(F.count(c) == months, PERIOD_FUNCTIONS[f](F.col(c))).alias(n) for n, (c, f) in summaries.items()])


def complete_periods(df: DataFrame, keys: list[str], period: str, day: str, value: str, least: int, function: str = "mean") -> DataFrame:
    """Summary of each key and period, only of periods that have at least so many distinct days anywhere in the data."""
    full = df.groupBy(period).agg(F.count_distinct(day).alias("n_days")).where(F.col("n_days") >= least)
    return df.join(full, period, "left_semi").groupBy(*keys, period).agg(PERIOD_FUNCTIONS[function](F.col(value)).alias("value"))


def degree_days(low: Column, high: Column, base: float = 5.0, cap: float = 30.0) -> Column:
    """Growing degree days of one day: mean of minimum and capped maximum above the base, not below zero; null if either is."""
    mean = (low + F.when(high.isNotNull(), F.least(high, F.lit(cap)))) / 2 - base
    return F.when(mean.isNotNull(), F.greatest(F.lit(0.0), mean))


def frost_day(low: Column, vapour: Column, low_limit: float = 2.0, vapour_limit: float = 4.0) -> Column:
    return (low < low_limit) & (vapour < vapour_limit)


def heat_day(high: Column, threshold: float = 30.0) -> Column:
    return high > threshold


def totals(df: DataFrame, keys: list[str], part: str, value: Column, name: str, label: str = "Total") -> DataFrame:
    """Detail rows for each part and an overall row named ``label``; a null part is a row of its own."""
    out = df.rollup(*keys, part).agg(value.alias(name), F.grouping(part).alias("__g"), *([F.grouping(keys[-1]).alias("__k")] if keys else []))
    out = out.where("__k = 0") if keys else out
    return out.select(*keys, F.when(F.col("__g") == 1, label).otherwise(F.col(part)).alias(part), name)


def compliance(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Expected against actual counts: absent counts are 0; ratio is 2 where nothing was expected but something done."""
    j = join_ns(expected, actual, keys, "left").withColumns({"expected": F.coalesce("expected", F.lit(0).cast("long")), "actual": F.coalesce("actual", F.lit(0).cast("long"))})
    ratio = F.when(F.col("expected") > 0, F.col("actual") / F.col("expected")).when(F.col("actual") > 0, 2.0)
    return j.withColumns({"difference": F.col("actual") - F.col("expected"), "ratio": F.round(ratio, 4)})


def registry(df: DataFrame, keys: list[str], lon: str, lat: str, day: str, as_of: object, current_days: float) -> DataFrame:
    """One row for each site: rounded coordinates, how many different ones, last day, and whether it is current."""
    g = df.groupBy(*keys).agg(F.min(F.round(lon, 4)).alias(lon), F.min(F.round(lat, 4)).alias(lat), F.count_distinct(F.struct(F.round(lon, 4), F.round(lat, 4))).alias("n_places"), F.max(day).alias("last_day"))
    return g.withColumn("is_current", F.coalesce(F.datediff(F.lit(as_of), "last_day") <= current_days, F.lit(False)))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of each pair of values, nulls included."""
    return df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def mode_of(df: DataFrame, columns: list[Column], name: str) -> DataFrame:
    """The commonest value over several columns, nulls left out; ties go to the smallest."""
    v = df.select(F.explode(F.array(*columns)).alias(name)).where(F.col(name).isNotNull())
    return v.groupBy(name).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), name).limit(1)


def row_counts(cols: list[Column]) -> dict[str, Column]:
    """Row-wise n_present, n_positive, total and top over columns; total and top are null if all are."""
    n = sum((c.isNotNull().cast("int") for c in cols), F.lit(0))
    pos = sum((F.coalesce((c > 0).cast("int"), F.lit(0)) for c in cols), F.lit(0))
    tot = F.when(n > 0, sum((F.coalesce(c, F.lit(0)) for c in cols), F.lit(0)))
    return {"n_present": n, "n_positive": pos, "total": tot, "top": F.greatest(*cols)}


def strict_row_sum(cols: list[Column]) -> Column:
    """Row-wise sum that is null if any part is."""
    out = cols[0]
    for c in cols[1:]:
        out = out + c
    return out


def ordered_labels(df: DataFrame, keys: list[str], label: str, order: str, sep: str = " -> ") -> DataFrame:
    """(keys, trail, labels): distinct labels joined in order of first occurrence, and sorted by name."""
    first = df.where(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.min(order).alias("__o"))
    g = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__o", label))).alias("__l"))
    by_time = F.array_join(F.transform("__l", lambda x: x[label]), sep)
    return g.select(*keys, by_time.alias("trail"), F.array_join(F.array_sort(F.transform("__l", lambda x: x[label])), " & ").alias("labels"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) of each pair of columns over rows that have both, from one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    both = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull()
    one = df.agg(*[F.corr(F.when(both(a, b), F.col(a)), F.when(both(a, b), F.col(b))).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(f"c{i}", 6).alias("r")) for i, (a, b) in enumerate(pairs)])))


def aligned_layers(a: DataFrame, b: DataFrame, keys: list[str], order: str, values: dict[str, str], *, most: int = 14) -> DataFrame:
    """(keys, layer_no, a, b): the layers of two stacks side by side by their number, cut to the shorter stack.

    ``values`` names the value column of each side. Fails if the stacks of a key differ by more than ``most`` layers.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(order)
    number = lambda df, n: df.select(*keys, F.row_number().over(w).alias("layer_no"), F.col(values[n]).alias(n), F.lit(True).alias(f"__{n}"))
    j = join_ns(number(a, "a"), number(b, "b"), [*keys, "layer_no"], "full")
    every = Window.partitionBy(*keys)
    gap = F.abs(F.count("__a").over(every) - F.count("__b").over(every))
    ok = F.when(gap > most, F.raise_error(F.concat(F.lit(f"stacks differ by more than {most} layers: "), gap.cast("string"))).cast("boolean")).otherwise(F.col("__a") & F.col("__b"))
    return j.withColumn("__ok", ok).where("__ok").select(*keys, "layer_no", "a", "b")


def site_proportions(df: DataFrame, area: list[str], site: list[str], count: str, digits: int = 2) -> DataFrame:
    """(area, n_sites, n_present, proportion): distinct sites, those with any positive count, and their share, rounded."""
    one = df.groupBy(*area, *site).agg(F.coalesce(F.bool_or(F.col(count) > 0), F.lit(False)).alias("__p"))
    g = one.groupBy(*area).agg(F.count(F.lit(1)).alias("n_sites"), F.count_if("__p").alias("n_present"))
    return g.withColumn("proportion", F.round(F.col("n_present") / F.col("n_sites"), digits))


def effort_counts(df: DataFrame, keys: list[str], response: str) -> DataFrame:
    """(keys, n_surveys): rows of each group that have a response, one row for each group that has any."""
    return df.where(F.col(response).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_surveys"))


def mean_session_rate(df: DataFrame, site: str, session: str, success: str, effort: str) -> DataFrame:
    """(site, mean_rate): mean over a site's sessions of each session's mean nightly rate in per cent, a night's rate being 100 at most.

    Rates are decimals of six places, so their sums do not depend on the order of the rows.
    """
    night = F.round(F.least(F.col(success) / F.nullif(effort, F.lit(0.0)), F.lit(1.0)) * 100, 6).cast("decimal(18,6)")
    d = df.where(F.col(success).isNotNull() & F.col(effort).isNotNull())
    mean = lambda c: F.sum(c).cast("double") / F.nullif(F.count(c), F.lit(0))
    s = d.groupBy(site, session).agg(F.round(mean(night), 6).cast("decimal(18,6)").alias("__s"))
    return s.groupBy(site).agg(F.round(mean(F.col("__s")), 4).alias("mean_rate"))


def headline(df: DataFrame, area: str, site: str, success: str, effort: str, start: str, end: str) -> DataFrame:
    """One row: distinct areas and sites (case aside), successes, their share of the effort in per cent (0 without effort), and the first and last day."""
    pct = F.when(F.sum(effort) > 0, 100 * F.sum(success) / F.sum(effort)).otherwise(0.0)
    return df.agg(F.count_distinct(F.lower(area)).alias("n_regions"), F.count_distinct(F.lower(site)).alias("n_sites"), F.sum(success).alias("mice"), F.round(pct, 4).alias("pct"), F.min(start).alias("first_day"), F.max(end).alias("last_day"))


def overview(df: DataFrame, keys: list[str], value: str, site: str, high: float) -> DataFrame:
    """(keys, n_rows, traps, least, most, n_sites, any_high): sum and range of a value, distinct sites, and whether any value is above ``high``."""
    x = F.col(value)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum(x), 2).alias("traps"), F.round(F.min(x), 2).alias("least"), F.round(F.max(x), 2).alias("most"), F.count_distinct(site).alias("n_sites"), F.bool_or(x > high).alias("any_high"))


def night_summary(df: DataFrame, night: list[str], keys: list[str], effort: str, catch: str) -> DataFrame:
    """(keys, n_nights, trap_nights, captures, success_pct) from distinct nights, a night entered more than once counting with its largest values."""
    n = df.groupBy(*night).agg(F.max(effort).alias("__t"), F.max(catch).alias("__m"))
    pct = 100 * F.sum("__m") / F.nullif(F.sum("__t"), F.lit(0.0))
    return n.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_nights"), F.sum("__t").alias("trap_nights"), F.sum("__m").alias("captures"), F.round(pct, 4).alias("success_pct"))


def level_of(x: Column, low: float, high: float, *, closed: bool = False) -> Column:
    """'No data' for null, else Low below ``low`` (up to it if ``closed``), Moderate below ``high``, High from there on."""
    under = (lambda c, v: c <= v) if closed else (lambda c, v: c < v)
    return F.when(x.isNull(), "No data").when(under(x, low), "Low").when(under(x, high), "Moderate").otherwise("High")


def area_report(df: DataFrame, area: str, site: str, count: str, low: float, high: float) -> DataFrame:
    """(area, n_sites, n_surveys, pct_detected, level): surveys with a count, the share of them with any, and its level."""
    z = df.groupBy(area).agg(F.count_distinct(site).alias("n_sites"), F.count(count).alias("n_surveys"), F.round(100.0 * F.count_if(F.col(count) > 0) / F.nullif(F.count(count), F.lit(0)), 4).alias("pct_detected"))
    return z.withColumn("level", level_of(F.col("pct_detected"), low, high, closed=True))


def mean_ratio(df: DataFrame, keys: list[str], success: str, effort: str, name: str) -> DataFrame:
    """(keys, name): mean of the rows' ratios; rows without effort have none."""
    return df.groupBy(*keys).agg(F.round(F.avg(F.col(success) / F.nullif(effort, F.lit(0.0))), 6).alias(name))


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str = "place") -> DataFrame:
    """``name``: the row's place in an order within the keys; the order says where nulls go and has to be total."""
    from pyspark.sql import Window

    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
