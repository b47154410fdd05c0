"""Complete panels, filling, lags and rolling windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrat.functions.nullsafe import join_ns
from quadrat.sources.tables import cut


def month_panel(sites: DataFrame, obs: DataFrame | None, keys: list[str], month: str, first: object, last: object) -> DataFrame:
    """Every site in every month from first to last: its observations, or exactly one row of nulls; the bare grid without ``obs``."""
    grid = sites.select(*keys).distinct().select("*", F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("interval 1 month"))).alias(month))
    return grid if obs is None else join_ns(grid, obs, [*keys, month], "left")


def season_panel(df: DataFrame, keys: list[str], ordinal: str, extra: int = 1) -> DataFrame:
    """(keys, ordinal): each key from its first season to its last and ``extra`` more."""
    g = df.where(F.col(ordinal).isNotNull()).groupBy(*keys).agg(F.min(ordinal).alias("__a"), F.max(ordinal).alias("__b"))
    return g.select(*keys, F.explode(F.sequence(F.col("__a"), F.col("__b") + extra)).alias(ordinal))


def complete_nights(df: DataFrame, site: list[str], time: str, night: str) -> DataFrame:
    """Each site with all times of the data and nights 1 to its own longest; what is not in ``df`` is null."""
    times = df.agg(F.array_sort(F.collect_set(time)).alias("t")).scalar()  # the distinct steps of the calendar
    g = df.groupBy(*site).agg(F.max(night).alias("__m")).where("__m >= 1").withColumn("__t", times)
    grid = g.select(*site, F.explode("__t").alias(time), "__m").select(*site, time, F.explode(F.sequence(F.lit(1), "__m")).alias(night))
    return join_ns(grid, df, [*site, time, night], "left")


def survey_grid(df: DataFrame, site: list[str], time: str, combo: list[str], observed: list[str], site_time: list[str]) -> DataFrame:
    """Each site's combinations (method, night) at each of its times; observations where made, ``site_time`` columns from the same site and time."""
    combos = df.select(*site, *combo).distinct().groupBy(*site).agg(F.collect_set(F.struct(*combo)).alias("__c"))
    times = df.groupBy(*site, time).agg(*[F.min(c).alias(c) for c in site_time])
    grid = join_ns(times, combos, site, "left").select(*site, time, *site_time, F.inline("__c"))
    return join_ns(grid, df.select(*site, time, *combo, *observed), [*site, time, *combo], "left")


def fill_downup(df: DataFrame, keys: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """Nulls filled by the last value before, else by the next one after, within the keys."""
    w = Window.partitionBy(*keys).orderBy(*order)
    down, up = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    return df.withColumns({c: F.coalesce(F.last(c, True).over(down), F.first(c, True).over(up)) for c in columns})


def in_ranges(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` in ranges of its order, stored, with the number of each row's range in ``__b``; rows alike in the order are in one range."""
    r = df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order]).withColumn("__b", F.spark_partition_id())
    return cut(r)


def numbered(df: DataFrame, order: list[str], name: str = "row_no") -> DataFrame:
    """``name``: the row's number, from 1, in the order of the whole table, which has to be a total one; no task sees more than a range of it."""
    d = in_ranges(df, order)
    sizes = d.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row for each range
    starts = F.broadcast(sizes.select("__b", before.alias("__s")))
    w = Window.partitionBy("__b").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    return d.join(starts, "__b").withColumn(name, F.col("__s") + F.row_number().over(w)).select(*df.columns, name)


def bind_columns(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str]) -> DataFrame:
    """Rows of two tables side by side, bound by their place in a stated order; the longer one's surplus rows get nulls. Clashing columns of ``right`` get '_right'."""
    a, b = numbered(left, left_order, "__i"), numbered(right, right_order, "__i")
    return join_ns(a, b, ["__i"], "full").drop("__i")


def locf(df: DataFrame, order: list[str], columns: list[str], *, keys: list[str] | None = None) -> DataFrame:
    """Last value carried on, then the first carried back; by default over the whole frame in its order, across groups.

    Without keys the frame is cut into ranges of the whole order; only each range's last and first values cross to
    others, as a scan over one row for each range, so that no task sees the whole frame.
    """
    by = [F.col(c).asc_nulls_first() for c in order]
    if keys:
        return fill_downup(df, keys, by, columns)
    d = in_ranges(df, order)
    w = Window.partitionBy("__b").orderBy(*by)
    down, up = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    key = F.struct(*[F.struct(F.col(c).isNotNull(), F.col(c)) for c in order])
    ends = d.groupBy("__b").agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), key)).alias(f"__l_{c}") for c in columns], *[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), key)).alias(f"__f_{c}") for c in columns])
    g = Window.orderBy("__b")  # one row for each range
    ends = ends.select("__b", *[F.last(f"__l_{c}", True).over(g.rowsBetween(Window.unboundedPreceding, -1)).alias(f"__p_{c}") for c in columns], *[F.first(f"__f_{c}", True).over(g.rowsBetween(1, Window.unboundedFollowing)).alias(f"__n_{c}") for c in columns])
    j = d.join(F.broadcast(ends), "__b", "left")
    return j.withColumns({c: F.coalesce(F.last(c, True).over(down), F.col(f"__p_{c}"), F.first(c, True).over(up), F.col(f"__n_{c}")) for c in columns}).select(*df.columns)


def running_headers(df: DataFrame, levels: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``{level}_header``: a level's value on the first row of each of its runs in the order, null on the rows below it; a level starts anew when one above it does."""
    out = df
    for i, c in enumerate(levels):
        w = Window.partitionBy(*levels[: i + 1]).orderBy(*order)
        out = out.withColumn(f"{c}_header", F.when(F.row_number().over(w) == 1, F.col(c)))
    return out


def lags(df: DataFrame, keys: list[str], order: str, columns: list[str], k: int) -> DataFrame:
    """``{column}_lag1`` to ``_lagk`` by rows in order."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumns({f"{c}_lag{i}": F.lag(c, i).over(w) for c in columns for i in range(1, k + 1)})


def rolling_sum(c: Column, keys: list[str], order: str, n: int) -> Column:
    """Sum of the last n rows, null unless there are n with a value."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(n - 1), 0)
    return F.when(F.count(c).over(w) == n, F.sum(c).over(w))


def lag_array(df: DataFrame, keys: list[str], order: str, column: str, n: int, name: str) -> DataFrame:
    """``name``: the values at lags 0 to n - 1; the first n - 1 rows of a series are dropped."""
    w = Window.partitionBy(*keys).orderBy(order)
    out = df.withColumn("__r", F.row_number().over(w)).withColumn(name, F.array(*[F.lag(column, i).over(w) for i in range(n)]))
    return out.where(F.col("__r") >= n).drop("__r")


def one_hot(c: Column, levels: list[str], prefix: str) -> dict[str, Column]:
    """0/1 columns for each level, names cleaned; a null is 0 in all."""
    import re

    return {f"{prefix}_{re.sub(r'[^a-z0-9]+', '_', lv.lower()).strip('_')}": F.coalesce((c == lv).cast("int"), F.lit(0)) for lv in levels}


def time_index(df: DataFrame, ordinal: str, name: str = "time") -> DataFrame:
    """Dense rank of the ordinal over the whole table, from its distinct values; null stays null."""
    steps = df.agg(F.array_sort(F.collect_set(ordinal)).alias("s")).scalar()  # the distinct steps of the calendar
    return df.withColumn("__s", steps).withColumn(name, F.nullif(F.array_position("__s", F.col(ordinal)), F.lit(0)).cast("int")).drop("__s")


def split_at(df: DataFrame, ordinal: str, boundary: int, name: str = "part") -> DataFrame:
    """'train' up to the boundary, 'test' after it; rows without an ordinal are in neither (null)."""
    return df.withColumn(name, F.when(F.col(ordinal) <= boundary, "train").when(F.col(ordinal) > boundary, "test"))


def equal_length(df: DataFrame, series: str, time: str) -> DataFrame:
    """(series, n_times, is_complete): whether each series has as many steps as the longest."""
    g = df.groupBy(series).agg(F.count_distinct(time).alias("n_times"))
    return g.withColumn("is_complete", F.col("n_times") == g.agg(F.max("n_times")).scalar())
