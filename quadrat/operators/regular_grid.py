"""Irregular readings onto a regular grid, with neighbours on both sides of every gap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def regular_grid(
    readings: DataFrame,
    source: list[str],
    step: Column,
    value: Column,
    *,
    max_gap: int | None = None,
) -> DataFrame:
    """One row for each source and grid step from its first to its last reading.

    ``step`` is the integer grid position of a reading (season, month or day number); rows in which
    it is null are no readings. Columns: the source, ``step``, ``n_readings``, ``value`` (mean of the
    readings' non-null values; for an unread step the time-weighted linear interpolation between the
    neighbours that have a value, null where they lie more than ``max_gap`` steps apart), ``prev_step``,
    ``next_step`` (the readings on both sides, equal to ``step`` where it was read) and ``status``
    ('read', 'filled', 'gap').

    Readings are first summed by source and step, with partial sums before the shuffle, so a source is
    never longer than its grid, however many readings it has. The as-of merge of grid and readings is
    then a lead over the read steps: each pair of neighbours emits the steps between them.
    A source with a single reading gives one row; an empty input gives none.
    """
    v = value.cast("double")
    v = F.when(~F.isnan(v), v)
    cells = (
        readings.select(*source, step.cast("int").alias("step"), v.alias("_v"))
        .where(F.col("step").isNotNull())
        .groupBy(*source, "step")
        .agg(F.count(F.lit(1)).alias("n_readings"), F.sum("_v").alias("_s"), F.count("_v").alias("_k"))
        .withColumn("value", F.col("_s") / F.nullif("_k", F.lit(0)))
    )
    after = Window.partitionBy(*source).orderBy("step")
    known = F.when(F.col("value").isNotNull(), F.struct(F.col("step").alias("s"), F.col("value").alias("v")))
    cells = cells.select(
        *source,
        "step",
        "n_readings",
        "value",
        F.lead("step").over(after).alias("_next"),
        F.last(known, True).over(after.rowsBetween(Window.unboundedPreceding, 0)).alias("_a"),
        F.first(known, True).over(after.rowsBetween(1, Window.unboundedFollowing)).alias("_b"),
    )
    last = F.coalesce(F.col("_next") - 1, F.col("step"))
    rows = cells.select("*", F.explode(F.sequence(F.col("step"), last)).alias("_g"))
    unread = F.col("_g") > F.col("step")
    a, b = F.col("_a"), F.col("_b")
    near = F.lit(True) if max_gap is None else (b["s"] - a["s"] <= max_gap)
    between = F.when(near, a["v"] + (b["v"] - a["v"]) * (F.col("_g") - a["s"]) / (b["s"] - a["s"]))
    return rows.select(
        *source,
        F.col("_g").alias("step"),
        F.when(unread, F.lit(0).cast("long")).otherwise(F.col("n_readings")).alias("n_readings"),
        F.when(unread, between).otherwise(F.col("value")).alias("value"),
        F.when(unread, F.col("step")).otherwise(F.col("_g")).alias("prev_step"),
        F.when(unread, F.col("_next")).otherwise(F.col("_g")).alias("next_step"),
        F.when(~unread, "read").when(between.isNotNull(), "filled").otherwise("gap").alias("status"),
    )


def time_grid(readings: DataFrame, source: list[str], at: str, every: str, value: Column, *, max_gap: str | None = None) -> DataFrame:
    """One row for each source and point of a grid of times (whole steps of ``every`` since 1970, such as '1 hour') from its first to its last reading.

    Columns: the source, ``grid_at``, ``n_readings`` (those from this point until the next one), ``value``, ``prev_at`` and ``next_at`` (the
    readings on both sides, both the point itself where it was read) and ``status`` ('read', 'filled', 'gap'). The value is that of a
    reading at the point, else the time-weighted linear interpolation between the two readings, null where they are further apart than
    ``max_gap``. Readings of one time are averaged; those without a time or a value, or whose value is NaN, are none. A source none of
    whose points lies between its readings has no row.

    Only the first and the last reading of each step can be neighbours of a point, so each step is reduced to those two before a
    source is put in order: a source is never longer than its grid, however many readings it has.
    """
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    step = readings.sparkSession.range(1).select(F.expr(f"unix_micros(TIMESTAMP_SECONDS(0) + INTERVAL {every})")).scalar()
    v = value.cast("double")
    r = readings.select(*source, micros(F.col(at)).alias("_t"), F.when(~F.isnan(v), v).alias("_v")).where("_t IS NOT NULL AND _v IS NOT NULL")
    r = r.groupBy(*source, "_t").agg(F.avg("_v").alias("_v"), F.count(F.lit(1)).alias("_k")).withColumn("_s", step)
    one = F.struct("_t", "_v")
    cells = r.groupBy(*source, "_s", F.floor(F.col("_t") / F.col("_s")).alias("_c")).agg(F.min(one).alias("_first"), F.max(one).alias("_last"), F.sum("_k").alias("_n"))
    w = Window.partitionBy(*source).orderBy("_c")
    cells = cells.withColumns({"_before": F.lag("_last").over(w), "_c0": F.lag("_c").over(w)})
    # the points after the step before, up to this step's own if there is a reading before it or at it
    on = F.col("_first._t") == F.col("_c") * F.col("_s")
    points = F.when(F.col("_before").isNotNull(), F.sequence(F.col("_c0") + 1, F.col("_c"))).when(on, F.array(F.col("_c")))
    g = cells.select(*source, "_s", "_c", "_n", "_first", "_before", F.explode(points).alias("_g"))
    t = F.col("_g") * F.col("_s")
    read = F.col("_first._t") == t
    gap = F.lit(None).cast("long") if max_gap is None else readings.sparkSession.range(1).select(F.expr(f"unix_micros(TIMESTAMP_SECONDS(0) + INTERVAL {max_gap})")).scalar()
    a, b = F.col("_before"), F.col("_first")
    near = F.lit(True) if max_gap is None else (b["_t"] - a["_t"] <= gap)
    between = F.when(near, a["_v"] + (b["_v"] - a["_v"]) * (t - a["_t"]) / (b["_t"] - a["_t"]))
    time = lambda c: F.timestamp_micros(c)
    return g.select(
        *source,
        time(t).alias("grid_at"),
        F.when(F.col("_g") == F.col("_c"), F.col("_n")).otherwise(0).alias("n_readings"),
        F.when(read, b["_v"]).otherwise(between).alias("value"),
        time(F.when(read, t).otherwise(a["_t"])).alias("prev_at"),
        time(b["_t"]).alias("next_at"),
        F.when(read, "read").when(between.isNotNull(), "filled").otherwise("gap").alias("status"),
    )
