"""The whole way from recorded nights to a model table: one lazy plan of the library's operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.functions import calendar as cal
from quadrat.functions.missing import count_missing, text_missing
from quadrat.functions.nullsafe import join_ns, pct_deviation
from quadrat.operators import aggregates, clean, filters, nearby, panel, response, sessions, spatial
from quadrat.operators.clean import crop_ladder
from quadrat.plans.registry import Registry
from quadrat.sources.tables import table

R = Registry()
BOX = (110.0, 155.0, -45.0, -10.0)


@dataclass(frozen=True)
class Options:
    """What a run may choose; filters that the reference has for testing are off."""

    exclude: dict[str, tuple] | None = None
    combine: bool = True
    same_crop: bool = True
    method: str = "highest_effort"
    n_lags: int = 4
    more_than: int = 1
    first: str = "2008-12-01"
    last: str = "2025-11-01"


def clean_nights(nights: DataFrame, options: Options) -> DataFrame:
    """Distinct nights with clean text, categories, valid effort and catch, and their season."""
    n = clean.blank_to_null(nights, ["crop_type", "crop_stage", "farmer"]).distinct()
    n = n.withColumn("crop_type", F.when(~text_missing(F.col("crop_type")), F.col("crop_type")))
    n = n.withColumns({c: F.when(~count_missing(F.col(c), high=1000.0), F.col(c)) for c in ("traps_set", "phantoms", "mice_night")})
    n = n.withColumns({
        "crop_category": clean.broad_category(F.col("crop_type"), F.col("crop_stage"), crop_ladder()),
        "effort": clean.functional_effort(F.col("traps_set"), F.col("phantoms")),
        "season_ord": cal.season_ord(F.coalesce("session_start_date", "date")),
    })
    n = n.where(filters.ordinal_between(F.col("season_ord"), 2009 * 4 - 1, 2026 * 4))
    return filters.exclude(n, options.exclude or {})


def seasonal_covariate(cells: DataFrame, raster: DataFrame, options: Options) -> DataFrame:
    """(row, col, season_ord, cov, cov_pctdev): strict three-month means of a monthly raster in each cell, and the deviation from its season's mean.

    Worked out for the cells that hold sites, which are far fewer than the sites.
    """
    m = panel.month_panel(cells, None, ["row", "col"], "month", options.first, options.last)
    m = m.withColumn("layer_key", F.concat_ws("-", F.year("month"), F.month("month"))).join(raster.select("layer_key", "row", "col", F.col("value").alias("v")), ["layer_key", "row", "col"], "left")
    m = m.withColumn("season_ord", cal.season_ord(F.col("month")))
    s = aggregates.seasonal_strict(m, ["row", "col"], "season_ord", "month", {"cov": ("v", "mean")})
    s = s.withColumn("season", F.pmod(F.col("season_ord"), F.lit(4)))
    normal = s.groupBy("row", "col", "season").agg(F.avg("cov").alias("normal"))
    return s.join(normal, ["row", "col", "season"]).select("row", "col", "season_ord", "cov", pct_deviation(F.col("cov"), F.col("normal")).alias("cov_pctdev"))


def model_table(nights: DataFrame, sites: DataFrame, raster: DataFrame, grid: dict[str, float], options: Options = Options()) -> DataFrame:
    """One row for each site and season of its panel (night 1 of the chain), with response, weight, lags, time and series.

    Every series is as long as its site's panel; seasons without a survey have a null response. Sites with no more than
    ``more_than`` observed seasons are left out.
    """
    key = ["site_data_id", "season_ord"]
    n = clean_nights(nights, options)
    chain = sessions.resolve_repeats(n, key, "session_start_date", "survey_night", "effort", "mice_night", crop="crop_category", combine=options.combine, same_crop=options.same_crop, method=options.method)
    total = chain.groupBy(*key).agg(F.sum("effort").alias("n_trial"), F.sum("mice_night").alias("n_success"), F.min("crop_category").alias("crop_category"), F.max("survey_night").alias("nights"))
    b = response.beta_response(F.col("n_success"), F.col("n_trial"))
    full = join_ns(panel.season_panel(total, ["site_data_id"], "season_ord", extra=1), total, key, "left").withColumns({"n_success": b["n_success"]})
    full = full.withColumn("mice_prop", response.beta_response(F.col("n_success"), F.col("n_trial"))["mice_prop"])
    full = filters.min_observed(full, ["site_data_id"], "mice_prop", options.more_than)
    row, col = spatial.cell_of(F.col("longitude"), F.col("latitude"), grid)
    placed = sites.withColumns({"row": row, "col": col})
    cov = seasonal_covariate(placed.select("row", "col").where("row IS NOT NULL").distinct(), raster, options)
    cov = panel.lags(cov, ["row", "col"], "season_ord", ["cov_pctdev"], options.n_lags)
    full = panel.fill_downup(full, ["site_data_id"], [F.col("season_ord")], ["crop_category"])
    full = panel.time_index(full, "season_ord")
    lat = join_ns(full, placed, ["site_data_id"], "left").join(cov, ["row", "col", "season_ord"], "left")
    return lat.select(
        "site_data_id", "season_ord", cal.ord_label(F.col("season_ord")).alias("season_year_adj"), "time", response.series_key(F.lit("site"), F.col("site_data_id")).alias("series"),
        "crop_category", "nights", "n_trial", "n_success", F.round("mice_prop", 6).alias("mice_prop"), F.when(F.col("nights") > 1, 1.0).otherwise(0.25).alias("obs_weight"),
        F.when(F.col("latitude") > -30, "north").otherwise("south").alias("north"), *[F.round(f"cov_pctdev_lag{i}", 4).alias(f"cov_pctdev_lag{i}") for i in range(1, options.n_lags + 1)],
    )


@R.add()
def model_data(spark: SparkSession, d: str) -> DataFrame:
    """The model table of the trap nights; the raster is their own mean catch by month and half degree."""
    from quadrat.plans.models import GRID, _raster

    nights = table(spark, d, "data_monitoring_traps_clean", "site_data_id", "farmer", "date", "session_start_date", "survey_night", "crop_type", "crop_stage", "trap_type", "traps_set", "phantoms", "mice_night")
    sites = table(spark, d, "site_data", "site_data_id", "longitude", "latitude")
    ok = nearby.in_box(F.col("longitude"), F.col("latitude"), BOX)
    sites = sites.withColumns({c: F.when(ok, F.col(c)) for c in ("longitude", "latitude")})
    return model_table(nights, sites, _raster(spark, d), GRID)


QUERIES, SQL = R.queries, R.sql
