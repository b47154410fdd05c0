"""Queries on space, responses, draws, reports and data quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.functions import calendar as cal
from quadrat.operators import aggregates, forecast, nearby, quality, response, spatial
from quadrat.plans.cleaning import ord_sql
from quadrat.plans.registry import Registry
from quadrat.plans.summaries import MONTHLY, monthly
from quadrat.sources.tables import table

R = Registry()
TRAPS, VISITS = "data_monitoring_traps_clean", "data_deduplicate_surveys_season"
BOX = (110.0, 155.0, -45.0, -10.0)
GRID = {"xmin": 110.0, "ymax": -10.0, "dx": 0.5, "dy": 0.5, "nrow": 70, "ncol": 90}
_OK = "longitude BETWEEN 110 AND 155 AND latitude BETWEEN -45 AND -10"

# space -----------------------------------------------------------------------------------------------------

_EDGES = "e AS (SELECT ae_zone, piece_no, lons[i] AS x1, lats[i] AS y1, lons[i + 1] AS x2, lats[i + 1] AS y2 FROM (SELECT ae_zone, piece_no, lons, lats, unnest(generate_series(1, len(lons) - 1)) AS i FROM ae_zones))"


@R.add(f"""WITH {_EDGES}, p AS (SELECT site_data_id, longitude AS x, latitude AS y FROM site_data WHERE {_OK}),
  c AS (SELECT site_data_id, ae_zone, piece_no FROM p JOIN e ON (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / nullif(y2 - y1, 0) + x1 GROUP BY ALL HAVING count(*) % 2 = 1)
  SELECT site_data_id, coalesce(min(ae_zone), 'default') AS ae_zone FROM p LEFT JOIN c USING (site_data_id) GROUP BY 1""")
def point_in_polygon(spark: SparkSession, d: str) -> DataFrame:
    pts = table(spark, d, "site_data", "site_data_id", "longitude", "latitude").where(nearby.in_box(F.col("longitude"), F.col("latitude"), BOX))
    out = nearby.containing_region(pts, "site_data_id", "longitude", "latitude", table(spark, d, "ae_zones"), "ae_zone", "piece_no", none="default")
    return out.select("site_data_id", F.col("region").alias("ae_zone"))


_RASTER = f"""(SELECT year(date) || '-' || month(date) AS layer_key, CAST(floor((-10 - latitude) / 0.5) AS INTEGER) AS row, CAST(floor((longitude - 110) / 0.5) AS INTEGER) AS col, avg(mice_night) AS value FROM data_monitoring_traps_clean WHERE {_OK} AND date IS NOT NULL GROUP BY ALL)"""


def _raster(spark: SparkSession, d: str) -> DataFrame:
    """A raster of the test data's own: mean catch by month and half degree."""
    t = table(spark, d, TRAPS, "date", "longitude", "latitude", "mice_night").where(nearby.in_box(F.col("longitude"), F.col("latitude"), BOX) & F.col("date").isNotNull())
    row, col = spatial.cell_of(F.col("longitude"), F.col("latitude"), GRID)
    return t.groupBy(F.concat_ws("-", F.year("date"), F.month("date")).alias("layer_key"), row.alias("row"), col.alias("col")).agg(F.avg("mice_night").alias("value"))


@R.add(f"""WITH r AS {_RASTER}, p AS (SELECT long_id, s.longitude, s.latitude, year(l.session_start_date) || '-' || month(l.session_start_date) AS k FROM data_long l JOIN site_data s USING (site_data_id))
  SELECT long_id, round(value, 6) AS mice_month FROM p LEFT JOIN r ON r.layer_key = k AND p.{_OK.replace("AND latitude", "AND p.latitude")} AND r.row = floor((-10 - latitude) / 0.5) AND r.col = floor((longitude - 110) / 0.5)""")
def raster_lookup(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "data_long", "long_id", "site_data_id", "session_start_date").join(table(spark, d, "site_data", "site_data_id", "longitude", "latitude"), "site_data_id")
    layer = F.concat_ws("-", F.year("session_start_date"), F.month("session_start_date"))
    return spatial.raster_values(p, "longitude", "latitude", layer, _raster(spark, d), GRID, "v").select("long_id", F.round("v", 6).alias("mice_month"))


@R.add(f"""WITH r AS {_RASTER} SELECT layer_key, CAST(row // 4 AS INTEGER) AS row, CAST(col // 4 AS INTEGER) AS col, round(avg(value), 6) AS value FROM r GROUP BY ALL""")
def raster_resample(spark: SparkSession, d: str) -> DataFrame:
    return spatial.resample(_raster(spark, d), 4).withColumn("value", F.round("value", 6))


@R.add(f"""WITH r AS {_RASTER}, p AS (SELECT site_data_id, floor((-10 - latitude) / 0.5) AS pr, floor((longitude - 110) / 0.5) AS pc FROM site_data WHERE {_OK})
  SELECT site_data_id, layer_key, round(avg(value), 6) AS value FROM p JOIN r ON r.row BETWEEN pr - 1 AND pr + 1 AND r.col BETWEEN pc - 1 AND pc + 1 GROUP BY ALL""")
def raster_buffered_mean(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "site_data", "site_data_id", "longitude", "latitude").where(nearby.in_box(F.col("longitude"), F.col("latitude"), BOX))
    return spatial.buffered_mean(s, "site_data_id", "longitude", "latitude", _raster(spark, d), GRID, 1).withColumn("value", F.round("value", 6))


@R.add(f"""SELECT region, round(coalesce(min(longitude) FILTER ({_OK}) - 0.5, 110), 6) AS xmin, round(coalesce(max(longitude) FILTER ({_OK}) + 0.5, 155), 6) AS xmax, round(coalesce(min(latitude) FILTER ({_OK}) - 0.5, -45), 6) AS ymin, round(coalesce(max(latitude) FILTER ({_OK}) + 0.5, -10), 6) AS ymax FROM site_data GROUP BY region""")
def region_boxes(spark: SparkSession, d: str) -> DataFrame:
    ok = nearby.in_box(F.col("longitude"), F.col("latitude"), BOX)
    s = table(spark, d, "site_data", "region", "longitude", "latitude").withColumns({"x": F.when(ok, F.col("longitude")), "y": F.when(ok, F.col("latitude"))})
    b = spatial.bounding_box(s, ["region"], "x", "y", 0.5, BOX)
    return b.select("region", *[F.round(c, 6).alias(c) for c in ("xmin", "xmax", "ymin", "ymax")])


@R.add(f"""SELECT site_data_id, 65 AS n_points, 10000.0::DOUBLE AS least_m, 10000.0::DOUBLE AS most_m FROM site_data WHERE {_OK}""")
def site_buffers(spark: SparkSession, d: str) -> DataFrame:
    """Rings of 10 km around paddocks, with the least and the greatest distance of their points."""
    s = table(spark, d, "site_data", "site_data_id", "longitude", "latitude").where(nearby.in_box(F.col("longitude"), F.col("latitude"), BOX))
    b = spatial.buffers(s, "site_data_id", "longitude", "latitude", 10_000.0).join(s, "site_data_id")
    far = F.transform(F.arrays_zip("lons", "lats"), lambda p: nearby.haversine_m(F.col("longitude"), F.col("latitude"), p["lons"], p["lats"]))
    return b.select("site_data_id", F.size("lons").alias("n_points"), F.round(F.array_min(far), 3).alias("least_m"), F.round(F.array_max(far), 3).alias("most_m"))


@R.add(f"""WITH p AS (SELECT DISTINCT region, longitude AS x, latitude AS y FROM site_data WHERE {_OK}), k AS (SELECT region, count(*) AS n FROM p GROUP BY 1),
  e AS (SELECT a.region, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM p a JOIN p b ON a.region = b.region AND (a.x, a.y) <> (b.x, b.y) WHERE NOT EXISTS (SELECT 1 FROM p c WHERE c.region = a.region AND ((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < 0
    OR ((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) = 0 AND NOT (c.x BETWEEN least(a.x, b.x) AND greatest(a.x, b.x) AND c.y BETWEEN least(a.y, b.y) AND greatest(a.y, b.y))))))
  SELECT region, CASE WHEN n = 1 THEN 1 ELSE CAST((SELECT count(*) FROM e WHERE e.region = k.region) AS INTEGER) END AS n_corners, round(coalesce((SELECT abs(sum(x1 * y2 - x2 * y1)) / 2 FROM e WHERE e.region = k.region), 0), 6) AS area FROM k""")
def region_hulls(spark: SparkSession, d: str) -> DataFrame:
    """Corners and area, in square degrees, of the convex hull of each region's paddocks."""
    s = table(spark, d, "site_data", "region", "longitude", "latitude").where(nearby.in_box(F.col("longitude"), F.col("latitude"), BOX))
    return spatial.convex_hulls(s, "region", "longitude", "latitude").select("region", "n_corners", F.round(spatial.ring_area("lons", "lats"), 6).alias("area"))


_AREA = "abs(list_sum(list_transform(generate_series(1, len(lons) - 1), lambda i: lons[i] * lats[i + 1] - lons[i + 1] * lats[i]))) / 2"


@R.add(f"""SELECT ring_id, round({_AREA}, 6) AS area, round({_AREA}, 6) AS parts_area FROM ae_zones""")
def zone_split(spark: SparkSession, d: str) -> DataFrame:
    """Area of each ring, and of its parts north and south of a parallel together."""
    z = table(spark, d, "ae_zones", "ring_id", "lons", "lats")
    north, south = ([(0.0, a), (180.0, a), (180.0, b), (0.0, b)] for a, b in ((-31.0, 0.0), (-60.0, -31.0)))
    area = spatial.ring_area("lons", "lats")
    parts = spatial.clip_rings(z, "lons", "lats", north).unionByName(spatial.clip_rings(z, "lons", "lats", south)).groupBy("ring_id").agg(F.round(F.sum(area), 6).alias("parts_area"))
    return z.select("ring_id", F.round(area, 6).alias("area")).join(parts, "ring_id")


@R.add(f"""WITH p AS (SELECT DISTINCT region, longitude AS x, latitude AS y, degrees(2000 / 6371000.0) AS dy FROM site_data WHERE {_OK}), r AS (SELECT *, unnest(generate_series(CAST(floor((y - dy) / 0.005) AS BIGINT), CAST(floor((y + dy) / 0.005) AS BIGINT))) AS row FROM p),
  c AS (SELECT *, unnest(generate_series(CAST(floor((x - dy / cos(radians(abs(y) + dy))) / 0.005) AS BIGINT), CAST(floor((x + dy / cos(radians(abs(y) + dy))) / 0.005) AS BIGINT))) AS col FROM r)
  SELECT region, count(DISTINCT (row, col)) AS n_cells FROM c WHERE 2 * 6371000 * asin(sqrt(pow(sin(radians((row + 0.5) * 0.005 - y) / 2), 2) + cos(radians(y)) * cos(radians((row + 0.5) * 0.005)) * pow(sin(radians((col + 0.5) * 0.005 - x) / 2), 2))) <= 2000 GROUP BY region""")
def region_buffer_cover(spark: SparkSession, d: str) -> DataFrame:
    """Cells of 0.005 degrees within 2 km of any paddock of each region."""
    s = table(spark, d, "site_data", "region", "longitude", "latitude").where(nearby.in_box(F.col("longitude"), F.col("latitude"), BOX))
    return spatial.buffer_cover(s, "region", "longitude", "latitude", 2000.0, 0.005).groupBy("region").agg(F.count(F.lit(1)).alias("n_cells"))


@R.add("""SELECT site_data_id, longitude BETWEEN 110 AND 155 AND latitude BETWEEN -45 AND -10 AS in_box, NOT (longitude BETWEEN 110 AND 155 AND latitude BETWEEN -45 AND -10) AND latitude BETWEEN 110 AND 155 AND longitude BETWEEN -45 AND -10 AS swapped FROM (SELECT site_data_id, coalesce(longitude, 0) AS longitude, coalesce(latitude, 0) AS latitude FROM site_data)""")
def coordinate_checks(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "site_data", "site_data_id", "longitude", "latitude")
    x, y = F.col("longitude"), F.col("latitude")
    return s.select("site_data_id", nearby.in_box(x, y, BOX).alias("in_box"), spatial.looks_swapped(x, y, BOX).alias("swapped"))


# response --------------------------------------------------------------------------------------------------

_LK = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


@R.add(f"""SELECT {_LK}, CASE WHEN s IS NOT NULL THEN least(s, t) END AS n_success, CASE WHEN s IS NOT NULL AND t <> 0 THEN round(least(greatest(least(s, t) / t, 0.001), 0.999), 6) END AS mice_prop, least(s, t) AS n_success_legacy FROM (SELECT {_LK}, CASE WHEN l_discount > 0.02 THEN l_quantity * 2 END AS s, nullif(l_quantity + l_linenumber, 20) AS t FROM lineitem)""")
def response_beta(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem", *_LK.split(", "), "l_discount", "l_quantity")
    s, t = F.when(F.col("l_discount") > 0.02, F.col("l_quantity") * 2), F.nullif(F.col("l_quantity") + F.col("l_linenumber"), F.lit(20.0))
    b, old = response.beta_response(s, t), response.beta_response(s, t, legacy=True)
    return li.select(*_LK.split(", "), b["n_success"].alias("n_success"), F.round(b["mice_prop"], 6).alias("mice_prop"), old["n_success"].alias("n_success_legacy"))


@R.add("""SELECT record_id, CASE WHEN trap_type = 'longworth' THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END AS obs_weight, CASE WHEN lat > -30 THEN 'north' ELSE 'south' END AS north, coalesce(region, 'NA') || '_' || coalesce(farmer, 'NA') || '_' || site AS series, 'traps_night' || survey_night AS survey_method FROM (SELECT *, CASE WHEN isnan(latitude) THEN NULL ELSE latitude END AS lat FROM data_monitoring_traps_clean)""")
def model_covariates(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, TRAPS, "record_id", "trap_type", "latitude", "region", "farmer", "site", "survey_night")
    c = response.survey_covariates(F.col("trap_type"), F.col("latitude"), F.col("survey_night"))
    return t.select("record_id", response.series_key(F.col("region"), F.col("farmer"), F.col("site")).alias("series"), *[v.alias(n) for n, v in c.items()])


@R.add("""SELECT survey_id, CASE WHEN age = 'old' THEN 'burrows_old' WHEN age IS NOT NULL THEN 'burrows_young' END AS survey_method FROM (SELECT survey_id, CASE WHEN crop_stage IN ('ripe', 'harvested') THEN 'old' WHEN crop_stage IN ('seedling', 'sown') THEN 'young' END AS age FROM data_deduplicate_surveys_season)""")
def burrow_methods(spark: SparkSession, d: str) -> DataFrame:
    age = F.when(F.col("crop_stage").isin("ripe", "harvested"), "old").when(F.col("crop_stage").isin("seedling", "sown"), "young")
    return table(spark, d, VISITS, "survey_id", "crop_stage").select("survey_id", response.burrow_methods(age).alias("survey_method"))


@R.add("""SELECT o_orderkey, round((o_totalprice - (SELECT avg(o_totalprice) FROM orders)) / (SELECT stddev_samp(o_totalprice) FROM orders), 6) AS z FROM orders""")
def zscore(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders", "o_orderkey", F.col("o_totalprice").alias("z"))
    return response.zscore(o, ["z"]).withColumn("z", F.round("z", 6))


@R.add("""SELECT o_orderkey, round(o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_orderpriority), 4) AS effect FROM orders""")
def centre_by_group(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders", "o_orderkey", "o_orderpriority", "o_totalprice")
    return response.centred(o, ["o_orderpriority"], "o_totalprice", "effect").select("o_orderkey", F.round("effect", 4).alias("effect"))


@R.add(f"""SELECT {_LK}, CAST(trunc(l_extendedprice) AS INTEGER) AS rain_total, CAST(trunc(l_quantity * 1.7) AS INTEGER) AS temp_max, l_tax AS other FROM lineitem""")
def coerce_integers(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem", *_LK.split(", "), F.col("l_extendedprice").alias("rain_total"), (F.col("l_quantity") * 1.7).alias("temp_max"), F.col("l_tax").alias("other"))
    return response.truncate_matching(li, "rain|temp")


# draws -----------------------------------------------------------------------------------------------------

_DRAWS = """dr AS (SELECT l_returnflag || l_linestatus AS trend, CAST(year(l_shipdate) AS INTEGER) AS time, l_orderkey AS draw, avg(1 / (1 + exp(-(l_discount * 20 - 1)))) AS value FROM lineitem GROUP BY ALL)"""
_AREAS = "ar AS (SELECT DISTINCT l_returnflag || l_linestatus AS trend, l_returnflag AS area FROM lineitem)"


def _draws(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem", "l_returnflag", "l_linestatus", "l_shipdate", "l_orderkey", "l_discount")
    v = response.logistic(F.col("l_discount") * 20 - 1)
    return li.groupBy(F.concat("l_returnflag", "l_linestatus").alias("trend"), F.year("l_shipdate").alias("time"), F.col("l_orderkey").alias("draw")).agg(F.avg(v).alias("value"))


_SUMMARY = "round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(quantile_cont(value, 0.025), 6) AS q025, round(quantile_cont(value, 0.975), 6) AS q975"
_ROUND = ("mean", "median", "q025", "q975")


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


@R.add(f"WITH {_DRAWS} SELECT trend, time, {_SUMMARY} FROM dr GROUP BY ALL")
def draw_summary(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(forecast.summarise_draws(_draws(spark, d), "trend"), *_ROUND)


_MEANS = "a AS (SELECT area, draw, time, avg(value) AS value FROM dr JOIN ar USING (trend) GROUP BY ALL)"


@R.add(f"WITH {_DRAWS}, {_AREAS}, {_MEANS}, t AS (SELECT quantile_cont(value, 0.75) AS t FROM a) SELECT area, time, {_SUMMARY}, round(avg(CAST(value > t AS INTEGER)), 6) AS exceedance FROM a, t GROUP BY ALL")
def exceedance(spark: SparkSession, d: str) -> DataFrame:
    dr = _draws(spark, d)
    a = forecast.average_draws(dr, dr.select("trend", F.substring("trend", 1, 1).alias("area")), "trend", "area")
    return _rounded(forecast.summarise_draws(a, "area", forecast.quantile_of(a, "value", 0.75)), *_ROUND, "exceedance")


_YEARLY = f"WITH {MONTHLY}, y AS (SELECT nation, CAST(season_ord // 4 AS INTEGER) AS year, sum(total) AS total, sum(n) AS n FROM m GROUP BY ALL)"


def _yearly(spark: SparkSession, d: str) -> DataFrame:
    return monthly(spark, d).groupBy("nation", cal.ord_year(F.col("season_ord")).alias("year")).agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


@R.add(_YEARLY + ", q AS (SELECT quantile_cont(total, 0.25) AS a, quantile_cont(total, 0.75) AS b FROM y) SELECT nation, year, CASE WHEN total <= a THEN 'Low' WHEN total <= b THEN 'Moderate' ELSE 'High' END AS level FROM y, q")
def cut3(spark: SparkSession, d: str) -> DataFrame:
    y = _yearly(spark, d)
    return y.select("nation", "year", forecast.cut3(F.col("total"), forecast.quantile_of(y, "total", 0.25), forecast.quantile_of(y, "total", 0.75)).alias("level"))


@R.add(_YEARLY + " SELECT nation, year, round(total / lag(total) OVER w, 6) AS change, round((total / lag(total) OVER w - 1) * 100, 4) AS pct_change FROM y WINDOW w AS (PARTITION BY nation ORDER BY year)")
def change_from_previous(spark: SparkSession, d: str) -> DataFrame:
    c = forecast.with_change(_yearly(spark, d), "nation", "year", "total")
    return c.select("nation", "year", F.round("change", 6).alias("change"), F.round("pct_change", 4).alias("pct_change"))


@R.add(_YEARLY + ", q AS (SELECT nation, quantile_cont(total, 0.25) AS a, quantile_cont(total, 0.75) AS b FROM y GROUP BY 1) SELECT nation, year, CASE WHEN total <= a THEN 'Low' WHEN total <= b THEN 'Moderate' ELSE 'High' END AS level FROM y JOIN q USING (nation)")
def group_quantile_level(spark: SparkSession, d: str) -> DataFrame:
    return forecast.group_levels(_yearly(spark, d), "nation", "total").select("nation", "year", "level")


@R.add(_YEARLY + ", q AS (SELECT nation, quantile_cont(total, 0.75) AS a, quantile_cont(CAST(n AS DOUBLE), 0.75) AS p FROM y GROUP BY 1), h AS (SELECT nation, count(*) FILTER (total > a) AS n_top, count(*) FILTER (total > a AND n > p) AS n_hit FROM y JOIN q USING (nation) GROUP BY 1) SELECT nation, n_top, n_hit, round(n_hit / nullif(n_top, 0), 6) AS rate FROM h")
def hit_rate(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(forecast.hit_rate(_yearly(spark, d), "nation", "total", "n"), "rate")


_SEASONS = f"WITH {MONTHLY}, s AS (SELECT nation, season_ord, CASE WHEN sum(n) > 20 THEN round(sum(total), 2) END AS total FROM m GROUP BY ALL)"


@R.add(_SEASONS + ", b AS (SELECT nation, arg_max(total, season_ord) AS value, max(season_ord) AS used FROM s WHERE season_ord BETWEEN 7996 AND 7998 AND total IS NOT NULL GROUP BY 1) SELECT k.nation, value, used, coalesce(used = 7998, false) AS is_current FROM (SELECT DISTINCT nation FROM s) k LEFT JOIN b USING (nation)")
def best_season(spark: SparkSession, d: str) -> DataFrame:
    s = monthly(spark, d).groupBy("nation", "season_ord").agg(F.when(F.sum("n") > 20, F.round(F.sum("total"), 2)).alias("total"))
    return forecast.best_available(s, "nation", "season_ord", "total", 7998)


@R.add(_YEARLY + ", v AS (SELECT nation, year, n AS surveys FROM y WHERE n > 90) SELECT nation, year, round(total, 2) AS total, CAST(coalesce(surveys, 0) AS BIGINT) AS surveys FROM (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY nation ORDER BY year DESC) <= 2) LEFT JOIN v USING (nation, year)")
def predictions_with_surveys(spark: SparkSession, d: str) -> DataFrame:
    y = _yearly(spark, d)
    out = forecast.attach_surveys(y.select("nation", "year", "total"), y.where("n > 90").select("nation", "year", F.col("n").alias("surveys")), ["nation", "year"], ["surveys"], "year")
    return out.withColumn("total", F.round("total", 2))


@R.add(_YEARLY + ", e AS (SELECT nation, avg(total) AS fit, stddev_samp(total) / sqrt(count(*)) AS se FROM y GROUP BY 1) SELECT nation, round(fit, 4) AS fit, round(fit - 1.96 * se, 4) AS lower, round(fit + 1.96 * se, 4) AS upper FROM e")
def effect_intervals(spark: SparkSession, d: str) -> DataFrame:
    e = _yearly(spark, d).groupBy("nation").agg(F.avg("total").alias("fit"), (F.stddev_samp("total") / F.sqrt(F.count(F.lit(1)))).alias("se"))
    g = forecast.effect_grid(e, ["nation"], "fit", "se")
    return g.select("nation", *[F.round(c, 4).alias(c) for c in ("fit", "lower", "upper")])


# reports ---------------------------------------------------------------------------------------------------


@R.add("""WITH s AS (SELECT region, max(mice_night) AS a, max(CASE WHEN crop_stage = 'ripe' THEN mice_night END) AS b FROM data_monitoring_traps_clean GROUP BY region) SELECT region, greatest(a, b) AS top, CASE WHEN greatest(a, b) IS NULL THEN 'No data' WHEN greatest(a, b) < 5 THEN 'Low' WHEN greatest(a, b) < 25 THEN 'Moderate' ELSE 'High' END AS level FROM s""")
def activity_level(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, TRAPS, "region", "mice_night", "crop_stage")
    s = t.groupBy("region").agg(F.greatest(F.max("mice_night"), F.max(F.when(F.col("crop_stage") == "ripe", F.col("mice_night")))).alias("top"))
    return s.withColumn("level", aggregates.level_of(F.col("top"), 5, 25))


@R.add("""WITH z AS (SELECT soil_type AS category, array_agg(DISTINCT z ORDER BY z) AS l FROM (SELECT soil_type, lower(ae_zone) AS z FROM data_list_ae_exp_rain_soil WHERE soil_type IS NOT NULL AND ae_zone IS NOT NULL AND precip_prev_0_6m > 300) GROUP BY 1)
  SELECT category, CASE len(l) WHEN 1 THEN l[1] ELSE array_to_string(l[1:-2], ', ') || ' and ' || l[-1] END AS sentence FROM z""")
def narrative_list(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "data_list_ae_exp_rain_soil", "soil_type", F.lower("ae_zone").alias("z"), "precip_prev_0_6m").where("soil_type IS NOT NULL AND z IS NOT NULL AND precip_prev_0_6m > 300 ")
    g = s.select("soil_type", "z").distinct().groupBy(F.col("soil_type").alias("category")).agg(F.array_sort(F.collect_list("z")).alias("l"))
    return g.select("category", forecast.sentence_list(F.col("l")).alias("sentence"))


@R.add(f"""SELECT site_data_id, max(make_date(CAST(y AS BIGINT), CAST(i * 3 + 1 AS BIGINT), 15)) >= DATE '2024-06-30' AS recently_active FROM (SELECT site_data_id, CAST(right(season_year_adj, 4) AS INTEGER) AS y, CASE left(season_year_adj, 2) WHEN 'Su' THEN 0 WHEN 'Au' THEN 1 WHEN 'Wi' THEN 2 ELSE 3 END AS i FROM data_long) GROUP BY 1""")
def recently_active(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "data_long", "site_data_id", cal.label_mid_date(cal.parse_label(F.col("season_year_adj"))).alias("mid"))
    return t.groupBy("site_data_id").agg((F.max("mid") >= F.to_date(F.lit("2024-06-30"))).alias("recently_active"))


# quality ---------------------------------------------------------------------------------------------------


def _rules() -> list[quality.Rule]:
    c = F.col
    return [
        *quality.required(["farmer", "date", "session_start_date"]),
        *quality.not_blank(["crop_type"]),
        quality.Rule("end_before_start", "error", c("session_end_date") < c("session_start_date"), c("session_end_date")),
        quality.Rule("date_outside_session", "error", (c("date") < c("session_start_date")) | (c("date") > c("session_end_date")), c("date")),
        quality.Rule("long_session", "warning", F.datediff("session_end_date", "session_start_date") + 1 > 6, c("session_start_date")),
        quality.Rule("negative_count", "error", c("phantoms") < 0, c("phantoms").cast("int")),
        quality.Rule("functional_mismatch", "error", c("traps_night") != c("traps_set") - F.when(c("phantoms").between(0, 100), c("phantoms")), c("traps_night").cast("int")),
        quality.Rule("catch_above_traps", "error", c("mice_night") > c("traps_night"), c("mice_night").cast("int")),
        quality.within("survey_night", 1, 6),
        quality.domain("trap_type", "Longworth", "Elliott"),
    ]


_QCOLS = ("record_id", "farmer", "date", "session_start_date", "session_end_date", "crop_type", "phantoms", "traps_night", "traps_set", "mice_night", "survey_night", "trap_type")
_BROKEN = {
    ("null_farmer", "error"): ("farmer IS NULL", "'farmer'"), ("null_date", "error"): ("date IS NULL", "'date'"), ("null_session_start_date", "error"): ("session_start_date IS NULL", "'session_start_date'"),
    ("blank_crop_type", "warning"): ("trim(crop_type, ' ') = ''", "'crop_type'"), ("end_before_start", "error"): ("session_end_date < session_start_date", "CAST(session_end_date AS VARCHAR)"),
    ("date_outside_session", "error"): ("date < session_start_date OR date > session_end_date", "CAST(date AS VARCHAR)"), ("long_session", "warning"): ("session_end_date - session_start_date + 1 > 6", "CAST(session_start_date AS VARCHAR)"),
    ("negative_count", "error"): ("phantoms < 0", "CAST(CAST(phantoms AS INTEGER) AS VARCHAR)"), ("functional_mismatch", "error"): ("traps_night <> traps_set - CASE WHEN phantoms BETWEEN 0 AND 100 THEN phantoms END", "CAST(CAST(traps_night AS INTEGER) AS VARCHAR)"),
    ("catch_above_traps", "error"): ("mice_night > traps_night", "CAST(CAST(mice_night AS INTEGER) AS VARCHAR)"), ("range_survey_night", "error"): ("survey_night NOT BETWEEN 1 AND 6", "CAST(survey_night AS VARCHAR)"), ("domain_trap_type", "warning"): ("lower(trap_type) NOT IN ('longworth', 'elliott')", "trap_type"),
}


@R.add(" UNION ALL ".join(f"SELECT '{r}' AS rule_id, '{s}' AS severity, CAST(record_id AS VARCHAR) AS row_key, {d} AS detail FROM data_monitoring_traps_clean WHERE {c}" for (r, s), (c, d) in _BROKEN.items()))
def quality_violations(spark: SparkSession, d: str) -> DataFrame:
    return quality.violations(table(spark, d, TRAPS, *_QCOLS), F.col("record_id"), _rules())


@R.add(" UNION ALL ".join(f"SELECT '{r}' AS rule_id, '{s}' AS severity, count(*) AS n_checked, count(*) FILTER ({c}) AS n_broken, count(*) FILTER ({c}) = 0 AS passed FROM data_monitoring_traps_clean" for (r, s), (c, _) in _BROKEN.items()))
def quality_summary(spark: SparkSession, d: str) -> DataFrame:
    return quality.summary(table(spark, d, TRAPS, *_QCOLS), _rules())


@R.add("""SELECT v.survey_id, s.site_data_id IS NULL AS unknown_site, coalesce(abs(v.longitude - s.longitude) > 0.05 OR abs(v.latitude - s.latitude) > 0.05, false) AS drifted FROM data_deduplicate_surveys_season v LEFT JOIN (SELECT region, site, subsite, min(site_data_id) AS site_data_id, min(nullif(longitude, 'NaN'::DOUBLE)) AS longitude, min(nullif(latitude, 'NaN'::DOUBLE)) AS latitude FROM site_data GROUP BY ALL) s ON lower(trim(v.region, ' ')) = s.region AND lower(trim(v.site, ' ')) = s.site AND lower(trim(v.subsite, ' ')) = s.subsite""".replace("abs(v.longitude - s", "abs(nullif(v.longitude, 'NaN'::DOUBLE) - s").replace("abs(v.latitude - s", "abs(nullif(v.latitude, 'NaN'::DOUBLE) - s"))
def registry_checks(spark: SparkSession, d: str) -> DataFrame:
    clean = lambda c: F.nanvl(F.col(c), F.lit(None).cast("double"))
    v = table(spark, d, VISITS, "survey_id", *[F.lower(F.trim(c)).alias(c) for c in ("region", "site", "subsite")], clean("longitude").alias("x"), clean("latitude").alias("y"))
    s = table(spark, d, "site_data").groupBy("region", "site", "subsite").agg(F.min("site_data_id").alias("site_data_id"), F.min(clean("longitude")).alias("sx"), F.min(clean("latitude")).alias("sy"))
    j = v.join(s, ["region", "site", "subsite"], "left")
    far = (F.abs(F.col("x") - F.col("sx")) > 0.05) | (F.abs(F.col("y") - F.col("sy")) > 0.05)
    return j.select("survey_id", F.col("site_data_id").isNull().alias("unknown_site"), F.coalesce(far, F.lit(False)).alias("drifted"))


@R.add("""SELECT 'crop_stage' AS column_name, 'type string, not int' AS problem, 'error' AS severity UNION ALL SELECT 'weight_g', 'missing', 'error' UNION ALL SELECT 'crop_category', 'extra', 'warning'""")
def column_report(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "metadata").select("ref_id", "crop_category", F.col("field_name").alias("crop_stage"))
    return quality.column_report(spark, t, {"ref_id": "double", "crop_stage": "int", "weight_g": "double"})


@R.add("""WITH n AS (SELECT site_data_id, trap_type, date, max(traps_night) AS t, max(mice_night) AS m FROM data_monitoring_traps_clean WHERE date IS NOT NULL GROUP BY ALL) SELECT trap_type, count(*) AS n_nights, CAST(sum(t) AS DOUBLE) AS trap_nights, CAST(sum(m) AS DOUBLE) AS captures, round(100 * sum(m) / nullif(sum(t), 0), 4) AS success_pct FROM n GROUP BY trap_type""")
def trapping_summary(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, TRAPS, "site_data_id", "trap_type", "date", "traps_night", "mice_night").where("date IS NOT NULL")
    return aggregates.night_summary(n, ["site_data_id", "trap_type", "date"], ["trap_type"], "traps_night", "mice_night")


QUERIES, SQL = R.queries, R.sql
