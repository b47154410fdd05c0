"""Queries on rapid assessments, boundaries, rasters, layers and narratives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.functions import calendar as cal
from quadrat.operators import aggregates as agg
from quadrat.operators import clean, forecast, nearby, quality, rapid, spatial
from quadrat.plans.cleaning import ord_sql
from quadrat.plans.core_problems import _ZONES
from quadrat.plans.registry import Registry
from quadrat.plans.summaries import MONTHLY, monthly
from quadrat.sources import rasters
from quadrat.sources.tables import scratch, table

R = Registry()
TRAPS, VISITS = "data_monitoring_traps_clean", "data_deduplicate_surveys_season"
BOX = (110.0, 155.0, -45.0, -10.0)
SEGMENTS = [f"s{i}" for i in range(1, 9)]
CARDS = [f"c{i}" for i in range(1, 8)]

# Orders as surveys: lines one to seven are burrow segments (the eighth is never there) and cards; the customer's number gives the dates.
_S = ", ".join(f"min(l_quantity) FILTER (l_linenumber = {i}) AS s{i}" for i in range(1, 8))
_C = ", ".join(f"min(l_discount * 1000 - 5) FILTER (l_linenumber = {i}) AS c{i}" for i in range(1, 8))
_SURVEYS = f"""w AS (SELECT l_orderkey AS id, {_S}, CAST(NULL AS DOUBLE) AS s8, {_C} FROM lineitem GROUP BY 1),
  v AS (SELECT w.*, CAST(o_orderdate AS DATE) AS date_in, CAST(o_orderdate AS DATE) + CAST(o_custkey % 9 - 1 AS INTEGER) AS date_out, o_orderstatus AS region, CASE WHEN o_custkey % 50 = 0 THEN 'Values 0-25 are the total number of active burrows lumped together' END AS comments FROM w JOIN orders ON id = o_orderkey)"""


def _surveys(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    at = lambda c, i: F.min(F.when(F.col("l_linenumber") == i, c))
    w = li.groupBy(F.col("l_orderkey").alias("id")).agg(*[at(F.col("l_quantity"), i).alias(f"s{i}") for i in range(1, 8)], *[at(F.col("l_discount") * 1000 - 5, i).alias(f"c{i}") for i in range(1, 8)]).withColumn("s8", F.lit(None).cast("double"))
    o = table(spark, d, "orders", F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("date_in"), "o_custkey", F.col("o_orderstatus").alias("region"))
    o = o.select("id", "date_in", F.date_add("date_in", (F.col("o_custkey") % 9 - 1).cast("int")).alias("date_out"), "region", F.when(F.col("o_custkey") % 50 == 0, "Values 0-25 are the total number of active burrows lumped together").alias("comments"))
    return w.join(o, "id")


def _measured(spark: SparkSession, d: str) -> DataFrame:
    t = rapid.transect_totals(_surveys(spark, d), SEGMENTS)
    t = rapid.numbered_columns(t, CARDS, "chewcard_percent_")
    return rapid.card_measures(rapid.burrow_measures(t, ["active_burrows_t1", "active_burrows_t2"]), [f"chewcard_percent_{i}" for i in range(1, 8)])


_N_CARDS = " + ".join(f"(c{i} IS NOT NULL)::INT" for i in range(1, 8))
_N_CHEWED = " + ".join(f"coalesce((c{i} > 0)::INT, 0)" for i in range(1, 8))
_MEASURED = f"""{_SURVEYS}, t AS (SELECT *, s1 + s2 + s3 + s4 AS t1, s5 + s6 + s7 + s8 AS t2 FROM v),
  m AS (SELECT *, CASE WHEN t1 IS NOT NULL OR t2 IS NOT NULL THEN (t1 IS NOT NULL)::INT + (t2 IS NOT NULL)::INT END AS searched, {_N_CARDS} AS deployed, {_N_CHEWED} AS chewed FROM t)"""


@R.add(f"""WITH {_MEASURED} SELECT id, t1 AS active_burrows_t1, t2 AS active_burrows_t2, searched AS burrow_transects_searched, CASE WHEN searched > 0 THEN coalesce((t1 > 0)::INT, 0) + coalesce((t2 > 0)::INT, 0) END AS burrow_transects_present, searched * 100 AS burrow_total_metres,
  CASE WHEN searched > 0 THEN coalesce(t1, 0) + coalesce(t2, 0) END AS burrow_total_count, CASE WHEN searched > 0 THEN (coalesce(t1, 0) + coalesce(t2, 0) > 0)::INT END AS burrow_site_present, deployed AS chewcards_deployed, chewed AS chewcards_chewed, (chewed > 0)::INT AS chewcard_site_present FROM m""")
def rapid_measures(spark: SparkSession, d: str) -> DataFrame:
    """Burrow transects and chew cards of each survey."""
    return _measured(spark, d).select("id", "active_burrows_t1", "active_burrows_t2", *[c for c in _COUNTS])


_COUNTS = ("burrow_transects_searched", "burrow_transects_present", "burrow_total_metres", "burrow_total_count", "burrow_site_present", "chewcards_deployed", "chewcards_chewed", "chewcard_site_present")


@R.add(f"""WITH {_MEASURED} SELECT 'burrows' AS method, id FROM m WHERE searched >= 1 AND coalesce(comments NOT LIKE 'Values 0-25 are the total number of active burrows lumped%', true) UNION ALL SELECT 'chewcards', id FROM m WHERE deployed >= 1""")
def rapid_methods(spark: SparkSession, d: str) -> DataFrame:
    """Surveys by method."""
    burrows, cards = rapid.split_methods(_measured(spark, d))
    return burrows.select(F.lit("burrows").alias("method"), "id").unionByName(cards.select(F.lit("chewcards").alias("method"), "id"))


_RULES_SQL = {"end_before_start": "date_out < date_in", "long_survey": "date_out - date_in > 6", "same_day": "date_out = date_in", **{f"percent_c{i}": f"c{i} NOT BETWEEN 0 AND 100" for i in range(1, 8)}}


@R.add(f"WITH {_SURVEYS} " + " UNION ALL ".join(f"SELECT '{r}' AS rule_id, 'error' AS severity, count(*) AS n_checked, count(*) FILTER ({c}) AS n_broken, count(*) FILTER ({c}) = 0 AS passed FROM v" for r, c in _RULES_SQL.items()))
def rapid_checks(spark: SparkSession, d: str) -> DataFrame:
    """Rules on dates and on the percentages of cards."""
    return quality.summary(_surveys(spark, d), [*rapid.survey_rules("date_in", "date_out"), *rapid.percent_rules(CARDS)])


@R.add(f"""WITH {_MEASURED}, x AS (SELECT region, 'burrows' AS kind, unnest([t1, t2]) AS v FROM m UNION ALL SELECT region, 'cards', unnest([{", ".join(CARDS)}]) FROM m)
  SELECT region, kind, count(v) AS n_values, round(min(v), 6) AS least, round(max(v), 6) AS most, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(100.0::DOUBLE * count(*) FILTER (v > 0) / nullif(count(v), 0), 6) AS pct_positive FROM x WHERE v IS NOT NULL GROUP BY ALL""")
def rapid_summary(spark: SparkSession, d: str) -> DataFrame:
    """Range, mean and median of transects and cards of each region."""
    m = _measured(spark, d)
    both = rapid.measure_summary(m, ["active_burrows_t1", "active_burrows_t2"], "burrows", ["region"]).unionByName(rapid.measure_summary(m, [f"chewcard_percent_{i}" for i in range(1, 8)], "cards", ["region"]))
    return both.select("region", "kind", "n_values", *[F.round(c, 6).alias(c) for c in ("least", "most", "mean", "median", "pct_positive")])


# boundaries and zones ----------------------------------------------------------------------------------------


def _zones_of(spark: SparkSession, d: str) -> DataFrame:
    pts = table(spark, d, "site_data", "site_data_id", "longitude", "latitude").where(nearby.in_box(F.col("longitude"), F.col("latitude"), BOX))
    return nearby.containing_region(pts, "site_data_id", "longitude", "latitude", table(spark, d, "ae_zones"), "ae_zone", "piece_no", none="none")


@R.add(f"WITH {_ZONES} SELECT id AS site_data_id FROM z WHERE ae_zone = 'none'")
def outside_boundary(spark: SparkSession, d: str) -> DataFrame:
    """Paddocks outside every region of a boundary."""
    return _zones_of(spark, d).where("region = 'none'").select("site_data_id")


@R.add(f"WITH {_ZONES} SELECT z.id AS site_data_id, z.ae_zone AS found, s.ae_zone AS stated FROM z JOIN data_list_ae_exp_rain_soil s ON s.site_data_id = z.id WHERE z.ae_zone <> 'none' AND s.ae_zone IS NOT NULL AND lower(trim(s.ae_zone, ' ')) <> lower(z.ae_zone)")
def region_mismatch(spark: SparkSession, d: str) -> DataFrame:
    """Paddocks whose stated region is not the one that holds them."""
    stated = table(spark, d, "data_list_ae_exp_rain_soil", "site_data_id", F.col("ae_zone").alias("stated")).where("stated IS NOT NULL")
    j = _zones_of(spark, d).where("region <> 'none'").join(stated, "site_data_id")
    return j.where(F.lower(F.trim("stated")) != F.lower("region")).select("site_data_id", F.col("region").alias("found"), "stated")


@R.add("""WITH n AS (SELECT DISTINCT ae_zone FROM ae_zones), k AS (SELECT min(ae_zone) AS a, max(ae_zone) AS b FROM n) SELECT CASE WHEN regexp_replace(ae_zone, '/', ' ', 'g') IN (SELECT regexp_replace(a, '/', ' ', 'g') FROM k UNION ALL SELECT regexp_replace(b, '/', ' ', 'g') FROM k) THEN 'merged' ELSE regexp_replace(ae_zone, '/', ' ', 'g') END AS zone,
  count(*) AS n_rings, count(DISTINCT (ae_zone, piece_no)) AS n_pieces FROM ae_zones GROUP BY 1""")
def merged_zones(spark: SparkSession, d: str) -> DataFrame:
    """Rings and pieces of zones of which the first and the last by name are merged."""
    z = table(spark, d, "ae_zones", "ae_zone", "piece_no")
    ends = z.agg(F.min("ae_zone").alias("a"), F.max("ae_zone").alias("b")).head()  # a fixed table
    zone = clean.merged_zones(F.col("ae_zone"), {"merged": tuple(x.replace("/", " ") for x in ends)})
    return z.groupBy(zone.alias("zone")).agg(F.count(F.lit(1)).alias("n_rings"), F.count_distinct("ae_zone", "piece_no").alias("n_pieces"))


_GRID_CELLS = """e AS (SELECT ae_zone, piece_no, lons[i] AS x1, lats[i] AS y1, lons[i + 1] AS x2, lats[i + 1] AS y2 FROM (SELECT ae_zone, piece_no, lons, lats, unnest(generate_series(1, len(lons) - 1)) AS i FROM ae_zones)),
  r AS (SELECT ae_zone, piece_no, (v + 0.5) * 0.25 AS y, v AS row, x1 + ((v + 0.5) * 0.25 - y1) / (y2 - y1) * (x2 - x1) AS x FROM e, (SELECT unnest(generate_series(-180, -40)) AS v) WHERE (y1 > (v + 0.5) * 0.25) <> (y2 > (v + 0.5) * 0.25)),
  c AS (SELECT ae_zone, row, u AS col FROM r, (SELECT unnest(generate_series(440, 620)) AS u) WHERE x > (u + 0.5) * 0.25 GROUP BY ae_zone, piece_no, row, u HAVING count(*) % 2 = 1),
  s AS (SELECT DISTINCT region, CAST(floor(latitude / 0.25) AS BIGINT) AS row, CAST(floor(longitude / 0.25) AS BIGINT) AS col FROM site_data WHERE longitude BETWEEN 110 AND 155 AND latitude BETWEEN -45 AND -10)"""


@R.add(f"""WITH {_GRID_CELLS}, d AS (SELECT DISTINCT * FROM c) SELECT 'intersection' AS how, ae_zone || ' in ' || region AS part, count(*) AS n_cells FROM d JOIN s USING (row, col) GROUP BY ALL UNION ALL SELECT 'difference', ae_zone, count(*) FROM d ANTI JOIN s USING (row, col) GROUP BY ALL
  UNION ALL SELECT 'union', 'all', count(*) FROM (SELECT row, col FROM d UNION SELECT row, col FROM s)""")
def zone_overlay(spark: SparkSession, d: str) -> DataFrame:
    """Zones split by the cells in which a region has paddocks: what they share, what is left of the zones, and both together."""
    z = spatial.polygon_cells(table(spark, d, "ae_zones"), "ae_zone", "piece_no", 0.25)
    at = table(spark, d, "site_data", "region", "longitude", "latitude").where("longitude BETWEEN 110 AND 155 AND latitude BETWEEN -45 AND -10")
    s = at.select("region", F.floor(F.col("latitude") / 0.25).alias("row"), F.floor(F.col("longitude") / 0.25).alias("col")).distinct()
    part = lambda df, how, name: df.groupBy(F.lit(how).alias("how"), name.alias("part")).agg(F.count(F.lit(1)).alias("n_cells"))
    both = part(spatial.overlay(z, s, "intersection"), "intersection", F.concat("ae_zone", F.lit(" in "), "region"))
    return both.unionByName(part(spatial.overlay(z, s, "difference"), "difference", F.col("ae_zone"))).unionByName(part(spatial.overlay(z, s, "union"), "union", F.lit("all")))


@R.add()
def hull_buffers(spark: SparkSession, d: str) -> DataFrame:
    """Hull of each region's paddocks widened by 40 km, with its area and centre."""
    s = table(spark, d, "site_data", "region", "longitude", "latitude").where(nearby.in_box(F.col("longitude"), F.col("latitude"), BOX))
    return spatial.hull_buffers(s, "region", "longitude", "latitude", 40_000.0)


@R.add("""SELECT ae_zone, count(*) AS n_rings, count(*) FILTER (is_hole) AS n_holes, CAST(sum(len(lons)) AS BIGINT) AS n_points FROM ae_zones GROUP BY ae_zone""")
def zone_scan(spark: SparkSession, d: str) -> DataFrame:
    """The zones written as a feature collection and scanned back."""
    folder = scratch(spark, "geojson")
    z = table(spark, d, "ae_zones").groupBy("ae_zone", "piece_no").agg(F.array_sort(F.collect_list(F.struct("is_hole", "ring_id", F.arrays_zip("lons", "lats").alias("xy")))).alias("r"))
    rings = F.to_json(F.transform("r", lambda r: F.transform(r["xy"], lambda p: F.array(p["lons"], p["lats"]))))
    f = z.select(F.concat(F.lit('{"type":"Feature","properties":{"ae_zone":"'), "ae_zone", F.lit('"},"geometry":{"type":"Polygon","coordinates":'), rings, F.lit("}}")).alias("f"))
    f.agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list("f"), ","), F.lit("]}")).alias("value")).coalesce(1).write.text(folder)
    return rasters.read_geojson(spark, folder, "ae_zone").groupBy("ae_zone").agg(F.count(F.lit(1)).alias("n_rings"), F.count_if("is_hole").alias("n_holes"), F.sum(F.size("lons")).alias("n_points"))


# rasters and layers --------------------------------------------------------------------------------------------


_CELLS = f"""r AS (SELECT CAST(floor(latitude * -10) - 100 AS INTEGER) AS row, CAST(floor(longitude * 10) - 1100 AS INTEGER) AS col, count(*) * 1.5::DOUBLE AS value FROM site_data WHERE longitude BETWEEN 110 AND 154.9 AND latitude BETWEEN -44.9 AND -10 GROUP BY ALL)"""


def _cells(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "site_data", "longitude", "latitude").where("longitude BETWEEN 110 AND 154.9 AND latitude BETWEEN -44.9 AND -10")
    return s.groupBy((F.floor(F.col("latitude") * -10) - 100).cast("int").alias("row"), (F.floor(F.col("longitude") * 10) - 1100).cast("int").alias("col")).agg((F.count(F.lit(1)) * 1.5).alias("value"))


@R.add(f"""WITH {_CELLS} SELECT 'all' AS layer_key, row, col, value, least(greatest(value, 2), 3) AS held, CASE WHEN value BETWEEN 2 AND 3 THEN value END AS dropped, CASE WHEN value > 2 THEN value * 10 ELSE 0 END AS cells FROM r UNION ALL SELECT 'twice', row, col, value * 2, least(greatest(value * 2, 2), 3), CASE WHEN value * 2 BETWEEN 2 AND 3 THEN value * 2 END, CASE WHEN value * 2 > 2 THEN value * 20 ELSE 0 END FROM r""")
def raster_algebra(spark: SparkSession, d: str) -> DataFrame:
    """Layers stacked, held within limits and chosen by a condition."""
    r = _cells(spark, d)
    v = F.col("value")
    s = rasters.stack({"all": r, "twice": r.withColumn("value", v * 2)})
    return s.withColumns({"held": rasters.clamped(v, 2, 3), "dropped": rasters.clamped(v, 2, 3, drop=True), "cells": rasters.if_cells(v > 2, v * 10, F.lit(0.0))})


@R.add(f"""WITH {_CELLS} SELECT row, col, value FROM r""")
def raster_files(spark: SparkSession, d: str) -> DataFrame:
    """A raster written as an ASCII grid and scanned back."""
    folder = scratch(spark, "grid")
    rasters.write_ascii_grids(_cells(spark, d).withColumn("layer_key", F.lit("sites")), folder, {"xmin": 110.0, "ymax": -10.0, "dx": 0.1, "nrow": 350, "ncol": 450})
    return rasters.read_ascii_grids(spark, folder, "*.txt").select("row", "col", "value")


@R.add(f"""WITH {MONTHLY}, a AS (SELECT nation, row_number() OVER (PARTITION BY nation ORDER BY month) AS layer_no, total AS a FROM m), b AS (SELECT nation, row_number() OVER (PARTITION BY nation ORDER BY month) AS layer_no, n AS b FROM m WHERE month > (SELECT min(month) FROM m)) SELECT nation, CAST(layer_no AS INTEGER) AS layer_no, a, b FROM a JOIN b USING (nation, layer_no)""")
def aligned_layers(spark: SparkSession, d: str) -> DataFrame:
    """Two stacks of layers cut to the shorter one."""
    m = monthly(spark, d)
    later = m.where(F.col("month") > m.agg(F.min("month")).scalar())
    return agg.aligned_layers(m.select("nation", "month", "total"), later.select("nation", "month", "n"), ["nation"], "month", {"a": "total", "b": "n"})


@R.add("""SELECT region, count(*) AS n_sites, count(*) FILTER (p) AS n_present, round(count(*) FILTER (p) / count(*), 2) AS proportion FROM (SELECT region, site, subsite, coalesce(bool_or(mice_night > 0), false) AS p FROM counts_grids_mallee GROUP BY ALL) GROUP BY region""")
def site_proportions(spark: SparkSession, d: str) -> DataFrame:
    return agg.site_proportions(table(spark, d, "counts_grids_mallee", "region", "site", "subsite", "mice_night"), ["region"], ["site", "subsite"], "mice_night")


@R.add("""SELECT ae_zone, season_year_adj, count(*) AS n_surveys FROM data_long WHERE mice IS NOT NULL GROUP BY ALL""")
def effort_counts(spark: SparkSession, d: str) -> DataFrame:
    return agg.effort_counts(table(spark, d, "data_long", "ae_zone", "season_year_adj", "mice"), ["ae_zone", "season_year_adj"], "mice")


# effects and narratives ------------------------------------------------------------------------------------------


_EFFECTS = f"""e AS (SELECT region, {ord_sql("session_start_date")} % 4 AS lag, avg(traps_set) AS estimate, stddev_samp(traps_set) / sqrt(count(traps_set)) AS se FROM data_deduplicate_surveys_season GROUP BY ALL)"""


def _effects(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, VISITS, "region", F.pmod(cal.season_ord(F.col("session_start_date")), F.lit(4)).alias("lag"), "traps_set")
    return v.groupBy("region", "lag").agg(F.avg("traps_set").alias("estimate"), (F.stddev_samp("traps_set") / F.sqrt(F.count("traps_set"))).alias("se"))


@R.add(f"""WITH {_EFFECTS}, s AS (SELECT region, count(DISTINCT lag) AS n_lags, sum(estimate) AS estimate, sqrt(sum(se * se)) AS se FROM e GROUP BY 1) SELECT region, n_lags, round(estimate, 4) AS estimate, round(se, 4) AS se, round(estimate - 1.96 * se, 4) AS lower, round(estimate + 1.96 * se, 4) AS upper FROM s""")
def lag_effects(spark: SparkSession, d: str) -> DataFrame:
    """Effects summed over lags, with the root of the summed squares of their errors."""
    e = forecast.lag_effects(_effects(spark, d), ["region"], "lag", "estimate", "se")
    return e.select("region", "n_lags", *[F.round(c, 4).alias(c) for c in ("estimate", "se", "lower", "upper")])


@R.add(f"""WITH {_EFFECTS} SELECT lag, x, region FROM (SELECT DISTINCT lag FROM e), (SELECT unnest([-1.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE]) AS x), (SELECT min(region) AS region FROM e)""")
def lag_grid(spark: SparkSession, d: str) -> DataFrame:
    """Each lag with each of three values on one template row."""
    e = _effects(spark, d)
    return forecast.lag_grid(e, "lag", e.agg(F.min("region").alias("region")), "x", [-1.0, 0.0, 1.0])


_LEVELS = """z AS (SELECT ae_zone, round(avg(mice), 4) AS m FROM data_long WHERE ae_zone IS NOT NULL GROUP BY 1 HAVING avg(mice) IS NOT NULL), q AS (SELECT ae_zone, CASE WHEN m <= 2 THEN 'Low' WHEN m <= 4 THEN 'Moderate' ELSE 'High' END AS level, round(m / 3, 4) AS change, round(m / 100, 4) AS p FROM z)"""


def _list(where: str, name: str = "ae_zone") -> str:
    return f"(SELECT CASE count(*) WHEN 0 THEN NULL WHEN 1 THEN min(n) ELSE array_to_string((array_agg(n ORDER BY n))[1:-2], ', ') || ' and ' || (array_agg(n ORDER BY n))[-1] END FROM (SELECT {name} AS n FROM q WHERE {where}))"


_PCT = "ae_zone || ' (by ' || CAST(round(abs(change - 1) * 100) AS INTEGER) || '%)'"
_PRESENT = "(SELECT coalesce(array_agg(n ORDER BY i), []) FROM (VALUES (1, 'low'), (2, 'moderate'), (3, 'high')) x(i, n) WHERE n IN (SELECT lower(level) FROM q))"


@R.add(f"""WITH {_LEVELS}, a AS (SELECT {_PRESENT} AS l), b AS (SELECT {_list("level = 'Moderate'")} AS mo, {_list("level = 'High'")} AS hi, {_list("change > 1.25", _PCT)} AS up, {_list("change < 0.75", _PCT)} AS down)
  SELECT 'levels' AS kind, CASE len(l) WHEN 0 THEN 'No predictions of abundance are available.' WHEN 1 THEN 'Current abundance is predicted to be ' || l[1] || '.' ELSE 'Current abundance is predicted to range from ' || l[1] || ' to ' || l[-1] || '.' END AS sentence FROM a
  UNION ALL SELECT 'areas', CASE WHEN mo IS NULL AND hi IS NULL THEN 'No area is predicted to have moderate or high abundance.' ELSE 'Current abundance is predicted to be ' || concat_ws(' and ', 'moderate in ' || mo, 'high in ' || hi) || '.' END FROM b
  UNION ALL SELECT 'increase', coalesce('Next season abundance is forecast to increase in ' || up || '.', 'No area is forecast to increase next season.') FROM b UNION ALL SELECT 'decrease', coalesce('Next season abundance is forecast to decrease in ' || down || '.', 'No area is forecast to decrease next season.') FROM b
  UNION ALL SELECT 'chance', 'The chance of high abundance next season ranges from ' || CAST(round(min(p) * 100) AS INTEGER) || '% to ' || CAST(round(max(p) * 100) AS INTEGER) || '%.' FROM q""")
def narrative_sentences(spark: SparkSession, d: str) -> DataFrame:
    """The sentences of a report: levels, areas by level, increases, decreases and the range of chances."""
    z = table(spark, d, "data_long", "ae_zone", "mice").where("ae_zone IS NOT NULL").groupBy("ae_zone").agg(F.round(F.avg("mice"), 4).alias("m")).where("m IS NOT NULL")
    q = z.select("ae_zone", forecast.cut3(F.col("m"), F.lit(2.0), F.lit(4.0)).alias("level"), F.round(F.col("m") / 3, 4).alias("change"), F.round(F.col("m") / 100, 4).alias("p"))
    parts = {
        "levels": forecast.range_of_levels(q, "level"), "areas": forecast.areas_by_level(q, "ae_zone", "level"), "increase": forecast.areas_that_change(q, "ae_zone", "change", up=True),
        "decrease": forecast.areas_that_change(q, "ae_zone", "change", up=False), "chance": forecast.range_of_chance(q, "p"),
    }
    out = None
    for kind, s in parts.items():
        one = s.select(F.lit(kind).alias("kind"), "sentence")
        out = one if out is None else out.unionByName(one)
    return out


QUERIES, SQL = R.queries, R.sql
