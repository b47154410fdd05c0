"""Queries for the general data problems: filling, gridding, drift and proximity over the test tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.functions import calendar as cal
from quadrat.functions.missing import count_missing, text_missing
from quadrat.operators import impute, nearby, regular_grid, schema_drift
from quadrat.sources.tables import table

FIRST_DATE, LAST_DATE = dt.date(2008, 12, 1), dt.date(2025, 11, 30)
BOX = (110.0, 155.0, -45.0, -10.0)
NEAR_M = 500.0
TRAPS, LONG, GRIDS = "data_monitoring_traps_clean", "data_long", "counts_grids_mallee"


def reading_season(date: Column, season: Column, year: Column) -> Column:
    """Season ordinal of a reading: that of its date, or, without a possible date, the one its labels name."""
    dated = date.between(F.lit(FIRST_DATE), F.lit(LAST_DATE))
    return F.when(dated, cal.season_ord(date)).otherwise((year * 4 + cal.parse_season(season)).cast("int"))


# 1: missing values ---------------------------------------------------------------------------------------


def _fills(spark: SparkSession, d: str) -> list[tuple[str, str, str, DataFrame]]:
    traps = table(spark, d, TRAPS, "record_id", "site_data_id", "session", "date", "season", "year_adj", "crop_type", "phantoms")
    traps = traps.withColumn("time", reading_season(F.col("date"), F.col("season"), F.col("year_adj"))).drop("date", "season", "year_adj")
    long = table(spark, d, LONG, "long_id", "site_data_id", "session_start_date", "season_year_adj", "traps")
    long = long.withColumn("time", cal.parse_label(F.col("season_year_adj"))).drop("season_year_adj")
    crops = table(spark, d, "metadata").where("field_name = 'crop_type'").select("canonical_value")
    t_keys = {"visit": ["site_data_id", "session", "time"], "unit": ["site_data_id"], "time": ["time"]}
    l_keys = {"visit": ["site_data_id", "session_start_date", "time"], "unit": ["site_data_id"], "time": ["time"]}
    return [
        (TRAPS, "record_id", "crop_type", impute.fill_category(traps, "crop_type", text_missing(F.col("crop_type")), crops, **t_keys)),
        (TRAPS, "record_id", "phantoms", impute.fill_numeric(traps, "phantoms", count_missing(F.col("phantoms")), low=0.0, high=100.0, **t_keys)),
        (LONG, "long_id", "traps", impute.fill_numeric(long, "traps", count_missing(F.col("traps")), low=0.0, high=100.0, **l_keys)),
    ]


def p1_filled(spark: SparkSession, d: str) -> DataFrame:
    """Every row of the three fields with its value, the filled value and the mask."""
    parts = [
        df.select(F.lit(t).alias("table_name"), F.col(i).alias("row_id"), F.lit(f).alias("field_name"), F.col(f).cast("string").alias("stored_value"), F.col(f"{f}_filled").cast("string").alias("filled_value"), F.col(f"{f}_was_missing").alias("was_missing"))
        for t, i, f, df in _fills(spark, d)
    ]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The rows that the fill operators marked as filled."""
    parts = [df.where(F.col(f"{f}_was_missing")).select(F.lit(t).alias("table_name"), F.col(i).alias("row_id"), F.lit(f).alias("field_name")) for t, i, f, df in _fills(spark, d)]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


# 3: regular grid -------------------------------------------------------------------------------------------


def _season_grid(spark: SparkSession, d: str) -> DataFrame:
    cols = ("site_data_id", "date", "season", "year_adj", "mice_night")
    both = table(spark, d, TRAPS, *cols).unionByName(table(spark, d, GRIDS, *cols))
    return regular_grid.regular_grid(both, ["site_data_id"], reading_season(F.col("date"), F.col("season"), F.col("year_adj")), F.col("mice_night"), max_gap=4)


def p3_grid(spark: SparkSession, d: str) -> DataFrame:
    """Mean mice a night for each paddock and season, gaps filled up to four seasons wide or marked."""
    g = _season_grid(spark, d)
    return g.select("site_data_id", cal.ord_year(F.col("step")).alias("year_adj"), cal.ord_name(F.col("step")).alias("season"), "n_readings", F.round("value", 6).alias("mice_mean"), "prev_step", "next_step", "status")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    g = _season_grid(spark, d).where("status <> 'read'")
    return g.select("site_data_id", cal.ord_year(F.col("step")).alias("year_adj"), cal.ord_name(F.col("step")).alias("season"))


def p3_weeks(spark: SparkSession, d: str) -> DataFrame:
    """Mice a night of each paddock at the start of every week, between the readings before and after it, up to 60 days apart."""
    cols = ("site_data_id", "date", "mice_night")
    both = table(spark, d, TRAPS, *cols).unionByName(table(spark, d, GRIDS, *cols)).where(F.col("date").between(F.lit(FIRST_DATE), F.lit(LAST_DATE)))
    g = regular_grid.time_grid(both, ["site_data_id"], "date", "7 days", F.col("mice_night"), max_gap="60 days")
    return g.select("site_data_id", F.col("grid_at").cast("timestamp_ntz").cast("date").alias("week"), "n_readings", F.round("value", 6).alias("mice"), F.datediff("next_at", "prev_at").alias("gap_days"), "status")


# 4: schema drift -------------------------------------------------------------------------------------------


def _intake(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "intake_files", "file_id", "feed_id", "file_no"), table(spark, d, "intake_lines")


def p4_changes(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.schema_changes(*_intake(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    known = F.broadcast(table(spark, d, "schema_fields", "field_name"))  # a fixed table of 19 rows
    return p4_changes(spark, d).join(known, "field_name", "left_semi").select("file_id", "change_kind", "field_name")


def p4_table(spark: SparkSession, d: str) -> DataFrame:
    """All files as one table with the types of schema_fields (19 rows); what has another type is null and named in failed_casts."""
    fields = {r.field_name: r.value_type for r in table(spark, d, "schema_fields", "field_name", "value_type").collect()}
    out = schema_drift.unified_table(*_intake(spark, d), fields)
    return out.withColumn("failed_casts", F.array_join("failed_casts", ","))


# 5: proximity ----------------------------------------------------------------------------------------------


def p5_zones(spark: SparkSession, d: str) -> DataFrame:
    """The zone around each paddock, with the stated one beside it."""
    pts = table(spark, d, "site_data", "site_data_id", "longitude", "latitude").where(nearby.in_box(F.col("longitude"), F.col("latitude"), BOX))
    zone = nearby.containing_region(pts, "site_data_id", "longitude", "latitude", table(spark, d, "ae_zones"), "ae_zone", "piece_no", none="none")
    stated = table(spark, d, "data_list_ae_exp_rain_soil", "site_data_id", F.col("ae_zone").alias("stated_zone"))
    return zone.join(stated, "site_data_id", "left").select("site_data_id", F.col("region").alias("ae_zone"), "stated_zone", F.coalesce(F.lower(F.trim("stated_zone")) == F.lower("region"), F.lit(False)).alias("agrees"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pts = table(spark, d, "site_data", "site_data_id", "longitude", "latitude").where(nearby.in_box(F.col("longitude"), F.col("latitude"), BOX))
    pairs = nearby.near_pairs(pts, "site_data_id", "longitude", "latitude", NEAR_M, BOX)
    zone = nearby.containing_region(pts, "site_data_id", "longitude", "latitude", table(spark, d, "ae_zones"), "ae_zone", "piece_no", none="none")
    return pairs.join(zone.select(F.col("site_data_id").alias("first_id"), F.col("region").alias("ae_zone")), "first_id").select("first_id", "second_id", "ae_zone")


def p5_places(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of different places at most 500 m apart, each named by its smallest id, with the number of paddocks at both."""
    pairs, members = nearby.near_places(table(spark, d, "site_data", "site_data_id", "longitude", "latitude"), "site_data_id", "longitude", "latitude", NEAR_M, BOX)
    n = members.groupBy("place_id").agg(F.count(F.lit(1)).alias("n"))
    at = lambda side: n.select(F.col("place_id").alias(f"{side}_place"), F.col("n").alias(f"n_{side}"))
    return pairs.join(at("first"), "first_place").join(at("second"), "second_place").select("first_place", "second_place", "n_first", "n_second", F.round("distance_m", 3).alias("distance_m"))


QUERIES = {f.__name__: f for f in (p1_found, p1_filled, p3_found, p3_grid, p3_weeks, p4_found, p4_changes, p4_table, p5_found, p5_zones, p5_places)}

# SQL for the queries that it can express over whole tables -------------------------------------------------

_PLAIN = r"trim(regexp_replace(lower(crop_type), '[^\p{L}\p{N}]+', ' ', 'g'))"
# Written out, so that the SQL does not rest on the operator's own lists.
_NO_VALUE = """'', 'unknown', 'unk', 'unkn', 'unknwn', 'not known', 'no data', 'nodata', 'n a', 'na', 'nan', 'null', 'nil', 'none', 'missing', 'tbc', 'tba', 'tbd', 'to be confirmed',
  'x', 'xx', 'xxx', 'not recorded', 'not entered', 'not available', 'not stated', 'not given', 'not specified', 'not applicable', 'not noted', 'not supplied',
  'not provided', 'no record', 'no entry', 'no value', 'unspecified', 'undefined', 'n r', 'nr', 'n d', 'nd', 'n k', 'nk', 'blank', 'empty', 'error', 'ref', 'unsure',
  'not sure', 'dont know', 'don t know', 'no info', 'no information', 'pending', 'see notes', 'see comments'"""
_NO_TEXT = f"coalesce({_PLAIN} IN ({_NO_VALUE}) OR regexp_matches({_PLAIN}, '^9{{2,}}( 0+)?$'), true)"
_LETTERS = "regexp_replace(lower(season), '[^a-z]', '', 'g')"
_SEASON = f"""CASE WHEN {_LETTERS} IN ('djf', 'decfeb') THEN 0 WHEN {_LETTERS} IN ('mam', 'marmay') THEN 1 WHEN {_LETTERS} IN ('jja', 'junaug') THEN 2 WHEN {_LETTERS} IN ('son', 'sepnov') THEN 3
  WHEN {_LETTERS}[1:2] = 'su' THEN 0 WHEN {_LETTERS}[1:2] = 'au' THEN 1 WHEN {_LETTERS}[1:2] = 'wi' THEN 2 WHEN {_LETTERS}[1:2] = 'sp' THEN 3 END"""
_STEP = f"""CAST(CASE WHEN date BETWEEN DATE '2008-12-01' AND DATE '2025-11-30' THEN (year(date) + CASE WHEN month(date) = 12 THEN 1 ELSE 0 END) * 4 + (month(date) % 12) // 3 ELSE year_adj * 4 + {_SEASON} END AS INTEGER)"""
_GRID = f"""r AS (SELECT site_data_id, {_STEP} AS step, mice_night FROM (SELECT site_data_id, date, season, year_adj, mice_night FROM data_monitoring_traps_clean UNION ALL SELECT site_data_id, date, season, year_adj, mice_night FROM counts_grids_mallee)),
  c AS (SELECT site_data_id, step, count(*) AS n_readings, avg(nullif(mice_night, 'NaN'::DOUBLE)) AS value FROM r WHERE step IS NOT NULL GROUP BY ALL),
  g AS (SELECT site_data_id, CAST(unnest(generate_series(min(step), max(step))) AS INTEGER) AS step FROM c GROUP BY 1),
  j AS (SELECT g.site_data_id, g.step, n_readings, value, last_value(CASE WHEN n_readings IS NOT NULL THEN g.step END IGNORE NULLS) OVER b AS prev_step, first_value(CASE WHEN n_readings IS NOT NULL THEN g.step END IGNORE NULLS) OVER f AS next_step,
    last_value(CASE WHEN value IS NOT NULL THEN {{'s': g.step, 'v': value}} END IGNORE NULLS) OVER b AS a, first_value(CASE WHEN value IS NOT NULL THEN {{'s': g.step, 'v': value}} END IGNORE NULLS) OVER f AS z FROM g LEFT JOIN c USING (site_data_id, step)
    WINDOW b AS (PARTITION BY g.site_data_id ORDER BY g.step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY g.site_data_id ORDER BY g.step ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""
_NAME = "CASE step % 4 WHEN 0 THEN 'Summer' WHEN 1 THEN 'Autumn' WHEN 2 THEN 'Winter' ELSE 'Spring' END AS season"
_ZONES = """e AS (SELECT ae_zone, piece_no, lons[i] AS x1, lats[i] AS y1, lons[i + 1] AS x2, lats[i + 1] AS y2 FROM (SELECT ae_zone, piece_no, lons, lats, unnest(generate_series(1, len(lons) - 1)) AS i FROM ae_zones)),
  p AS (SELECT site_data_id AS id, longitude AS x, latitude AS y FROM site_data WHERE longitude BETWEEN 110 AND 155 AND latitude BETWEEN -45 AND -10),
  h AS (SELECT id, ae_zone, piece_no FROM p JOIN e ON (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / nullif(y2 - y1, 0) + x1 GROUP BY ALL HAVING count(*) % 2 = 1),
  z AS (SELECT id, coalesce(min(ae_zone), 'none') AS ae_zone FROM p LEFT JOIN h USING (id) GROUP BY 1)"""

SQL = {
    "p1_found": f"""SELECT 'data_monitoring_traps_clean' AS table_name, record_id AS row_id, 'crop_type' AS field_name FROM data_monitoring_traps_clean WHERE {_NO_TEXT}
      UNION ALL SELECT 'data_monitoring_traps_clean', record_id, 'phantoms' FROM data_monitoring_traps_clean WHERE NOT coalesce(phantoms BETWEEN 0 AND 100, false)
      UNION ALL SELECT 'data_long', long_id, 'traps' FROM data_long WHERE NOT coalesce(traps BETWEEN 0 AND 100, false)""",
    "p3_found": f"WITH {_GRID} SELECT site_data_id, CAST(step // 4 AS INTEGER) AS year_adj, {_NAME} FROM j WHERE n_readings IS NULL",
    "p3_grid": f"""WITH {_GRID}, v AS (SELECT *, CASE WHEN n_readings IS NOT NULL THEN value WHEN z.s - a.s <= 4 THEN a.v + (z.v - a.v) * (step - a.s) / (z.s - a.s) END AS m FROM j)
      SELECT site_data_id, CAST(step // 4 AS INTEGER) AS year_adj, {_NAME}, coalesce(n_readings, 0) AS n_readings, round(m, 6) AS mice_mean, prev_step, next_step, CASE WHEN n_readings IS NOT NULL THEN 'read' WHEN m IS NOT NULL THEN 'filled' ELSE 'gap' END AS status FROM v""",
    "p5_found": f"""WITH {_ZONES} SELECT a.id AS first_id, b.id AS second_id, z.ae_zone FROM p a JOIN p b ON a.id < b.id AND abs(a.y - b.y) < 0.005 AND abs(a.x - b.x) < 0.01
      AND 2 * 6371000 * asin(sqrt(pow(sin(radians(b.y - a.y) / 2), 2) + cos(radians(a.y)) * cos(radians(b.y)) * pow(sin(radians(b.x - a.x) / 2), 2))) <= 500 JOIN z ON z.id = a.id""",
    "p5_places": """WITH p AS (SELECT longitude AS x, latitude AS y, min(site_data_id) AS id, count(*) AS n FROM site_data WHERE longitude BETWEEN 110 AND 155 AND latitude BETWEEN -45 AND -10 GROUP BY ALL),
      j AS (SELECT a.id AS first_place, b.id AS second_place, a.n AS n_first, b.n AS n_second, 2 * 6371000 * asin(sqrt(pow(sin(radians(b.y - a.y) / 2), 2) + cos(radians(a.y)) * cos(radians(b.y)) * pow(sin(radians(b.x - a.x) / 2), 2))) AS m FROM p a JOIN p b ON a.id < b.id AND abs(a.y - b.y) < 0.005 AND abs(a.x - b.x) < 0.01)
      SELECT first_place, second_place, n_first, n_second, round(m, 3) AS distance_m FROM j WHERE m <= 500""",
    "p3_weeks": """WITH r AS (SELECT site_data_id AS s, CAST(date - DATE '1970-01-01' AS BIGINT) AS t, avg(mice_night) AS v, count(*) AS k FROM (SELECT site_data_id, date, mice_night FROM data_monitoring_traps_clean UNION ALL SELECT site_data_id, date, mice_night FROM counts_grids_mallee)
        WHERE date BETWEEN DATE '2008-12-01' AND DATE '2025-11-30' AND mice_night IS NOT NULL AND NOT isnan(mice_night) GROUP BY ALL),
      g AS (SELECT s, unnest(generate_series((min(t) + 6) // 7, max(t) // 7)) * 7 AS g FROM r GROUP BY s),
      p AS (SELECT g.s, g.g, r.t, r.v FROM g ASOF JOIN r ON g.s = r.s AND g.g >= r.t), n AS (SELECT g.s, g.g, r.t, r.v FROM g ASOF JOIN r ON g.s = r.s AND g.g <= r.t), c AS (SELECT s, t // 7 * 7 AS g, CAST(sum(k) AS BIGINT) AS k FROM r GROUP BY ALL)
      SELECT p.s AS site_data_id, DATE '1970-01-01' + CAST(p.g AS INTEGER) AS week, coalesce(c.k, 0) AS n_readings, round(CASE WHEN p.t = n.t THEN p.v WHEN n.t - p.t <= 60 THEN p.v + (n.v - p.v) * (p.g - p.t) / (n.t - p.t) END, 6) AS mice, CAST(n.t - p.t AS INTEGER) AS gap_days,
        CASE WHEN p.t = n.t THEN 'read' WHEN n.t - p.t <= 60 THEN 'filled' ELSE 'gap' END AS status FROM p JOIN n USING (s, g) LEFT JOIN c USING (s, g)""",
    "p5_zones": f"""WITH {_ZONES} SELECT z.id AS site_data_id, z.ae_zone, s.ae_zone AS stated_zone, coalesce(lower(trim(s.ae_zone, ' ')) = lower(z.ae_zone), false) AS agrees FROM z LEFT JOIN data_list_ae_exp_rain_soil s ON s.site_data_id = z.id""",
}


def _split_sql(line: str) -> str:
    cases = " ".join(f"WHEN {d!r} THEN regexp_extract_all({d!r} || {line}, '{e}(?:\"(?:[^\"]|\"\")*\"|[^{e}]*)')" for d, e in ((",", ","), (";", ";"), ("|", "\\|"))) + f" ELSE regexp_extract_all(chr(9) || {line}, '\\t(?:\"(?:[^\"]|\"\")*\"|[^\\t]*)')"
    return f"list_transform(CASE d {cases} END, lambda x: CASE WHEN trim(x[2:]) LIKE '\"%\"' THEN replace(trim(x[2:])[2:-2], '\"\"', '\"') ELSE trim(x[2:]) END)"


_N = lambda d: f"length(h) - length(replace(h, {d}, ''))"
_ALIASES = """('croptype', 'crop_type'), ('cropname', 'crop_type'), ('croptypeold', 'crop_type'), ('cropgrown', 'crop_type'), ('crop', 'crop_type'), ('cropstage', 'crop_stage'),
  ('cropstageold', 'crop_stage'), ('growthstage', 'crop_stage'), ('stage', 'crop_stage'), ('subsite', 'subsite'), ('paddock', 'subsite'), ('datasitename', 'subsite'),
  ('datasitenameold', 'subsite'), ('site', 'site'), ('sitename', 'site'), ('property', 'site'), ('farm', 'site'), ('region', 'region'), ('areaname', 'region'),
  ('area', 'region'), ('capturedate', 'capture_date'), ('trapdate', 'capture_date'), ('date', 'capture_date'), ('surveynight', 'survey_night'), ('night', 'survey_night'),
  ('traptype', 'trap_type'), ('trapmodel', 'trap_type'), ('trapsset', 'traps_set'), ('ntraps', 'traps_set'), ('numbertrapsset', 'traps_set'), ('phantoms', 'phantoms'),
  ('numberphantoms', 'phantoms'), ('falsetriggers', 'phantoms'), ('micecaught', 'mice_caught'), ('mice', 'mice_caught'), ('numbermicecaught', 'mice_caught'),
  ('totalcaptures', 'mice_caught'), ('weightg', 'weight_g'), ('weight', 'weight_g'), ('lengthmm', 'length_mm'), ('length', 'length_mm'), ('longitude', 'longitude'),
  ('xcoord', 'longitude'), ('eastingdeg', 'longitude'), ('latitude', 'latitude'), ('ycoord', 'latitude'), ('northingdeg', 'latitude'),
  ('groundcoverpercent', 'ground_cover_percent'), ('groundcoverpc', 'ground_cover_percent'), ('groundcover', 'ground_cover_percent'), ('biomass', 'biomass'),
  ('biomassnew', 'biomass'), ('pittag', 'pit_tag'), ('tagread', 'pit_tag'), ('observercomment', 'observer_comment'), ('comments', 'observer_comment'),
  ('remarks', 'observer_comment')"""
_DAY, _MON = "(0?[1-9]|[12][0-9]|3[01])", "(0?[1-9]|1[0-2])"
_DATE = rf"(\d{{4}}[-/.]{_MON}[-/.]{_DAY}|{_DAY}[-/. ]{_MON}[-/. ]\d{{2,4}}|{_DAY}[- ](jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*[-, ]+\d{{2,4}})"
_CHANGES = rf"""WITH al(path, field) AS (VALUES {_ALIASES}),
  h AS (SELECT file_id, min(line) AS h FROM intake_lines WHERE line_no = 0 GROUP BY 1),
  d AS (SELECT file_id, h, CASE greatest({_N("','")}, {_N("';'")}, {_N("chr(9)")}, {_N("'|'")}) WHEN {_N("','")} THEN ',' WHEN {_N("';'")} THEN ';' WHEN {_N("chr(9)")} THEN chr(9) ELSE '|' END AS d FROM h),
  p AS (SELECT file_id, d, list_transform({_split_sql("h")}, lambda x: regexp_replace(lower(x), '[\s._]+', '', 'g')) AS paths FROM d),
  c AS (SELECT file_id, unnest(paths) AS path, unnest(generate_series(1, len(paths))) AS i FROM p),
  v AS (SELECT file_id, unnest(s) AS v, unnest(generate_series(1, len(s))) AS i FROM (SELECT l.file_id, {_split_sql("line")} AS s FROM intake_lines l JOIN p USING (file_id) WHERE line_no > 0)),
  k AS (SELECT file_id, i, CASE WHEN bool_and(regexp_full_match(v, '[+-]?\d+')) THEN 'integer' WHEN bool_and(regexp_full_match(v, '[+-]?(\d+\.\d*|\.\d+|\d+)')) THEN 'decimal' WHEN bool_and(regexp_full_match(lower(v), '{_DATE}')) THEN 'date' ELSE 'text' END AS kind FROM v WHERE v <> '' GROUP BY ALL),
  f AS (SELECT file_id, coalesce(al.field, c.path) AS field_name, arg_min({{'path': c.path, 'kind': k.kind}}, c.path) AS c FROM c LEFT JOIN k USING (file_id, i) LEFT JOIN al ON al.path = c.path GROUP BY ALL),
  q AS (SELECT file_id, lag(file_id) OVER (PARTITION BY feed_id ORDER BY file_no, file_id) AS before FROM intake_files SEMI JOIN h USING (file_id)),
  j AS (SELECT coalesce(a.file_id, b.file_id) AS file_id, coalesce(a.field_name, b.field_name) AS field_name, a.c AS a, b.c AS b FROM (SELECT f.* FROM f JOIN q USING (file_id) WHERE before IS NOT NULL) a
    FULL JOIN (SELECT q.file_id, field_name, c FROM q JOIN f ON f.file_id = q.before) b ON a.file_id = b.file_id AND a.field_name = b.field_name)
  SELECT file_id, 'added' AS change_kind, field_name, CAST(NULL AS VARCHAR) AS before, a.path AS after FROM j WHERE b IS NULL UNION ALL SELECT file_id, 'removed', field_name, b.path, NULL FROM j WHERE a IS NULL
  UNION ALL SELECT file_id, 'renamed', field_name, b.path, a.path FROM j WHERE a.path <> b.path UNION ALL SELECT file_id, 'retyped', field_name, b.kind, a.kind FROM j WHERE a.kind <> b.kind"""
SQL |= {"p4_changes": _CHANGES, "p4_found": f"SELECT file_id, change_kind, field_name FROM ({_CHANGES})"}
