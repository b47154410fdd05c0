"""Queries on calendars, recoding, repair, and row and group filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.functions import calendar as cal
from quadrat.operators import clean, filters
from quadrat.plans.registry import Registry
from quadrat.sources.tables import table

R = Registry()
TRAPS, VISITS = "data_monitoring_traps_clean", "data_deduplicate_surveys_season"
SEASON_SQL = "CASE WHEN month({d}) IN (12,1,2) THEN 'Summer' WHEN month({d}) <= 5 THEN 'Autumn' WHEN month({d}) <= 8 THEN 'Winter' ELSE 'Spring' END"
ORD_SQL = "CAST((year({d}) + CASE WHEN month({d}) = 12 THEN 1 ELSE 0 END) * 4 + (month({d}) % 12) // 3 AS INTEGER)"


def season_sql(d: str) -> str:
    return SEASON_SQL.format(d=d)


def ord_sql(d: str) -> str:
    return ORD_SQL.format(d=d)


@R.add(f"""SELECT o_orderkey, season, year_adj, ord AS season_ord, season || '-' || year_adj AS season_year_adj, make_date(year_adj, (ord % 4) * 3 + 1, 15) AS mid_date FROM (
  SELECT o_orderkey, {season_sql("o_orderdate")} AS season, {ord_sql("o_orderdate")} AS ord, CAST({ord_sql("o_orderdate")} // 4 AS INTEGER) AS year_adj FROM orders)""")
def season_calendar(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders", "o_orderkey", "o_orderdate").withColumn("season_ord", cal.season_ord(F.col("o_orderdate")))
    s = F.col("season_ord")
    return o.select("o_orderkey", cal.ord_name(s).alias("season"), cal.ord_year(s).alias("year_adj"), "season_ord", cal.ord_label(s).alias("season_year_adj"), cal.label_mid_date(s).alias("mid_date"))


@R.add(f"""SELECT DISTINCT d, season || '-' || (ord // 4) AS this_season,
  CASE (ord + 1) % 4 WHEN 0 THEN 'Summer' WHEN 1 THEN 'Autumn' WHEN 2 THEN 'Winter' ELSE 'Spring' END || '-' || ((ord + 1) // 4) AS next_season,
  CASE (ord - 1) % 4 WHEN 0 THEN 'Summer' WHEN 1 THEN 'Autumn' WHEN 2 THEN 'Winter' ELSE 'Spring' END || '-' || ((ord - 1) // 4) AS last_season
  FROM (SELECT CAST(o_orderdate AS DATE) AS d, {season_sql("o_orderdate")} AS season, {ord_sql("o_orderdate")} AS ord FROM orders)""")
def current_next_season(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders", F.col("o_orderdate").cast("date").alias("d")).distinct()
    s = cal.season_ord(F.col("d"))
    return o.select("d", cal.ord_label(s).alias("this_season"), cal.ord_label(s + 1).alias("next_season"), cal.ord_label(s - 1).alias("last_season"))


# The rules of the ladder as SQL, written out.
_CATEGORY = """CASE WHEN coalesce(regexp_matches(k, 'fallow|stubble|plough|mulch'), false) OR coalesce(regexp_matches(s, 'fallow|stubble|plough|mulch'), false) THEN 'fallow_stubble' WHEN regexp_matches(k, 'wheat') THEN 'wheat'
  WHEN regexp_matches(k, 'barley|oats|sorghum|maize|millet|rye|ryecorn|triticale|cereal|grain_crop|cereal unknown|canary') THEN 'coarse_grains' WHEN regexp_matches(k, 'lentils|lupins|vetch|lucerne|bean|pea') THEN 'pulses'
  WHEN regexp_matches(k, 'canola|sunflower|safflower|linseed') THEN 'oilseeds' WHEN regexp_matches(k, 'fence') THEN 'fence' WHEN regexp_matches(k, 'pasture|verge|grass') THEN 'grass' END"""
_AGE = """CASE WHEN crop_category = 'fence' THEN NULL WHEN crop_category = 'grass' THEN 'old' WHEN regexp_matches(s, 'fallow|stubble|plough|mulch') THEN 'fallow_stubble' WHEN regexp_matches(s, 'tillering|seedling|young') THEN 'young'
  WHEN regexp_matches(s, 'seeding|ripe|old|grain|in head|flowering|mature') THEN 'old' END"""
_FENCED = "(SELECT record_id, CASE WHEN lower(comments) LIKE '%fence%' THEN 'fence' ELSE lower(crop_type) END AS k, lower(crop_stage) AS s FROM data_monitoring_traps_clean)"


def _fenced(spark: SparkSession, d: str) -> DataFrame:
    """Crop and stage in small letters; nights whose comment speaks of a fence are taken for fence lines."""
    kind = F.when(F.coalesce(F.contains(F.lower("comments"), F.lit("fence")), F.lit(False)), "fence").otherwise(F.lower("crop_type"))
    return table(spark, d, TRAPS, "record_id", "crop_type", "crop_stage", "comments").select("record_id", kind.alias("k"), F.lower("crop_stage").alias("s"))


@R.add(f"""SELECT record_id, crop_category, {_AGE} AS crop_age FROM (SELECT record_id, k, s, {_CATEGORY} AS crop_category FROM {_FENCED})""")
def regex_category(spark: SparkSession, d: str) -> DataFrame:
    t = _fenced(spark, d).withColumn("crop_category", clean.broad_category(F.col("k"), F.col("s"), clean.crop_ladder()))
    return t.select("record_id", "crop_category", clean.crop_age(F.col("crop_category"), F.col("s")).alias("crop_age"))


@R.add(f"""SELECT record_id, CASE WHEN crop_category = 'wheat' THEN 'fallow_stubble' ELSE crop_category END AS crop_category FROM (SELECT record_id, k, s, {_CATEGORY} AS crop_category FROM (SELECT record_id, k, s FROM {_FENCED}))
  WHERE coalesce(k NOT LIKE '%wheat%', true) AND coalesce(s NOT LIKE '%wheat%', true) UNION ALL SELECT record_id, 'fallow_stubble' FROM {_FENCED} WHERE coalesce(k LIKE '%wheat%', false) OR coalesce(s LIKE '%wheat%', false)""")
def wheat_override(spark: SparkSession, d: str) -> DataFrame:
    """The ladder as its later definition has it: wheat is taken for fallow and stubble."""
    return _fenced(spark, d).select("record_id", clean.broad_category(F.col("k"), F.col("s"), clean.crop_ladder(wheat_is_fallow=True)).alias("crop_category"))


@R.add("""SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' ELSE o_orderstatus END AS teats, o_orderpriority AS pregnant FROM orders""")
def recoded_twice(spark: SparkSession, d: str) -> DataFrame:
    """A column derived from one that is recoded already passes through."""
    labels = {"O": "open", "F": "filled"}
    o = table(spark, d, "orders", "o_orderkey", clean.recode(F.col("o_orderstatus"), labels).alias("teats"), F.col("o_orderpriority").alias("pregnant"))
    return o.withColumn("pregnant", clean.recoded_again(F.col("pregnant"), F.col("teats"), {"O": "yes", "F": "no"}))


@R.add("""SELECT record_id, coalesce(crop_type, CASE WHEN regexp_matches(lower(comments), '\\bwheat\\b') THEN 'wheat' WHEN regexp_matches(lower(comments), '\\bbarley\\b') THEN 'barley' WHEN regexp_matches(lower(comments), '\\bstubble\\b') THEN 'stubble' END) AS crop,
  nullif(concat_ws('_', crop_type, crop_stage), '') AS crop_condensed, CASE WHEN lower(trap_type) IN ('longworth', 'elliott') THEN 'box_trap' WHEN lower(trap_type) <> 'snapback' THEN lower(trap_type) END AS trap FROM data_monitoring_traps_clean""")
def older_cleaning(spark: SparkSession, d: str) -> DataFrame:
    """Recodes of the older cleaners: crops from comments, type and stage in one, box traps as one kind."""
    t = table(spark, d, TRAPS, "record_id", "crop_type", "crop_stage", "trap_type", "comments")
    return t.select("record_id", clean.crop_from_comment(F.col("crop_type"), F.col("comments"), ("wheat", "barley", "stubble")).alias("crop"), clean.type_and_stage(F.col("crop_type"), F.col("crop_stage")).alias("crop_condensed"), clean.trap_group(F.col("trap_type")).alias("trap"))


@R.add("""SELECT p_partkey, coalesce(age, CASE WHEN cat IS NULL OR cat NOT IN ('PROMO', 'LARGE') THEN CASE WHEN b = 'low' OR cover < 50 THEN 'young' WHEN b IN ('medium', 'high') OR cover >= 50 THEN 'old' END END) AS crop_age
  FROM (SELECT p_partkey, nullif(p_type, 'SMALL') AS cat, CASE WHEN p_brand = 'Brand#1' THEN 'old' END AS age, nullif(p_size * 2, 40) AS cover, CASE WHEN p_type = 'ECONOMY' THEN 'low' WHEN p_type = 'MEDIUM' THEN 'medium' END AS b FROM part)""")
def impute_crop_age(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    age = F.when(F.col("p_brand") == "Brand#1", "old")
    biomass = F.when(F.col("p_type") == "ECONOMY", "Low").when(F.col("p_type") == "MEDIUM", "Medium")
    return p.select("p_partkey", clean.impute_age(age, F.nullif("p_type", F.lit("SMALL")), F.nullif(F.col("p_size") * 2, F.lit(40)), biomass, ("PROMO", "LARGE")).alias("crop_age"))


@R.add("""SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' ELSE o_orderstatus END AS status, CASE WHEN o_custkey % 10 = 9 THEN NULL WHEN o_custkey % 10 = 1 THEN 'longworth' WHEN o_custkey % 10 = 2 THEN 'elliott' ELSE CAST(o_custkey % 10 AS VARCHAR) END AS kind FROM orders""")
def recode_lookup(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
    return o.select("o_orderkey", clean.recode(F.col("o_orderstatus"), {"O": "open", "F": "filled"}).alias("status"), clean.recode(F.col("o_custkey") % 10, {1: "longworth", 2: "elliott"}, (9,)).alias("kind"))


@R.add("""SELECT record_id, nullif(lower(trim(crop_type, ' ')), '') AS crop_type, nullif(lower(trim(season, ' ')), '') AS season, nullif(lower(trim(farmer, ' ')), '') AS farmer FROM data_monitoring_traps_clean""")
def blank_to_null(spark: SparkSession, d: str) -> DataFrame:
    return clean.blank_to_null(table(spark, d, TRAPS, "record_id", "crop_type", "season", "farmer"))


@R.add("""SELECT survey_id, CASE WHEN lower(region) = 'lower cooyecka' THEN 'cooyecka' WHEN lower(region) = 'upper glainooin' THEN 'glainooin' ELSE lower(region) END AS region,
  CASE WHEN lower(site) = 'poobelo station' AND session_start_date < DATE '2015-01-01' THEN 'poobelo west' WHEN lower(site) = 'poobelo station' AND session_start_date >= DATE '2015-01-01' THEN 'poobelo east' ELSE lower(site) END AS site FROM data_deduplicate_surveys_season""")
def rename_rules(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, VISITS, "survey_id", "region", "site", "session_start_date").withColumns({"region": F.lower("region"), "site": F.lower("site")})
    regions = spark.createDataFrame([("lower cooyecka", "cooyecka"), ("upper glainooin", "glainooin")], "old string, new string")
    sites = spark.createDataFrame([("poobelo station", "poobelo west", None, "2015-01-01"), ("poobelo station", "poobelo east", "2015-01-01", None)], "old string, new string, since string, before string")
    sites = sites.withColumns({c: F.col(c).cast("date") for c in ("since", "before")})
    v = clean.rename_by_rules(v, F.broadcast(regions), "region", "region")  # two rules
    v = clean.rename_by_rules(v, F.broadcast(sites), "site", "site", day="session_start_date")  # two rules
    return v.select("survey_id", "region", "site")


_XY = "nullif(nullif(longitude, 'NaN'::DOUBLE), 0) AS longitude, nullif(nullif(latitude, 'NaN'::DOUBLE), 0) AS latitude"


def _points(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "site_data", "site_data_id", "region", "site", "farmer", "data_source", "longitude", "latitude")
    return s.withColumns({c: F.nullif(F.nanvl(F.col(c), F.lit(None).cast("double")), F.lit(0.0)) for c in ("longitude", "latitude")})


@R.add(f"""WITH s AS (SELECT site_data_id, region, site, data_source = 'partner' AS changed, {_XY} FROM site_data),
  m AS (SELECT region, site, avg(longitude) AS x, avg(latitude) AS y FROM (SELECT DISTINCT region, site, longitude, latitude FROM s WHERE NOT changed) GROUP BY ALL)
  SELECT site_data_id, round(CASE WHEN changed THEN coalesce(x, longitude) ELSE longitude END, 6) AS longitude, round(CASE WHEN changed THEN coalesce(y, latitude) ELSE latitude END, 6) AS latitude
  FROM s LEFT JOIN m ON s.region IS NOT DISTINCT FROM m.region AND s.site IS NOT DISTINCT FROM m.site""")
def coordinate_backfill(spark: SparkSession, d: str) -> DataFrame:
    out = clean.backfill_coordinates(_points(spark, d), ["region", "site"], F.col("data_source") == "partner", "longitude", "latitude")
    return out.select("site_data_id", F.round("longitude", 6).alias("longitude"), F.round("latitude", 6).alias("latitude"))


@R.add(f"""WITH s AS (SELECT site_data_id, data_source, lower(trim(coalesce(farmer, 'na'))) || ' ' || lower(trim(site)) AS k, {_XY} FROM site_data),
  h AS (SELECT k, arg_min({{'x': longitude, 'y': latitude}}, site_data_id) AS p FROM s GROUP BY k)
  SELECT site_data_id, CASE WHEN data_source = 'ecology' THEN p.x ELSE longitude END AS longitude, CASE WHEN data_source = 'ecology' THEN p.y ELSE latitude END AS latitude, data_source = 'ecology' AS was_fixed FROM s JOIN h USING (k)""")
def coordinates_from_history(spark: SparkSession, d: str) -> DataFrame:
    s = _points(spark, d)
    k = F.concat_ws(" ", F.lower(F.trim(F.coalesce("farmer", F.lit("na")))), F.lower(F.trim("site")))
    return clean.coordinates_from_history(s, s, k, k, F.col("data_source") == "ecology", "site_data_id", "longitude", "latitude").select("site_data_id", "longitude", "latitude", "was_fixed")


@R.add(f"""WITH s AS (SELECT site_data_id, region, site, {_XY} FROM site_data),
  m AS (SELECT region, site, avg(longitude) AS x, avg(latitude) AS y, coalesce(min(longitude) <> max(longitude) OR min(latitude) <> max(latitude), false) AS many FROM s GROUP BY ALL)
  SELECT site_data_id, round(CASE WHEN many THEN x ELSE longitude END, 6) AS longitude, round(CASE WHEN many THEN y ELSE latitude END, 6) AS latitude FROM s JOIN m USING (region, site)""")
def coordinate_canonical(spark: SparkSession, d: str) -> DataFrame:
    out = clean.canonical_coordinates(_points(spark, d), ["region", "site"], "longitude", "latitude")
    return out.select("site_data_id", F.round("longitude", 6).alias("longitude"), F.round("latitude", 6).alias("latitude"))


@R.add("""SELECT record_id, nullif(concat_ws('; ', nullif(trim(comments, ' '), ''), nullif(trim(crop_stage, ' '), '')), '') AS notes FROM data_monitoring_traps_clean""")
def notes_concat(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, TRAPS, "record_id", "comments", "crop_stage").select("record_id", clean.joined_notes(F.col("comments"), F.col("crop_stage")).alias("notes"))


@R.add("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity - coalesce(nullif(l_linenumber, 3), 0) AS functional FROM lineitem""")
def functional_effort(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", clean.functional_effort(F.col("l_quantity"), F.nullif("l_linenumber", F.lit(3))).alias("functional"))


@R.add("""SELECT record_id, region, farmer, crop_type FROM data_monitoring_traps_clean WHERE region <> 'lower cooyecka' AND (farmer IS NULL OR farmer NOT IN ('h radrana')) AND (crop_type IS NULL OR crop_type NOT IN ('rice', 'cotton')) AND crop_stage IS NOT NULL""")
def exclusion_filter(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, TRAPS, "record_id", "region", "farmer", "crop_type", "crop_stage")
    return filters.exclude(t, {"region": ("lower cooyecka",), "farmer": ("h radrana",), "crop_type": ("rice", "cotton")}, drop_null=("crop_stage",)).drop("crop_stage")


@R.add("""SELECT record_id, site_data_id, farmer FROM data_monitoring_traps_clean t WHERE EXISTS (SELECT 1 FROM (SELECT site_data_id, farmer FROM data_monitoring_traps_clean GROUP BY ALL HAVING count(*) = count(year_adj) AND max(year_adj) >= 2018) g
  WHERE g.site_data_id = t.site_data_id AND g.farmer IS NOT DISTINCT FROM t.farmer)""")
def keep_recent_groups(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, TRAPS, "record_id", "site_data_id", "farmer", "year_adj")
    return filters.keep_groups(t, ["site_data_id", "farmer"], "year_adj", 2018).drop("year_adj")


@R.add("""SELECT record_id, farmer, date FROM data_monitoring_traps_clean WHERE NOT coalesce(farmer = 'h radrana', false) OR coalesce(date <> DATE '2018-05-01', false)""")
def drop_known_duplicates(spark: SparkSession, d: str) -> DataFrame:
    import datetime as dt

    return filters.drop_known(table(spark, d, TRAPS, "record_id", "farmer", "date"), "farmer", ("h radrana",), "date", dt.date(2018, 5, 1))


@R.add("""SELECT record_id, comments FROM data_monitoring_traps_clean WHERE comments IS NULL OR NOT regexp_matches(comments, '(?i)Wind|damp')""")
def comment_filter(spark: SparkSession, d: str) -> DataFrame:
    return filters.without_text(table(spark, d, TRAPS, "record_id", "comments"), "comments", "Wind|damp")


@R.add("""SELECT record_id, crop_type, crop_stage, comments FROM data_monitoring_traps_clean WHERE coalesce(regexp_matches(crop_type, '(?i)fallow'), false) OR coalesce(regexp_matches(crop_stage, '(?i)fallow'), false) OR coalesce(regexp_matches(comments, '(?i)fallow'), false)""")
def any_text_filter(spark: SparkSession, d: str) -> DataFrame:
    cols = ["crop_type", "crop_stage", "comments"]
    return filters.any_column_matches(table(spark, d, TRAPS, "record_id", *cols), cols, "fallow")


@R.add(f"""SELECT o_orderkey, {ord_sql("o_orderdate")} AS season_ord FROM orders WHERE {ord_sql("o_orderdate")} > 1997 * 4 AND {ord_sql("o_orderdate")} < 1999 * 4 + 2""")
def season_range(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders", "o_orderkey", "o_orderdate").withColumn("season_ord", cal.season_ord(F.col("o_orderdate")))
    after, before = (F.lit(x) for x in ("Summer-1997", "Winter-1999"))
    return o.where(filters.ordinal_between(F.col("season_ord"), None, None) & (F.col("season_ord") > cal.parse_label(after)) & (F.col("season_ord") < cal.parse_label(before))).drop("o_orderdate")


@R.add("""SELECT long_id, site_data_id FROM data_long t WHERE (SELECT count(nullif(mice, 0)) FROM data_long g WHERE g.site_data_id = t.site_data_id) > 1""")
def group_min_observed(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "data_long", "long_id", "site_data_id", F.nullif("mice", F.lit(0.0)).alias("mice"))
    return filters.min_observed(t, ["site_data_id"], "mice", 1).drop("mice")


@R.add("""SELECT count_id, site_data_id, date, count(*) OVER (PARTITION BY site_data_id, date) AS n_rows FROM counts_grids_mallee QUALIFY count(*) OVER (PARTITION BY site_data_id, date) > 1""")
def repeated_rows(spark: SparkSession, d: str) -> DataFrame:
    return filters.repeated(table(spark, d, "counts_grids_mallee", "count_id", "site_data_id", "date"), ["site_data_id", "date"])


@R.add("""SELECT survey_id, site, session_start_date FROM data_deduplicate_surveys_season QUALIFY session_start_date = max(session_start_date) OVER (PARTITION BY site)""")
def latest_rows(spark: SparkSession, d: str) -> DataFrame:
    return filters.latest(table(spark, d, VISITS, "survey_id", "site", "session_start_date"), ["site"], "session_start_date")


@R.add("""WITH c AS (SELECT count(*) AS c0, count(*) FILTER (l_quantity >= 5) AS c1, count(*) FILTER (l_quantity >= 5 AND l_discount < 0.08) AS c2, count(*) FILTER (l_quantity >= 5 AND l_discount < 0.08 AND l_returnflag <> 'R') AS c3 FROM lineitem)
  SELECT step_no, step, n_before, n_removed, round(n_removed * 100.0::DOUBLE / n_before, 4) AS pct_removed FROM (
  SELECT 1 AS step_no, 'small' AS step, c0 AS n_before, c0 - c1 AS n_removed FROM c UNION ALL SELECT 2, 'discount', c1, c1 - c2 FROM c UNION ALL SELECT 3, 'returned', c2, c2 - c3 FROM c)""")
def step_filter_log(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem", "l_quantity", "l_discount", "l_returnflag")
    return filters.step_log(li, [("small", F.col("l_quantity") >= 5), ("discount", F.col("l_discount") < 0.08), ("returned", F.col("l_returnflag") != "R")])


@R.add("""SELECT survey_id, site FROM data_deduplicate_surveys_season t WHERE site IN (SELECT site FROM data_deduplicate_surveys_season GROUP BY site HAVING sum(number_mice_caught) > 0)""")
def ever_detected(spark: SparkSession, d: str) -> DataFrame:
    return filters.ever_positive(table(spark, d, VISITS, "survey_id", "site", "number_mice_caught"), ["site"], "number_mice_caught").drop("number_mice_caught")


@R.add(f"""SELECT o_orderkey, {ord_sql("o_orderdate")} AS season_ord FROM orders WHERE {ord_sql("o_orderdate")} > (SELECT max({ord_sql("o_orderdate")}) FROM orders) - 2""")
def two_most_recent(spark: SparkSession, d: str) -> DataFrame:
    return filters.last_steps(table(spark, d, "orders", "o_orderkey", cal.season_ord(F.col("o_orderdate")).alias("season_ord")), "season_ord", 2)


@R.add("""SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) <= 2""")
def last_two_per_group(spark: SparkSession, d: str) -> DataFrame:
    return filters.last_rows(table(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey")], 2)


QUERIES, SQL = R.queries, R.sql
