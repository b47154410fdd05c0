"""Queries on group summaries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.functions import calendar as cal
from quadrat.functions.nullsafe import clamp, pct_deviation, strict_max, strict_mean, strict_min, strict_sum
from quadrat.operators import aggregates as agg
from quadrat.plans.cleaning import ord_sql
from quadrat.plans.registry import Registry
from quadrat.sources.tables import table

R = Registry()
TRAPS, VISITS = "data_monitoring_traps_clean", "data_deduplicate_surveys_season"


def monthly(spark: SparkSession, d: str) -> DataFrame:
    """(nation, month, season_ord, total, n) of orders."""
    o = table(spark, d, "orders", "o_custkey", "o_orderdate", "o_totalprice").join(table(spark, d, "customer", "c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    m = o.groupBy(F.col("c_nationkey").alias("nation"), F.trunc("o_orderdate", "month").alias("month")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.count(F.lit(1)).alias("n"))
    return m.withColumn("season_ord", cal.season_ord(F.col("month")))


MONTHLY = f"""m AS (SELECT nation, month, total, n, {ord_sql("month")} AS season_ord FROM (SELECT c_nationkey AS nation, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL))"""


@R.add("""SELECT region, sum(n) AS n_rows, round(sum(s), 2) AS traps, round(min(lo), 2) AS least, round(max(hi), 2) AS most, count(DISTINCT site) AS n_sites, bool_or(hi > 50) AS any_high FROM (SELECT region, site, count(*) AS n, sum(traps_set) AS s, min(traps_set) AS lo, max(traps_set) AS hi FROM data_monitoring_traps_clean GROUP BY ALL) GROUP BY region""".replace("sum(n) AS n_rows", "CAST(sum(n) AS BIGINT) AS n_rows"))
def group_summary(spark: SparkSession, d: str) -> DataFrame:
    return agg.overview(table(spark, d, TRAPS, "region", "site", "traps_set"), ["region"], "traps_set", "site", 50)


@R.add("""SELECT site, CASE WHEN count(traps_set) = count(*) THEN sum(traps_set) END AS s, round(CASE WHEN count(traps_set) = count(*) THEN avg(traps_set) END, 6) AS m, CASE WHEN count(traps_set) = count(*) THEN min(traps_set) END AS lo, CASE WHEN count(traps_set) = count(*) THEN max(traps_set) END AS hi FROM data_deduplicate_surveys_season GROUP BY site""")
def strict_aggregates(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("traps_set")
    return table(spark, d, VISITS, "site", "traps_set").groupBy("site").agg(strict_sum(x).alias("s"), F.round(strict_mean(x), 6).alias("m"), strict_min(x).alias("lo"), strict_max(x).alias("hi"))


@R.add("""SELECT region, count(*) AS n_sites, CAST(sum(CAST(det AS INTEGER)) AS BIGINT) AS n_detected, round(sum(CAST(det AS INTEGER)) / count(*), 4) AS prop FROM (SELECT region, site, subsite, coalesce(bool_or(mice_night > 0), false) AS det FROM data_monitoring_traps_clean GROUP BY ALL) GROUP BY region""")
def two_step_detection(spark: SparkSession, d: str) -> DataFrame:
    return agg.detection_by_area(table(spark, d, TRAPS, "region", "site", "subsite", "mice_night"), ["region"], ["site", "subsite"], "mice_night")


@R.add("""SELECT region, n_sites, n_detected, round(n_detected / n_sites, 4) AS prop FROM (SELECT region, count(*) AS n_sites, CAST(sum(CAST(det AS INTEGER)) AS BIGINT) AS n_detected FROM (
  SELECT region, site, coalesce(bool_or(v > 0), false) AS det FROM (SELECT lower(region) AS region, lower(site) AS site, mice_night AS v FROM counts_grids_mallee UNION ALL SELECT lower(region), lower(site), number_mice_caught FROM data_deduplicate_surveys_season) GROUP BY ALL) GROUP BY region)""")
def detection_union(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda t, v: table(spark, d, t, F.lower("region").alias("region"), F.lower("site").alias("site"), F.col(v).alias("v"))
    return agg.detection_by_area(pick("counts_grids_mallee", "mice_night").unionByName(pick(VISITS, "number_mice_caught")), ["region"], ["site"], "v")


@R.add("""SELECT region, round(avg(r), 4) AS mean_ratio FROM (SELECT region, site, sum(mice_night) / nullif(sum(traps_set), 0) AS r FROM data_monitoring_traps_clean GROUP BY ALL) GROUP BY region""")
def mean_of_ratios(spark: SparkSession, d: str) -> DataFrame:
    return agg.mean_of_ratios(table(spark, d, TRAPS, "region", "site", "mice_night", "traps_set"), ["region"], ["site"], "mice_night", "traps_set")


@R.add("""SELECT region, round(sum(CASE WHEN v THEN mice_night * traps_set END) / nullif(sum(CASE WHEN v THEN traps_set END), 0), 4) AS weighted_mean FROM (SELECT region, mice_night, traps_set, mice_night IS NOT NULL AND coalesce(traps_set > 0, false) AS v FROM data_monitoring_traps_clean) GROUP BY region""")
def weighted_mean_valid(spark: SparkSession, d: str) -> DataFrame:
    return agg.weighted_mean_valid(table(spark, d, TRAPS, "region", "mice_night", "traps_set"), ["region"], "mice_night", "traps_set")


@R.add(f"""WITH {MONTHLY} SELECT nation, season_ord, CASE WHEN count(*) = 3 THEN round(sum(total), 2) END AS total_sum, CASE WHEN count(*) = 3 THEN round(avg(total), 4) END AS total_mean, CASE WHEN count(*) = 3 THEN max(n) END AS n_max, CASE WHEN count(*) = 3 THEN min(n) END AS n_min FROM m GROUP BY nation, season_ord""")
def seasonal_strict(spark: SparkSession, d: str) -> DataFrame:
    s = agg.seasonal_strict(monthly(spark, d), ["nation"], "season_ord", "month", {"total_sum": ("total", "sum"), "total_mean": ("total", "mean"), "n_max": ("n", "max"), "n_min": ("n", "min")})
    return s.withColumns({"total_sum": F.round("total_sum", 2), "total_mean": F.round("total_mean", 4)})


@R.add("""WITH f AS (SELECT date_trunc('month', l_shipdate) AS mo FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_shipdate) >= 27) SELECT l_returnflag, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, round(avg(l_quantity), 6) AS value FROM lineitem WHERE date_trunc('month', l_shipdate) IN (SELECT mo FROM f) GROUP BY ALL""")
def complete_periods(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem", "l_returnflag", "l_shipdate", "l_quantity").withColumn("month", F.trunc("l_shipdate", "month"))
    return agg.complete_periods(li, ["l_returnflag"], "month", "l_shipdate", "l_quantity", 27).withColumn("value", F.round("value", 6))


@R.add("""WITH w AS (SELECT date_trunc('month', l_shipdate) AS mo, l_discount * 100 AS lo, nullif(l_quantity, 13) AS hi, l_tax * 100 AS vp FROM lineitem)
  SELECT CAST(mo AS DATE) AS month, round(sum(greatest(0, (lo + least(hi, 30)) / 2 - 5)) FILTER (hi IS NOT NULL), 4) AS degree_days, count(*) FILTER (lo < 2 AND vp < 4) AS frost_days, count(*) FILTER (hi > 30) AS heat_days FROM w GROUP BY mo""")
def degree_frost_heat_days(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem", "l_shipdate", "l_discount", "l_quantity", "l_tax")
    lo, hi, vp = F.col("l_discount") * 100, F.nullif("l_quantity", F.lit(13.0)), F.col("l_tax") * 100
    return li.groupBy(F.trunc("l_shipdate", "month").alias("month")).agg(F.round(F.sum(agg.degree_days(lo, hi)), 4).alias("degree_days"), F.count_if(agg.frost_day(lo, vp)).alias("frost_days"), F.count_if(agg.heat_day(hi)).alias("heat_days"))


@R.add("""SELECT CAST(year(session_start_date) AS INTEGER) AS year, CASE WHEN grouping(state) = 1 THEN 'Total' ELSE state END AS state, CAST(sum(number_mice_caught) AS DOUBLE) AS mice FROM (SELECT session_start_date, nullif(lower(region), 'lower cooyecka') AS state, number_mice_caught FROM data_deduplicate_surveys_season) GROUP BY GROUPING SETS ((year(session_start_date), state), (year(session_start_date)))""")
def totals_rollup(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, VISITS, F.year("session_start_date").alias("year"), F.nullif(F.lower("region"), F.lit("lower cooyecka")).alias("state"), "number_mice_caught")
    return agg.totals(v, ["year"], "state", F.sum("number_mice_caught"), "mice")


@R.add(f"""WITH {MONTHLY}, e AS (SELECT n_nationkey AS nation, unnest([0, 1, 2, 3]) AS s FROM nation), x AS (SELECT nation, CAST(s AS INTEGER) AS season, CAST(CASE s WHEN 0 THEN nation % 3 WHEN 1 THEN 20 ELSE 30 END AS BIGINT) AS expected FROM e),
  a AS (SELECT nation, CAST(season_ord % 4 AS INTEGER) AS season, CAST(sum(n) AS BIGINT) AS actual FROM m WHERE season_ord // 4 = 1997 GROUP BY ALL)
  SELECT nation, season, expected, coalesce(actual, 0) AS actual, coalesce(actual, 0) - expected AS difference, round(CASE WHEN expected > 0 THEN coalesce(actual, 0) / expected WHEN actual > 0 THEN 2.0::DOUBLE END, 4) AS ratio FROM x LEFT JOIN a USING (nation, season)""")
def schedule_compliance(spark: SparkSession, d: str) -> DataFrame:
    plan = table(spark, d, "nation", F.col("n_nationkey").alias("nation"), (F.col("n_nationkey") % 3).alias("s0"), F.lit(20).alias("s1"), F.lit(30).alias("s2"), F.lit(30).alias("s3"))
    expected = plan.unpivot("nation", ["s0", "s1", "s2", "s3"], "s", "expected").select("nation", F.substring("s", 2, 1).cast("int").alias("season"), F.col("expected").cast("long").alias("expected"))
    actual = monthly(spark, d).where(cal.ord_year(F.col("season_ord")) == 1997).groupBy("nation", (F.col("season_ord") % 4).alias("season")).agg(F.sum("n").alias("actual"))
    return agg.compliance(expected, actual, ["nation", "season"])


@R.add("""SELECT region, round(sum(CASE WHEN v < 0 THEN v END), 2) AS below FROM (SELECT region, phantoms - 2 AS v FROM counts_grids_mallee WHERE phantoms BETWEEN 0 AND 100) GROUP BY region""")
def conditional_sum(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "counts_grids_mallee", "region", "phantoms").where("phantoms BETWEEN 0 AND 100 AND NOT isnan(phantoms)")
    v = F.col("phantoms") - 2
    return c.groupBy("region").agg(F.round(F.sum(F.when(v < 0, v)), 2).alias("below"))


@R.add("""WITH t AS (SELECT site_data_id, session_start_date, CAST(round(CAST(CAST(nullif(longitude, 'NaN'::DOUBLE) AS VARCHAR) AS DECIMAL(18, 8)), 4) AS DOUBLE) AS x, CAST(round(CAST(CAST(nullif(latitude, 'NaN'::DOUBLE) AS VARCHAR) AS DECIMAL(18, 8)), 4) AS DOUBLE) AS y FROM data_monitoring_traps_clean)
  SELECT site_data_id, min(x) AS longitude, min(y) AS latitude, count(DISTINCT (x, y)) AS n_places, max(session_start_date) AS last_day, coalesce(DATE '2025-06-30' - max(session_start_date) <= 730.5, false) AS is_current FROM t GROUP BY 1""")
def site_registry(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, TRAPS, "site_data_id", "longitude", "latitude", "session_start_date").withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in ("longitude", "latitude")})
    return agg.registry(t, ["site_data_id"], "longitude", "latitude", "session_start_date", dt.date(2025, 6, 30), 730.5)


@R.add("""SELECT trap_type, crop_stage, count(*) AS n FROM data_monitoring_traps_clean GROUP BY ALL""")
def crosstab(spark: SparkSession, d: str) -> DataFrame:
    return agg.crosstab(table(spark, d, TRAPS, "trap_type", "crop_stage"), "trap_type", "crop_stage")


@R.add("""SELECT CAST(y AS INTEGER) AS y, count(*) AS n FROM (SELECT year(session_start_date) AS y FROM data_monitoring_traps_clean UNION ALL SELECT year(session_end_date) FROM data_monitoring_traps_clean UNION ALL SELECT year(date) FROM data_monitoring_traps_clean) WHERE y IS NOT NULL GROUP BY y ORDER BY n DESC, y LIMIT 1""".replace("year(session_start_date) AS y", "CAST(year(session_start_date) AS INTEGER) AS y"))
def mode_year(spark: SparkSession, d: str) -> DataFrame:
    return agg.mode_of(table(spark, d, TRAPS, "session_start_date", "session_end_date", "date"), [F.year(c) for c in ("session_start_date", "session_end_date", "date")], "y")


@R.add("""SELECT max(n) AS max_individuals, round(max(rate), 6) AS max_rate FROM (SELECT site_data_id, session, count(*) AS n, greatest(0.001, least(0.999, sum(mice_night) / nullif(sum(traps_set), 0))) * 100 AS rate FROM data_monitoring_traps_clean GROUP BY ALL HAVING sum(mice_night) / nullif(sum(traps_set), 0) IS NOT NULL)""")
def global_scales(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, TRAPS, "site_data_id", "session", "mice_night", "traps_set").groupBy("site_data_id", "session")
    s = t.agg(F.count(F.lit(1)).alias("n"), (clamp(F.sum("mice_night") / F.nullif(F.sum("traps_set"), F.lit(0.0)), 0.001, 0.999) * 100).alias("rate"))
    return s.where("rate IS NOT NULL").agg(F.max("n").alias("max_individuals"), F.round(F.max("rate"), 6).alias("max_rate"))


@R.add("""WITH n AS (SELECT subsite, session, CAST(round(least(mice_night / nullif(traps_set, 0), 1) * 100, 6) AS DECIMAL(18, 6)) AS v FROM data_monitoring_traps_clean WHERE mice_night IS NOT NULL AND traps_set IS NOT NULL),
  s AS (SELECT subsite, CAST(round(CAST(sum(v) AS DOUBLE) / nullif(count(v), 0), 6) AS DECIMAL(18, 6)) AS s FROM n GROUP BY subsite, session)
  SELECT subsite, round(CAST(sum(s) AS DOUBLE) / nullif(count(s), 0), 4) AS mean_rate FROM s GROUP BY subsite""")
def session_rates(spark: SparkSession, d: str) -> DataFrame:
    return agg.mean_session_rate(table(spark, d, TRAPS, "subsite", "session", "mice_night", "traps_set"), "subsite", "session", "mice_night", "traps_set")


@R.add("""SELECT count(DISTINCT lower(region)) AS n_regions, count(DISTINCT lower(site)) AS n_sites, CAST(sum(number_mice_caught) AS DOUBLE) AS mice, round(CASE WHEN sum(traps_set) > 0 THEN 100 * sum(number_mice_caught) / sum(traps_set) ELSE 0 END, 4) AS pct, min(session_start_date) AS first_day, max(session_end_date) AS last_day FROM data_deduplicate_surveys_season""")
def headline_stats(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, VISITS, "region", "site", "number_mice_caught", "traps_set", "session_start_date", "session_end_date")
    return agg.headline(v, "region", "site", "number_mice_caught", "traps_set", "session_start_date", "session_end_date")


@R.add("""SELECT user_id, string_agg(event_type, ' -> ' ORDER BY t) AS trail, string_agg(event_type, ' & ' ORDER BY event_type) AS labels FROM (SELECT user_id, event_type, min(ts) AS t FROM events GROUP BY ALL) GROUP BY user_id""")
def ordered_labels(spark: SparkSession, d: str) -> DataFrame:
    return agg.ordered_labels(table(spark, d, "events", "user_id", "event_type", "ts"), ["user_id"], "event_type", "ts")


@R.add("""SELECT site, round(avg(mice_night) FILTER (date = m), 6) AS latest_mean FROM (SELECT site, mice_night, date, max(date) OVER (PARTITION BY site) AS m FROM counts_grids_mallee) GROUP BY site""")
def mean_on_latest(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "counts_grids_mallee", "site", "date", "mice_night")
    daily = c.groupBy("site", "date").agg(F.sum("mice_night").alias("s"), F.count("mice_night").alias("k"))
    return daily.groupBy("site").agg(F.round(F.max_by(F.col("s") / F.nullif("k", F.lit(0)), "date"), 6).alias("latest_mean"))


@R.add("""SELECT region, round(avg(longitude), 6) AS longitude, round(avg(latitude), 6) AS latitude FROM site_data WHERE longitude BETWEEN 110 AND 155 AND latitude BETWEEN -45 AND -10 GROUP BY region""")
def region_centroid(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "site_data", "region", "longitude", "latitude").where("longitude BETWEEN 110 AND 155 AND latitude BETWEEN -45 AND -10")
    return s.groupBy("region").agg(F.round(F.avg("longitude"), 6).alias("longitude"), F.round(F.avg("latitude"), 6).alias("latitude"))


_COLS = ("l_quantity", "l_discount", "l_tax")


@R.add("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT AS n_present, coalesce((a > 0)::INT, 0) + coalesce((b > 0)::INT, 0) + coalesce((c > 0)::INT, 0) AS n_positive,
  CASE WHEN coalesce(a, b, c) IS NOT NULL THEN round(coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0), 6) END AS total, greatest(a, b, c) AS top, round(a + b + c, 6) AS strict_total
  FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, nullif(l_quantity, 7) AS a, nullif(l_discount, 0) AS b, nullif(l_tax, 0) AS c FROM lineitem)""")
def rowwise_counts(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *_COLS)
    cols = [F.nullif("l_quantity", F.lit(7.0)), F.nullif("l_discount", F.lit(0.0)), F.nullif("l_tax", F.lit(0.0))]
    c = agg.row_counts(cols)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", c["n_present"].alias("n_present"), c["n_positive"].alias("n_positive"), F.round(c["total"], 6).alias("total"), c["top"].alias("top"), F.round(agg.strict_row_sum(cols), 6).alias("strict_total"))


@R.add("""SELECT 'l_quantity' AS a, 'l_discount' AS b, round(corr(l_quantity, nullif(l_discount, 0)), 6) AS r FROM lineitem UNION ALL SELECT 'l_quantity', 'l_tax', round(corr(l_quantity, l_tax), 6) FROM lineitem UNION ALL SELECT 'l_discount', 'l_tax', round(corr(nullif(l_discount, 0), l_tax), 6) FROM lineitem""")
def correlation_pairs(spark: SparkSession, d: str) -> DataFrame:
    return agg.correlations(table(spark, d, "lineitem", "l_quantity", F.nullif("l_discount", F.lit(0.0)).alias("l_discount"), "l_tax"), list(_COLS))


@R.add(f"""WITH {MONTHLY}, a AS (SELECT month(month) AS mo, nation, avg(total) AS normal FROM m GROUP BY ALL) SELECT m.nation, m.month, round((total - normal) / nullif(normal, 0) * 100, 4) AS pctdev FROM m JOIN a ON a.nation = m.nation AND a.mo = month(m.month)""")
def pct_deviation_normals(spark: SparkSession, d: str) -> DataFrame:
    m = monthly(spark, d).withColumn("mo", F.month("month"))
    normal = m.groupBy("nation", "mo").agg(F.avg("total").alias("normal"))
    return m.join(normal, ["nation", "mo"]).select("nation", "month", F.round(pct_deviation(F.col("total"), F.col("normal")), 4).alias("pctdev"))


@R.add(f"""WITH {MONTHLY}, s AS (SELECT nation, CAST(year(month) AS INTEGER) AS year, month(month) BETWEEN 4 AND 10 AS in_season, sum(total) AS total FROM m GROUP BY ALL), a AS (SELECT nation, in_season, avg(total) AS normal FROM s GROUP BY ALL)
  SELECT s.nation, s.year, s.in_season, round(s.total, 2) AS total, round((s.total - normal) / nullif(normal, 0) * 100, 4) AS pctdev FROM s JOIN a USING (nation, in_season)""")
def season_flag_totals(spark: SparkSession, d: str) -> DataFrame:
    s = monthly(spark, d).groupBy("nation", F.year("month").alias("year"), F.month("month").between(4, 10).alias("in_season")).agg(F.sum("total").alias("total"))
    a = s.groupBy("nation", "in_season").agg(F.avg("total").alias("normal"))
    return s.join(a, ["nation", "in_season"]).select("nation", "year", "in_season", F.round("total", 2).alias("total"), F.round(pct_deviation(F.col("total"), F.col("normal")), 4).alias("pctdev"))


@R.add("""SELECT survey_id, round(coalesce(traps_set, trunc((SELECT avg(traps_set) FROM data_deduplicate_surveys_season))), 4) AS effort, traps_set IS NULL AS was_filled FROM data_deduplicate_surveys_season""")
def impute_global_mean(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, VISITS, "survey_id", "traps_set")
    mean = v.agg(F.avg("traps_set").cast("int").cast("double").alias("m")).scalar()
    return v.select("survey_id", F.round(F.coalesce("traps_set", mean), 4).alias("effort"), F.col("traps_set").isNull().alias("was_filled"))


@R.add("""SELECT crop_type, crop_stage, ae_zone, count(mice) AS n_surveys, round(avg(mice), 6) AS mice_mean, CAST(sum(mice) AS DOUBLE) AS mice_sum FROM (SELECT crop_type, crop_stage, ae_zone, mice FROM data_long) GROUP BY ALL""")
def index_by_group(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "data_long", "crop_type", "crop_stage", "ae_zone", "mice")
    return t.groupBy("crop_type", "crop_stage", "ae_zone").agg(F.count("mice").alias("n_surveys"), F.round(F.avg("mice"), 6).alias("mice_mean"), F.sum("mice").alias("mice_sum"))


@R.add("""SELECT site, CAST(sum(mice_night) AS DOUBLE) > 0.001 * count(*) AS detected FROM (SELECT site, mice_night FROM data_monitoring_traps_clean WHERE mice_night IS NOT NULL) GROUP BY site""")
def detect_flag(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, TRAPS, "site", "mice_night").where("mice_night IS NOT NULL")
    return t.groupBy("site").agg((F.sum("mice_night") > 0.001 * F.count(F.lit(1))).alias("detected"))


QUERIES, SQL = R.queries, R.sql
