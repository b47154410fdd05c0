"""Queries on sorting, scalar functions, monthly selection, layers and slices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.functions import calendar as cal
from quadrat.operators import aggregates as agg
from quadrat.operators import quality, sessions
from quadrat.plans.cleaning import ord_sql
from quadrat.plans.registry import Registry
from quadrat.plans.summaries import MONTHLY, monthly
from quadrat.sources.tables import table

R = Registry()
TRAPS, VISITS = "data_monitoring_traps_clean", "data_deduplicate_surveys_season"


@R.add("""SELECT survey_id, CAST(row_number() OVER (PARTITION BY region ORDER BY traps_set ASC NULLS LAST, number_mice_caught DESC NULLS LAST, survey_id) AS INTEGER) AS place FROM data_deduplicate_surveys_season""")
def arrange_rank(spark: SparkSession, d: str) -> DataFrame:
    """Place of each row in an order with nulls last."""
    v = table(spark, d, VISITS, "survey_id", "region", "traps_set", "number_mice_caught")
    return agg.ranked(v, ["region"], [F.col("traps_set").asc_nulls_last(), F.col("number_mice_caught").desc_nulls_last(), F.col("survey_id")]).select("survey_id", "place")


@R.add("""SELECT c_nationkey AS nation, strftime(session, '%Y-%m') AS month, session FROM (SELECT c_nationkey, CAST(o_orderdate AS DATE) AS session, sum(o_totalprice) AS e, count(*) AS s FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY nation, month ORDER BY round(e, 2) DESC NULLS LAST, s DESC NULLS LAST, session) = 1""")
def month_best_session(spark: SparkSession, d: str) -> DataFrame:
    """The best session of each nation and month."""
    o = table(spark, d, "orders", "o_custkey", "o_orderdate", "o_totalprice").join(table(spark, d, "customer", "c_custkey", F.col("c_nationkey").alias("nation")), F.col("o_custkey") == F.col("c_custkey"))
    s = o.groupBy("nation", F.col("o_orderdate").cast("date").alias("session")).agg(F.round(F.sum("o_totalprice"), 2).alias("effort"), F.count(F.lit(1)).alias("success"))
    s = s.withColumn("month", F.date_format("session", "yyyy-MM"))
    return sessions.best_session(s, ["nation", "month"], "session", "effort", "success").select("nation", "month", "session")


@R.add(f"""WITH t AS (SELECT DISTINCT {ord_sql("date")} AS o FROM counts_grids_mallee WHERE date BETWEEN DATE '2008-12-01' AND DATE '2025-11-30') SELECT {ord_sql("v.session_start_date")} AS season_ord, count(*) AS n_visits FROM data_deduplicate_surveys_season v SEMI JOIN t ON {ord_sql("v.session_start_date")} = t.o GROUP BY 1""")
def season_slices(spark: SparkSession, d: str) -> DataFrame:
    """Visits of each season that the grid counts span."""
    t = table(spark, d, "counts_grids_mallee", "date").where("date BETWEEN DATE'2008-12-01' AND DATE'2025-11-30'").select(cal.season_ord(F.col("date")).alias("season_ord")).distinct()
    v = table(spark, d, VISITS, cal.season_ord(F.col("session_start_date")).alias("season_ord"))
    return v.join(t, "season_ord", "left_semi").groupBy("season_ord").agg(F.count(F.lit(1)).alias("n_visits"))


@R.add("""SELECT site_data_id, upper(substr(subsite, 1, 1)) || substr(subsite, 2) AS title, coalesce(farmer, 'NA') || '_' || site AS pasted, regexp_replace(subsite, '[0-9]+', '#', 'g') AS masked, regexp_extract(subsite, '([0-9]+)$', 1) AS number, coalesce(regexp_matches(farmer, '(?i)^H '), false) AS starts_h, split_part(subsite, ' ', 2) AS kind, lpad(CAST(site_data_id AS VARCHAR), 8, '0') AS code, upper(split_part(site, ' ', 1)) AS shout FROM site_data""")
def string_functions(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "site_data", "site_data_id", "farmer", "site", "subsite")
    return s.select(
        "site_data_id", F.concat(F.upper(F.substring("subsite", 1, 1)), F.expr("substring(subsite, 2)")).alias("title"), F.concat(F.coalesce("farmer", F.lit("NA")), F.lit("_"), "site").alias("pasted"),
        F.regexp_replace("subsite", "[0-9]+", "#").alias("masked"), F.regexp_extract("subsite", "([0-9]+)$", 1).alias("number"), F.coalesce(F.col("farmer").rlike("(?i)^H "), F.lit(False)).alias("starts_h"),
        F.split_part("subsite", F.lit(" "), F.lit(2)).alias("kind"), F.format_string("%08d", "site_data_id").alias("code"), F.upper(F.split_part("site", F.lit(" "), F.lit(1))).alias("shout"),
    )


@R.add("""SELECT record_id, session_start_date + CAST(floor((session_end_date - session_start_date) / 2) AS INTEGER) AS midpoint, CAST(session_end_date - session_start_date AS INTEGER) AS days, session_start_date - 30 AS month_before, strftime(session_start_date, '%Y-%m') AS ym, coalesce(session_start_date + 3 > date, false) AS early FROM data_monitoring_traps_clean""")
def date_functions(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, TRAPS, "record_id", "session_start_date", "session_end_date", "date")
    days = F.datediff("session_end_date", "session_start_date")
    return t.select("record_id", F.date_add("session_start_date", F.floor(days / 2).cast("int")).alias("midpoint"), days.alias("days"), F.date_sub("session_start_date", 30).alias("month_before"), F.date_format("session_start_date", "yyyy-MM").alias("ym"), F.coalesce(F.date_add("session_start_date", 3) > F.col("date"), F.lit(False)).alias("early"))


@R.add("""WITH y AS (SELECT year(session_start_date) AS y, count(*) AS n FROM data_deduplicate_surveys_season GROUP BY 1 ORDER BY n DESC, y LIMIT 1) SELECT survey_id, session_start_date FROM data_deduplicate_surveys_season WHERE year(session_start_date) <> (SELECT y FROM y)""")
def dominant_year_check(spark: SparkSession, d: str) -> DataFrame:
    """Rows of another year than the commonest."""
    v = table(spark, d, VISITS, "survey_id", "session_start_date")
    year = agg.mode_of(v, [F.year("session_start_date")], "y").select("y").scalar()
    return v.where(F.year("session_start_date") != year)


@R.add(f"""WITH {MONTHLY}, a AS (SELECT nation, month, total FROM m), b AS (SELECT nation, month, n FROM m WHERE n > 2) SELECT nation, count(*) AS n_layers, count(*) FILTER (b.month IS NOT NULL) AS n_aligned, count(*) - count(*) FILTER (b.month IS NOT NULL) > 14 AS too_far_apart FROM a LEFT JOIN b USING (nation, month) GROUP BY nation""")
def layer_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Two stacks of layers joined by date, and whether they differ by more than 14 layers."""
    m = monthly(spark, d)
    j = m.select("nation", "month").join(m.where("n > 2").select("nation", "month", F.lit(True).alias("b")), ["nation", "month"], "left")
    return j.groupBy("nation").agg(F.count(F.lit(1)).alias("n_layers"), F.count("b").alias("n_aligned"), (F.count(F.lit(1)) - F.count("b") > 14).alias("too_far_apart"))


@R.add(f"""SELECT ae_zone, CAST(right(season_year_adj, 4) AS INTEGER) * 4 + CASE left(season_year_adj, 2) WHEN 'Su' THEN 0 WHEN 'Au' THEN 1 WHEN 'Wi' THEN 2 ELSE 3 END AS season_ord, round(avg(mice / nullif(traps, 0)), 6) AS observed FROM data_long WHERE traps BETWEEN 0 AND 100 GROUP BY ALL""")
def observed_means(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "data_long", "ae_zone", cal.parse_label(F.col("season_year_adj")).alias("season_ord"), "mice", "traps").where("traps BETWEEN 0 AND 100")
    return agg.mean_ratio(t, ["ae_zone", "season_ord"], "mice", "traps", "observed")


@R.add("""WITH z AS (SELECT ae_zone, count(DISTINCT site_data_id) AS n_sites, count(mice) AS n_surveys, round(100.0::DOUBLE * count(*) FILTER (mice > 0) / nullif(count(mice), 0), 4) AS pct_detected FROM data_long GROUP BY 1) SELECT *, CASE WHEN pct_detected IS NULL THEN 'No data' WHEN pct_detected <= 5 THEN 'Low' WHEN pct_detected <= 25 THEN 'Moderate' ELSE 'High' END AS level FROM z""")
def zone_report(spark: SparkSession, d: str) -> DataFrame:
    return agg.area_report(table(spark, d, "data_long", "ae_zone", "site_data_id", "mice"), "ae_zone", "site_data_id", "mice", 5, 25)


_WIDE = ("l_quantity", "l_tax", "l_discount", "l_linenumber")


@R.add("""SELECT 'range_' || c AS rule_id, 'error' AS severity, count(*) AS n_checked, count(*) FILTER (NOT v BETWEEN 0 AND 49) AS n_broken, count(*) FILTER (NOT v BETWEEN 0 AND 49) = 0 AS passed FROM (SELECT unnest(['l_quantity', 'l_tax', 'l_discount', 'l_linenumber']) AS c, unnest([l_quantity, l_tax, l_discount, CAST(l_linenumber AS DOUBLE)]) AS v FROM lineitem) GROUP BY 1""")
def percent_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Range rules over several repeated-measure columns in one pass."""
    return quality.summary(table(spark, d, "lineitem", *_WIDE), [quality.within(c, 0, 49) for c in _WIDE])


QUERIES, SQL = R.queries, R.sql
