"""Queries on sessions, ordered operators, panels and reshaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrat.functions import calendar as cal
from quadrat.operators import clean, panel, sessions
from quadrat.plans.cleaning import ord_sql
from quadrat.plans.registry import Registry
from quadrat.plans.summaries import MONTHLY, monthly
from quadrat.sources.tables import table

R = Registry()
TRAPS, VISITS = "data_monitoring_traps_clean", "data_deduplicate_surveys_season"


@R.add("""SELECT event_id, a AS session_start, b AS session_end, CAST(b - a + 1 AS INTEGER) AS session_length, CAST(d - a + 1 AS INTEGER) AS night FROM (SELECT event_id, CAST(ts AS DATE) AS d, min(CAST(ts AS DATE)) OVER (PARTITION BY user_id, event_type) AS a, max(CAST(ts AS DATE)) OVER (PARTITION BY user_id, event_type) AS b FROM events)""")
def session_bounds(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "event_id", "user_id", "event_type", F.col("ts").cast("date").alias("day"))
    return sessions.session_bounds(e, ["user_id", "event_type"], "day").select("event_id", "session_start", "session_end", "session_length", "night")


@R.add("""SELECT record_id, CASE WHEN session_start_date IS NOT NULL THEN CAST(dense_rank() OVER (PARTITION BY site_data_id, session_start_date IS NULL ORDER BY session_start_date) AS INTEGER) END AS session_no FROM data_monitoring_traps_clean""")
def session_renumber(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, TRAPS, "record_id", "site_data_id", "session_start_date")
    return sessions.renumber(t, ["site_data_id"], "session_start_date", "session_no").select("record_id", "session_no")


@R.add("""SELECT record_id, count(*) FILTER (mice_night > 0) OVER w AS n_caught, count(*) FILTER (crop_stage = 'ripe') OVER w AS n_ripe, count(*) OVER w AS n_total FROM data_monitoring_traps_clean WINDOW w AS (PARTITION BY site_data_id, session)""")
def session_summary(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, TRAPS, "record_id", "site_data_id", "session", "mice_night", "crop_stage")
    out = sessions.session_summary(t, ["site_data_id", "session"], {"n_caught": F.col("mice_night") > 0, "n_ripe": F.col("crop_stage") == "ripe", "n_total": F.lit(True)})
    return out.select("record_id", "n_caught", "n_ripe", "n_total")


@R.add("""WITH e AS (SELECT DISTINCT site_data_id, session, date, trap_type, traps_set FROM data_monitoring_traps_clean) SELECT site_data_id, session, date, trap_type, traps_set, CASE WHEN count(traps_set) OVER w = count(*) OVER w THEN sum(traps_set) OVER w END AS session_effort FROM e WINDOW w AS (PARTITION BY site_data_id, session)""")
def session_effort(spark: SparkSession, d: str) -> DataFrame:
    from quadrat.functions.nullsafe import join_ns, strict_sum

    e = table(spark, d, TRAPS, "site_data_id", "session", "date", "trap_type", "traps_set").distinct()
    return join_ns(e, e.groupBy("site_data_id", "session").agg(strict_sum(F.col("traps_set")).alias("session_effort")), ["site_data_id", "session"], "left")


_NIGHTS = f"""n AS (SELECT o_custkey AS site, {ord_sql("o_orderdate")} AS season_ord, CAST(o_orderdate AS DATE) AS session, l_linenumber AS night, l_partkey, l_suppkey, o_orderkey, l_quantity AS effort, CASE WHEN l_discount > 0.05 THEN l_quantity END AS success, l_returnflag AS crop FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"""


def _nights(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    li = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_returnflag")
    j = o.join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    return j.select(F.col("o_custkey").alias("site"), cal.season_ord(F.col("o_orderdate")).alias("season_ord"), F.col("o_orderdate").cast("date").alias("session"), F.col("l_linenumber").alias("night"), "l_partkey", "l_suppkey", "o_orderkey", F.col("l_quantity").alias("effort"), F.when(F.col("l_discount") > 0.05, F.col("l_quantity")).alias("success"), F.col("l_returnflag").alias("crop"))


@R.add(f"""WITH {_NIGHTS}, s AS (SELECT site, season_ord, session, max(night) AS m FROM n GROUP BY ALL), o AS (SELECT site, season_ord, session, coalesce(sum(m) OVER (PARTITION BY site, season_ord ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM s)
  SELECT o_orderkey, l_partkey, l_suppkey, CAST(night + off AS INTEGER) AS night FROM n JOIN o USING (site, season_ord, session)""")
def chain_nights(spark: SparkSession, d: str) -> DataFrame:
    return sessions.chain_nights(_nights(spark, d), ["site", "season_ord"], "session", "night").select("o_orderkey", "l_partkey", "l_suppkey", "night")


_PICK = "SELECT site, season_ord, session FROM (SELECT site, season_ord, session, sum(effort) AS e, sum(success) AS s FROM n GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY site, season_ord ORDER BY {o}, session) = 1"


@R.add(f"WITH {_NIGHTS} " + _PICK.format(o="e DESC NULLS LAST, s DESC NULLS LAST"))
def best_by_effort(spark: SparkSession, d: str) -> DataFrame:
    return sessions.best_session(_nights(spark, d), ["site", "season_ord"], "session", "effort", "success")


@R.add(f"WITH {_NIGHTS} " + _PICK.format(o="CASE WHEN e > 0 THEN s / e END DESC NULLS LAST"))
def best_by_rate(spark: SparkSession, d: str) -> DataFrame:
    return sessions.best_session(_nights(spark, d), ["site", "season_ord"], "session", "effort", "success", "highest_capture")


@R.add(f"WITH {_NIGHTS} " + _PICK.format(o="md5(concat_ws('|', site, season_ord, session, '7'))"))
def hash_pick(spark: SparkSession, d: str) -> DataFrame:
    return sessions.best_session(_nights(spark, d), ["site", "season_ord"], "session", "effort", "success", "random", "7")


def _resolved_sql(chain: str, order: str) -> str:
    return f"""WITH {_NIGHTS}, r AS (SELECT * REPLACE (CASE WHEN crop = 'N' AND night = 1 THEN NULL ELSE session END AS session) FROM n), f AS (SELECT * FROM r WHERE session IS NOT NULL),
  k AS (SELECT site, season_ord, count(DISTINCT session) = 1 OR {chain} AS chain FROM f GROUP BY ALL),
  s AS (SELECT site, season_ord, session, max(night) AS m, sum(effort) AS e, sum(success) AS su FROM f GROUP BY ALL),
  o AS (SELECT site, season_ord, session, coalesce(sum(m) OVER (PARTITION BY site, season_ord ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off, row_number() OVER (PARTITION BY site, season_ord ORDER BY {order}, session) AS rn FROM s)
  SELECT f.site, f.season_ord, f.session, CAST(CASE WHEN chain THEN night + off ELSE night END AS INTEGER) AS night, f.effort FROM f JOIN k USING (site, season_ord) JOIN o USING (site, season_ord, session) WHERE chain OR rn = 1
  UNION ALL SELECT DISTINCT site, season_ord, CAST(NULL AS DATE), 1, CAST(NULL AS DOUBLE) FROM r WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.site = r.site AND f.season_ord = r.season_ord)"""


def _with_empty(spark: SparkSession, d: str) -> DataFrame:
    n = _nights(spark, d)
    return n.withColumn("session", F.when((F.col("crop") == "N") & (F.col("night") == 1), None).otherwise(F.col("session")))


def _resolved(df: DataFrame, **options: object) -> DataFrame:
    out = sessions.resolve_repeats(df, ["site", "season_ord"], "session", "night", "effort", "success", crop="crop", **options)
    return out.select("site", "season_ord", "session", "night", F.when(F.col("session").isNotNull(), F.col("effort")).alias("effort"))


@R.add(_resolved_sql("count(DISTINCT crop) + max(CASE WHEN crop IS NULL THEN 1 ELSE 0 END) = 1", "e DESC NULLS LAST, su DESC NULLS LAST"))
def resolve_repeats(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(_with_empty(spark, d), same_crop=True)


@R.add(_resolved_sql("true", "e"))
def resolve_repeats_combined(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(_with_empty(spark, d))


@R.add(_resolved_sql("false", "CASE WHEN e > 0 THEN su / e END DESC NULLS LAST"))
def resolve_repeats_best_rate(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(_with_empty(spark, d), combine=False, method="highest_capture")


@R.add(f"""SELECT o_custkey, season_ord, session, o_orderpriority, n_sessions FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey, season_ord) AS n_sessions FROM (SELECT DISTINCT o_custkey, {ord_sql("o_orderdate")} AS season_ord, CAST(o_orderdate AS DATE) AS session, o_orderpriority FROM orders)) WHERE n_sessions > 1""")
def duplicate_sessions(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders", "o_custkey", "o_orderdate", "o_orderpriority").withColumns({"season_ord": cal.season_ord(F.col("o_orderdate")), "session": F.col("o_orderdate").cast("date")})
    return sessions.duplicate_sessions(o, ["o_custkey"], "season_ord", ["session", "o_orderpriority"])


@R.add("""SELECT record_id, survey_night, mice_night FROM data_monitoring_traps_clean QUALIFY row_number() OVER (PARTITION BY site_data_id, session ORDER BY mice_night DESC NULLS LAST, record_id) = 1""")
def peak_night(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, TRAPS, "record_id", "site_data_id", "session", "survey_night", "mice_night")
    key = F.struct(F.coalesce("mice_night", F.lit(-1.0)), -F.col("record_id"))
    best = t.groupBy("site_data_id", "session").agg(F.max_by(F.struct("record_id", "survey_night", "mice_night"), key).alias("b"))
    return best.select("b.*")


@R.add("""SELECT event_id, user_id, CAST(row_number() OVER w AS INTEGER) AS capture_no, row_number() OVER w = 1 AS is_first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def tag_history(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "event_id", "user_id", "ts")
    return sessions.first_and_rest(e, ["user_id"], [F.col("ts"), F.col("event_id")]).drop("ts")


@R.add("""SELECT user_id, count(*) AS n_captures, count(DISTINCT event_type) AS n_types, CAST(min(ts) AS DATE) AS first_day, CAST(max(ts) AS DATE) AS last_day, CAST(max(ts) AS DATE) - CAST(min(ts) AS DATE) AS span_days FROM events GROUP BY user_id""".replace("CAST(max(ts) AS DATE) - CAST(min(ts) AS DATE) AS span_days", "CAST(CAST(max(ts) AS DATE) - CAST(min(ts) AS DATE) AS INTEGER) AS span_days"))
def tag_profile(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "user_id", "event_type", "ts")
    a, b = F.min("ts").cast("date"), F.max("ts").cast("date")
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_captures"), F.count_distinct("event_type").alias("n_types"), a.alias("first_day"), b.alias("last_day"), F.datediff(b, a).alias("span_days"))


@R.add("""SELECT site_data_id, session_start_date, CAST(lead(session_start_date) OVER (PARTITION BY site_data_id ORDER BY session_start_date) - session_start_date AS INTEGER) AS days_to_next FROM (SELECT DISTINCT site_data_id, session_start_date FROM data_long)""")
def days_to_next(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "data_long", "site_data_id", "session_start_date").distinct()
    w = Window.partitionBy("site_data_id").orderBy("session_start_date")
    return s.withColumn("days_to_next", F.datediff(F.lead("session_start_date").over(w), "session_start_date"))


@R.add(f"""WITH {MONTHLY}, g AS (SELECT n_nationkey AS nation, CAST(unnest(generate_series(DATE '1995-01-01', DATE '2001-12-01', INTERVAL 1 MONTH)) AS DATE) AS month FROM nation)
  SELECT g.nation, g.month, m.total, {ord_sql("g.month")} AS season_ord FROM g LEFT JOIN m ON g.nation = m.nation AND g.month = m.month""")
def month_panel(spark: SparkSession, d: str) -> DataFrame:
    sites = table(spark, d, "nation", F.col("n_nationkey").alias("nation"))
    obs = monthly(spark, d).select("nation", "month", "total")
    return panel.month_panel(sites, obs, ["nation"], "month", "1995-01-01", "2001-12-01").withColumn("season_ord", cal.season_ord(F.col("month")))


@R.add("""SELECT site_data_id, CAST(unnest(generate_series(a, b + 1)) AS INTEGER) AS season_ord FROM (SELECT site_data_id, min(o) AS a, max(o) AS b FROM (SELECT site_data_id, CAST(right(season_year_adj, 4) AS INTEGER) * 4 + CASE left(season_year_adj, 2) WHEN 'Su' THEN 0 WHEN 'Au' THEN 1 WHEN 'Wi' THEN 2 ELSE 3 END AS o FROM data_long) GROUP BY 1)""")
def season_panel(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "data_long", "site_data_id", cal.parse_label(F.col("season_year_adj")).alias("season_ord"))
    return panel.season_panel(t, ["site_data_id"], "season_ord")


_LN = f"""n AS (SELECT site_data_id AS site, {ord_sql("date")} AS season_ord, survey_night AS night, CAST(sum(nullif(traps_night, 'NaN'::DOUBLE)) AS DOUBLE) AS effort FROM data_monitoring_traps_clean WHERE date BETWEEN DATE '2008-12-01' AND DATE '2025-11-30' GROUP BY ALL)"""


def _night_effort(spark: SparkSession, d: str) -> DataFrame:
    """(site, season_ord, night, effort) of all trap nights with a possible date."""
    t = table(spark, d, TRAPS, "site_data_id", "date", "survey_night", "traps_night").where("date BETWEEN DATE'2008-12-01' AND DATE'2025-11-30'")
    return t.groupBy(F.col("site_data_id").alias("site"), cal.season_ord(F.col("date")).alias("season_ord"), F.col("survey_night").alias("night")).agg(F.sum(F.nanvl("traps_night", F.lit(None).cast("double"))).alias("effort"))


@R.add(f"""WITH {_LN}, g AS (SELECT site, season_ord, CAST(unnest(generate_series(1, m)) AS INTEGER) AS night FROM (SELECT site, max(night) AS m FROM n GROUP BY 1 HAVING max(night) >= 1), (SELECT DISTINCT season_ord FROM n)) SELECT g.site, g.season_ord, g.night, n.effort FROM g LEFT JOIN n USING (site, season_ord, night)""")
def grid_complete(spark: SparkSession, d: str) -> DataFrame:
    return panel.complete_nights(_night_effort(spark, d), ["site"], "season_ord", "night")


@R.add(f"""WITH {_LN}, c AS (SELECT DISTINCT site, night FROM n), t AS (SELECT site, season_ord, min(effort) AS cov FROM n GROUP BY ALL) SELECT t.site, t.season_ord, t.cov, c.night, n.effort FROM t JOIN c USING (site) LEFT JOIN n ON n.site = t.site AND n.season_ord = t.season_ord AND n.night IS NOT DISTINCT FROM c.night""")
def survey_grid(spark: SparkSession, d: str) -> DataFrame:
    n = _night_effort(spark, d).withColumn("cov", F.col("effort"))
    return panel.survey_grid(n, ["site"], "season_ord", ["night"], ["effort"], ["cov"])


@R.add(f"""WITH {_LN}, y AS (SELECT DISTINCT CAST(season_ord % 4 AS INTEGER) AS season, CAST(season_ord // 4 AS INTEGER) AS year FROM n), g AS (SELECT site, season, year, CAST(unnest(generate_series(1, m)) AS INTEGER) AS night FROM (SELECT site, max(night) AS m FROM n GROUP BY 1 HAVING max(night) >= 1), y)
  SELECT g.site, g.season, g.year, g.night, n.effort FROM g LEFT JOIN n ON g.site = n.site AND g.night = n.night AND n.season_ord = g.year * 4 + g.season""")
def nested_grid(spark: SparkSession, d: str) -> DataFrame:
    """Every night at each pair of season and year that occurs, the pairs kept together."""
    n = _night_effort(spark, d).withColumn("at", F.struct(F.pmod("season_ord", F.lit(4)).alias("season"), cal.ord_year(F.col("season_ord")).alias("year"))).drop("season_ord")
    return panel.complete_nights(n, ["site"], "at", "night").select("site", "at.season", "at.year", "night", "effort")


@R.add("""WITH p AS (SELECT region, site, subsite, strftime(session_start_date, '%Y-%m') AS month, survey_id, traps_set, number_mice_caught FROM data_deduplicate_surveys_season)
  SELECT region, site, subsite, month, survey_id FROM p QUALIFY row_number() OVER (PARTITION BY region, site, subsite, month ORDER BY coalesce(traps_set, 0) DESC, coalesce(number_mice_caught, 0) DESC, survey_id) = 1""")
def one_survey_a_month(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, VISITS, "region", "site", "subsite", F.date_format("session_start_date", "yyyy-MM").alias("month"), "survey_id", "traps_set", "number_mice_caught")
    out = sessions.one_survey_a_month(v, "visits", "month", "survey_id", measures={"visits": (("traps_set",), ("number_mice_caught",))})
    return out.select("region", "site", "subsite", "month", "survey_id")


@R.add("""SELECT long_id, CAST(row_number() OVER (PARTITION BY series ORDER BY session_start_date, long_id) AS INTEGER) AS time FROM data_long""")
def series_time(spark: SparkSession, d: str) -> DataFrame:
    """Time as the number of the row in its series."""
    w = Window.partitionBy("series").orderBy("session_start_date", "long_id")
    return table(spark, d, "data_long", "long_id", "series", "session_start_date").select("long_id", F.row_number().over(w).alias("time"))


@R.add("""SELECT survey_id, CASE WHEN row_number() OVER (PARTITION BY region ORDER BY region, site, survey_id) = 1 THEN region END AS region_header, CASE WHEN row_number() OVER (PARTITION BY region, site ORDER BY region, site, survey_id) = 1 THEN site END AS site_header FROM data_deduplicate_surveys_season""")
def running_headers(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, VISITS, "survey_id", "region", "site")
    return panel.running_headers(v, ["region", "site"], ["region", "site", "survey_id"]).select("survey_id", "region_header", "site_header")


@R.add("""WITH a AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS i, o_orderkey FROM orders), b AS (SELECT row_number() OVER (ORDER BY c_custkey) AS i, c_custkey FROM customer) SELECT o_orderkey, c_custkey FROM a FULL JOIN b ON a.i = b.i""")
def bind_by_place(spark: SparkSession, d: str) -> DataFrame:
    return panel.bind_columns(table(spark, d, "orders", "o_orderkey"), table(spark, d, "customer", "c_custkey"), ["o_orderkey"], ["c_custkey"])


@R.add("""SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20""")
def top_rows(spark: SparkSession, d: str) -> DataFrame:
    """The head of an order: a report of the first 20."""
    return table(spark, d, "orders", "o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(20)


_HOLES = "(SELECT nation, month, CASE WHEN n % 3 = 0 THEN NULL ELSE total END AS total FROM m)"


def _holes(spark: SparkSession, d: str) -> DataFrame:
    return monthly(spark, d).select("nation", "month", F.when(F.col("n") % 3 == 0, None).otherwise(F.col("total")).alias("total"))


@R.add(f"""WITH {MONTHLY} SELECT nation, month, coalesce(last_value(total IGNORE NULLS) OVER (PARTITION BY nation ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(total IGNORE NULLS) OVER (PARTITION BY nation ORDER BY month ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS total FROM {_HOLES}""")
def fill_downup(spark: SparkSession, d: str) -> DataFrame:
    return panel.fill_downup(_holes(spark, d), ["nation"], [F.col("month")], ["total"])


@R.add(f"""WITH {MONTHLY} SELECT nation, month, coalesce(last_value(total IGNORE NULLS) OVER (ORDER BY nation, month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(total IGNORE NULLS) OVER (ORDER BY nation, month ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS total FROM {_HOLES}""")
def locf_global(spark: SparkSession, d: str) -> DataFrame:
    return panel.locf(_holes(spark, d), ["nation", "month"], ["total"])


@R.add(f"""WITH {MONTHLY}, s AS (SELECT nation, season_ord, round(sum(total), 2) AS total FROM m GROUP BY ALL) SELECT nation, season_ord, {", ".join(f"lag(total, {k}) OVER w AS total_lag{k}" for k in range(1, 9))}, total FROM s WINDOW w AS (PARTITION BY nation ORDER BY season_ord)""")
def seasonal_lags(spark: SparkSession, d: str) -> DataFrame:
    return panel.lags(_seasonal(spark, d), ["nation"], "season_ord", ["total"], 8)


def _seasonal(spark: SparkSession, d: str) -> DataFrame:
    return monthly(spark, d).groupBy("nation", "season_ord").agg(F.round(F.sum("total"), 2).alias("total"))


@R.add(f"""WITH {MONTHLY}, s AS (SELECT nation, season_ord, round(sum(total), 2) AS total FROM m GROUP BY ALL), r AS (SELECT nation, season_ord, CASE WHEN count(total) OVER w4 = 4 THEN sum(total) OVER w4 END AS s4, CASE WHEN count(total) OVER w8 = 8 THEN sum(total) OVER w8 END AS s8 FROM s
  WINDOW w4 AS (PARTITION BY nation ORDER BY season_ord ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), w8 AS (PARTITION BY nation ORDER BY season_ord ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)) SELECT nation, season_ord, round(s4, 2) AS year1, round(s8 - s4, 2) AS year2 FROM r""")
def rolling_year_pair(spark: SparkSession, d: str) -> DataFrame:
    s4, s8 = (panel.rolling_sum(F.col("total"), ["nation"], "season_ord", n) for n in (4, 8))
    return _seasonal(spark, d).select("nation", "season_ord", F.round(s4, 2).alias("year1"), F.round(s8 - s4, 2).alias("year2"))


@R.add(f"""WITH {MONTHLY}, s AS (SELECT nation, season_ord, round(sum(total), 2) AS total FROM m GROUP BY ALL), l AS (SELECT nation, season_ord, total AS l0, lag(total, 1) OVER w AS l1, lag(total, 2) OVER w AS l2, row_number() OVER w AS r FROM s WINDOW w AS (PARTITION BY nation ORDER BY season_ord))
  SELECT nation, season_ord, unnest([0, 1, 2]) AS lag_no, unnest([l0, l1, l2]) AS total FROM l WHERE r >= 3""")
def lag_array(spark: SparkSession, d: str) -> DataFrame:
    a = panel.lag_array(_seasonal(spark, d), ["nation"], "season_ord", "total", 3, "lagged")
    return a.select("nation", "season_ord", F.posexplode("lagged").alias("lag_no", "total"))


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@R.add("""SELECT o_orderkey, CAST(o_orderpriority = '1-URGENT' AS INTEGER) AS w_1_urgent, CAST(o_orderpriority = '2-HIGH' AS INTEGER) AS w_2_high, CAST(o_orderpriority = '3-MEDIUM' AS INTEGER) AS w_3_medium, CAST(o_orderpriority = '4-NOT SPECIFIED' AS INTEGER) AS w_4_not_specified, CAST(o_orderpriority = '5-LOW' AS INTEGER) AS w_5_low FROM orders""")
def one_hot_levels(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders", "o_orderkey", "o_orderpriority")
    cols = panel.one_hot(F.col("o_orderpriority"), _PRIORITIES, "w")
    return o.select("o_orderkey", *[c.alias(n) for n, c in cols.items()])


@R.add(f"""SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY {ord_sql("o_orderdate")}) AS INTEGER) AS time FROM orders""")
def time_index(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders", "o_orderkey", cal.season_ord(F.col("o_orderdate")).alias("s"))
    return panel.time_index(o, "s").select("o_orderkey", "time")


@R.add(f"""SELECT o_orderkey, CASE WHEN {ord_sql("o_orderdate")} <= 1999 * 4 THEN 'train' ELSE 'test' END AS part FROM orders""")
def train_test_split(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders", "o_orderkey", cal.season_ord(F.col("o_orderdate")).alias("s"))
    return panel.split_at(o, "s", 1999 * 4).drop("s")


@R.add("""WITH g AS (SELECT series, count(DISTINCT season_year_adj) AS n_times FROM data_long GROUP BY series) SELECT series, n_times, n_times = (SELECT max(n_times) FROM g) AS is_complete FROM g""")
def equal_series_check(spark: SparkSession, d: str) -> DataFrame:
    return panel.equal_length(table(spark, d, "data_long", "series", "season_year_adj"), "series", "season_year_adj")


_WIDE_SQL = ", ".join(f'min(l_quantity) FILTER (l_linenumber = {i}) AS "{i}"' for i in range(1, 8))


@R.add(f"SELECT l_orderkey, {_WIDE_SQL} FROM lineitem GROUP BY l_orderkey")
def pivot_nights(spark: SparkSession, d: str) -> DataFrame:
    return clean.wide_measures(table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity"), ["l_orderkey"], "l_linenumber", "l_quantity", [str(i) for i in range(1, 8)])


@R.add("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, unnest(['l_quantity', 'l_discount', 'l_tax']) AS measure, unnest([l_quantity, l_discount, l_tax]) AS value FROM lineitem""")
def unpivot_measures(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax")
    return li.unpivot(["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], ["l_quantity", "l_discount", "l_tax"], "measure", "value")


@R.add(f"""WITH {MONTHLY}, l AS (SELECT nation, season_ord, row_number() OVER (PARTITION BY nation ORDER BY season_ord) AS r FROM (SELECT DISTINCT nation, season_ord FROM m)) SELECT m.nation, m.month, m.season_ord FROM m SEMI JOIN (SELECT nation, season_ord FROM l WHERE r >= 4) k ON k.nation = m.nation AND k.season_ord = m.season_ord""")
def align_to_lags(spark: SparkSession, d: str) -> DataFrame:
    m = monthly(spark, d).select("nation", "month", "season_ord")
    kept = panel.lag_array(_seasonal(spark, d), ["nation"], "season_ord", "total", 4, "lagged").select("nation", "season_ord")
    return m.join(kept, ["nation", "season_ord"], "left_semi")


@R.add("""WITH g AS (SELECT ae_zone, site_data_id FROM data_long GROUP BY ALL HAVING count(DISTINCT CASE WHEN mice IS NOT NULL THEN season_year_adj END) >= 3 AND NOT coalesce(bool_or(crop_type = 'rice'), false))
  SELECT ae_zone, site_data_id FROM g QUALIFY row_number() OVER (PARTITION BY ae_zone ORDER BY md5(coalesce(ae_zone, 'NA') || '|' || site_data_id || '|3'), site_data_id) = 1""")
def hold_out_sites(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "data_long", "ae_zone", "site_data_id", "crop_type", F.when(F.col("mice").isNotNull(), F.col("season_year_adj")).alias("seen"))
    return sessions.hold_out(t, ["ae_zone"], "site_data_id", "seen", 3, F.col("crop_type") == "rice", "3")


@R.add("""SELECT series, max(t) AS last_time FROM (SELECT series, CAST(right(season_year_adj, 4) AS INTEGER) * 4 + CASE left(season_year_adj, 2) WHEN 'Su' THEN 0 WHEN 'Au' THEN 1 WHEN 'Wi' THEN 2 ELSE 3 END AS t FROM data_long) GROUP BY series HAVING max(t) < 8080""")
def short_series(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "data_long", "series", cal.parse_label(F.col("season_year_adj")).alias("t"))
    return t.groupBy("series").agg(F.max("t").alias("last_time")).where("last_time < 8080")


QUERIES, SQL = R.queries, R.sql
