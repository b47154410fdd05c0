"""Queries on joins and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.functions import calendar as cal
from quadrat.functions.nullsafe import join_ns
from quadrat.operators import joins
from quadrat.plans.cleaning import ord_sql
from quadrat.plans.registry import Registry
from quadrat.sources.tables import table

R = Registry()
TRAPS, VISITS = "data_monitoring_traps_clean", "data_deduplicate_surveys_season"


@R.add("""SELECT o_orderkey, c_name, n_name, r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def star_join(spark: SparkSession, d: str) -> DataFrame:
    dims = [(table(spark, d, "customer", "c_custkey", "c_name", "c_nationkey"), "o_custkey", "c_custkey"), (table(spark, d, "nation"), "c_nationkey", "n_nationkey"), (table(spark, d, "region"), "n_regionkey", "r_regionkey")]
    return joins.star(table(spark, d, "orders", "o_orderkey", "o_custkey"), dims).select("o_orderkey", "c_name", "n_name", "r_name")


@R.add("""SELECT t.record_id, t.crop_type, v.crop_type AS crop_type_1, v.ae_zone FROM data_monitoring_traps_clean t LEFT JOIN (SELECT site_data_id, min(crop_type) AS crop_type, min(ae_zone) AS ae_zone FROM data_long GROUP BY 1) v USING (site_data_id)""")
def star_clashing(spark: SparkSession, d: str) -> DataFrame:
    dim = table(spark, d, "data_long").groupBy("site_data_id").agg(F.min("crop_type").alias("crop_type"), F.min("ae_zone").alias("ae_zone"))
    return joins.star(table(spark, d, TRAPS, "record_id", "site_data_id", "crop_type"), [(dim, "site_data_id", "site_data_id")]).drop("site_data_id")


@R.add("""SELECT c.count_id, t.record_id FROM counts_grids_mallee c LEFT JOIN data_monitoring_traps_clean t ON c.site_data_id = t.site_data_id AND c.date IS NOT DISTINCT FROM t.date AND c.traps_set IS NOT DISTINCT FROM t.traps_set""")
def many_to_many_join(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "counts_grids_mallee", "count_id", "site_data_id", "date", "traps_set")
    t = table(spark, d, TRAPS, "record_id", "site_data_id", "date", "traps_set")
    return join_ns(c, t, ["site_data_id", "date", "traps_set"], "left").select("count_id", "record_id")


@R.add("""SELECT s.site_data_id, e.soil_type FROM site_data s LEFT JOIN data_list_ae_exp_rain_soil e ON s.longitude IS NOT DISTINCT FROM e.longitude AND s.latitude IS NOT DISTINCT FROM e.latitude AND s.site_data_id = e.site_data_id""")
def coordinate_key_join(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "site_data", "site_data_id", "longitude", "latitude")
    e = table(spark, d, "data_list_ae_exp_rain_soil", "site_data_id", "longitude", "latitude", "soil_type")
    return join_ns(s, e, ["longitude", "latitude", "site_data_id"], "left").select("site_data_id", "soil_type")


_FARMER = "SELECT site, farmer, count(*) AS {n} FROM {t} GROUP BY ALL"


@R.add("""WITH a AS (SELECT site, farmer, count(*) AS n_nights FROM data_monitoring_traps_clean GROUP BY ALL), b AS (SELECT site, farmer, count(*) AS n_paddocks FROM site_data GROUP BY ALL)
  SELECT a.site, a.farmer, n_nights, n_paddocks FROM a JOIN b ON a.site IS NOT DISTINCT FROM b.site AND a.farmer IS NOT DISTINCT FROM b.farmer""")
def null_safe_join(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, TRAPS, "site", "farmer").groupBy("site", "farmer").agg(F.count(F.lit(1)).alias("n_nights"))
    b = table(spark, d, "site_data", "site", "farmer").groupBy("site", "farmer").agg(F.count(F.lit(1)).alias("n_paddocks"))
    return join_ns(a, b, ["site", "farmer"])


@R.add("""WITH a AS (SELECT region, farmer, count(*) AS n_nights FROM data_monitoring_traps_clean GROUP BY ALL), b AS (SELECT lower(region) AS region, farmer, count(*) AS n_visits FROM data_deduplicate_surveys_season GROUP BY ALL), c AS (SELECT region, farmer, count(*) AS n_paddocks FROM site_data GROUP BY ALL)
  , ab AS (SELECT CASE WHEN a.n_nights IS NOT NULL THEN a.region ELSE b.region END AS region, CASE WHEN a.n_nights IS NOT NULL THEN a.farmer ELSE b.farmer END AS farmer, n_nights, n_visits FROM a FULL JOIN b ON a.region IS NOT DISTINCT FROM b.region AND a.farmer IS NOT DISTINCT FROM b.farmer)
  SELECT coalesce(ab.region, c.region) AS region, CASE WHEN ab.region IS NOT NULL THEN ab.farmer ELSE c.farmer END AS farmer, n_nights, n_visits, n_paddocks FROM ab FULL JOIN c ON ab.region IS NOT DISTINCT FROM c.region AND ab.farmer IS NOT DISTINCT FROM c.farmer""")
def full_outer_methods(spark: SparkSession, d: str) -> DataFrame:
    n = lambda t, name, r="region": table(spark, d, t, F.lower("region").alias("region") if r else "region", "farmer").groupBy("region", "farmer").agg(F.count(F.lit(1)).alias(name))
    return joins.full_outer_all([n(TRAPS, "n_nights", ""), n(VISITS, "n_visits"), n("site_data", "n_paddocks", "")], ["region", "farmer"])


@R.add("""SELECT 'semi' AS kind, site_data_id FROM site_data s WHERE EXISTS (SELECT 1 FROM counts_grids_mallee c WHERE c.site_data_id = s.site_data_id) UNION ALL SELECT 'anti', site_data_id FROM site_data s WHERE NOT EXISTS (SELECT 1 FROM counts_grids_mallee c WHERE c.site_data_id = s.site_data_id)""")
def semi_anti_join(spark: SparkSession, d: str) -> DataFrame:
    s, c = table(spark, d, "site_data", "site_data_id"), table(spark, d, "counts_grids_mallee", "site_data_id")
    semi, anti = (s.join(c, "site_data_id", how).select(F.lit(how[5:]).alias("kind"), "site_data_id") for how in ("left_semi", "left_anti"))
    return semi.unionByName(anti)


@R.add("""SELECT t.record_id, min(s.ae_zone) AS ae_zone FROM data_monitoring_traps_clean t JOIN data_list_ae_exp_rain_soil s USING (site_data_id) WHERE t.crop_stage = 'ripe' AND s.soil_type = 'sodosol' GROUP BY 1""")
def inner_join(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, TRAPS, "record_id", "site_data_id", "crop_stage").where("crop_stage = 'ripe'")
    s = table(spark, d, "data_list_ae_exp_rain_soil", "site_data_id", "soil_type", "ae_zone").where("soil_type = 'sodosol'")
    return t.join(s, "site_data_id").groupBy("record_id").agg(F.min("ae_zone").alias("ae_zone"))


@R.add("""SELECT n_nationkey, CAST(y AS INTEGER) AS year FROM (SELECT n_nationkey, unnest(generate_series(1995, 2001)) AS y FROM nation)""")
def calendar_grid(spark: SparkSession, d: str) -> DataFrame:
    return joins.expand_steps(table(spark, d, "nation", "n_nationkey"), F.lit(1995), F.lit(2001), "year")


@R.add("""SELECT record_id, site_data_id, first_value(crop_type) OVER w AS crop_type, first_value(crop_stage) OVER w AS crop_stage FROM data_monitoring_traps_clean WINDOW w AS (PARTITION BY site_data_id, session ORDER BY record_id)""")
def group_representative(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, TRAPS, "record_id", "site_data_id", "session", "crop_type", "crop_stage")
    return joins.representative(t, ["site_data_id", "session"], "record_id", ["crop_type", "crop_stage"]).drop("session")


@R.add("""SELECT record_id, survey_night, max(survey_night) OVER (PARTITION BY site_data_id, session) AS max_night FROM data_monitoring_traps_clean""")
def join_group_max(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, TRAPS, "record_id", "site_data_id", "session", "survey_night")
    m = t.groupBy("site_data_id", "session").agg(F.max("survey_night").alias("max_night"))
    return join_ns(t, m, ["site_data_id", "session"], "left").select("record_id", "survey_night", "max_night")


@R.add("""SELECT v.site_data_id, v.data_source, v.region, v.town, v.farmer, v.site, v.subsite, v.longitude, v.latitude, s.soil_type FROM site_data v LEFT JOIN (SELECT site_data_id, longitude, latitude, soil_type FROM data_list_ae_exp_rain_soil) s ON v.site_data_id = s.site_data_id AND v.longitude IS NOT DISTINCT FROM s.longitude AND v.latitude IS NOT DISTINCT FROM s.latitude""")
def natural_join(spark: SparkSession, d: str) -> DataFrame:
    return joins.natural(table(spark, d, "site_data"), table(spark, d, "data_list_ae_exp_rain_soil", "site_data_id", "longitude", "latitude", "soil_type"))


@R.add("""SELECT o_orderkey, o_custkey, l_partkey, l_quantity FROM orders LEFT JOIN (SELECT l_orderkey, l_partkey, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) = 1) ON o_orderkey = l_orderkey""")
def first_match_lookup(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem", F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_quantity", F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("o"))
    return joins.first_match(table(spark, d, "orders", "o_orderkey", "o_custkey"), li, "o_orderkey", "o", ["l_partkey", "l_quantity"])


@R.add("""SELECT 'traps' AS method, site_data_id, date, mice_night, NULL AS grid_or_trapline FROM (SELECT site_data_id, date, mice_night FROM data_monitoring_traps_clean) UNION ALL SELECT 'grids', site_data_id, date, mice_night, grid_or_trapline FROM counts_grids_mallee""")
def bind_rows(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, TRAPS, "site_data_id", "date", "mice_night").withColumn("method", F.lit("traps"))
    b = table(spark, d, "counts_grids_mallee", "site_data_id", "date", "mice_night", "grid_or_trapline").withColumn("method", F.lit("grids"))
    return a.unionByName(b, allowMissingColumns=True)


@R.add("""SELECT DISTINCT region, site, farmer FROM data_monitoring_traps_clean""")
def distinct_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, TRAPS, "region", "site", "farmer").distinct()


@R.add("""SELECT 'union' AS op, site_data_id FROM (SELECT site_data_id FROM counts_grids_mallee UNION SELECT site_data_id FROM data_long) UNION ALL SELECT 'except', site_data_id FROM (SELECT site_data_id FROM data_long EXCEPT SELECT site_data_id FROM counts_grids_mallee) UNION ALL SELECT 'intersect', site_data_id FROM (SELECT site_data_id FROM data_long INTERSECT SELECT site_data_id FROM counts_grids_mallee)""")
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    a, b = table(spark, d, "counts_grids_mallee", "site_data_id"), table(spark, d, "data_long", "site_data_id")
    parts = (("union", a.union(b).distinct()), ("except", b.subtract(a)), ("intersect", b.intersect(a)))
    out = None
    for name, df in parts:
        x = df.select(F.lit(name).alias("op"), "site_data_id")
        out = x if out is None else out.unionByName(x)
    return out


@R.add(f"""SELECT label FROM (SELECT DISTINCT {ord_sql("o_orderdate")} AS o, CASE WHEN month(o_orderdate) IN (12,1,2) THEN 'Summer' WHEN month(o_orderdate) <= 5 THEN 'Autumn' WHEN month(o_orderdate) <= 8 THEN 'Winter' ELSE 'Spring' END || '-' || ({ord_sql("o_orderdate")} // 4) AS label FROM orders) ORDER BY o DESC LIMIT 2""")
def last_two_seasons(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "orders", cal.season_ord(F.col("o_orderdate")).alias("o")).distinct()
    return s.orderBy(F.col("o").desc_nulls_last()).limit(2).select(cal.ord_label(F.col("o")).alias("label"))


QUERIES, SQL = R.queries, R.sql
