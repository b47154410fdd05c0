"""Queries on intake, dictionaries, streams and the sampler; those without SQL are tested on fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.functions import calendar as cal
from quadrat.operators import forecast
from quadrat.plans.registry import Registry
from quadrat.sources import files
from quadrat.sources.tables import scratch, table
from quadrat.streaming import intake

R = Registry()
TRAPS = "data_monitoring_traps_clean"
_CONTRACT = (("record_id", "double", True), ("region", "string", True), ("farmer", "string", False), ("date", "date", False), ("traps_set", "double", False))


def _csv_folder(spark: SparkSession, d: str) -> str:
    """The trap nights written as CSV files, one folder for each trap type."""
    folder = scratch(spark, "csv")
    t = table(spark, d, TRAPS, "record_id", "region", "farmer", F.date_format("date", "d/M/yyyy").alias("date"), "traps_set", "trap_type")
    files.write_csv(t, f"{folder}/in", by="trap_type")
    return folder


@R.add("SELECT CAST(record_id AS DOUBLE) AS record_id, region, nullif(trim(farmer, ' '), '') AS farmer, date, traps_set FROM data_monitoring_traps_clean")
def csv_intake(spark: SparkSession, d: str) -> DataFrame:
    return files.read_csv_folder(spark, f"{_csv_folder(spark, d)}/in", contract=_CONTRACT).drop("source_file", "source_path")


@R.add("SELECT trap_type, count(*) AS n_rows, CAST(sum(traps_set) AS DOUBLE) AS traps FROM data_monitoring_traps_clean WHERE trap_type <> 'longworth' GROUP BY trap_type")
def csv_exclusion(spark: SparkSession, d: str) -> DataFrame:
    """Files by where they are from, those of one folder excluded."""
    t = files.read_csv_folder(spark, f"{_csv_folder(spark, d)}/in", contract=_CONTRACT, exclude=("trap_type=longworth",))
    kind = F.regexp_extract("source_path", "trap_type=([^/]+)/", 1)
    return t.groupBy(kind.alias("trap_type")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("traps_set").alias("traps"))


@R.add("SELECT trap_type, true AS has_files FROM (SELECT DISTINCT trap_type FROM data_monitoring_traps_clean)")
def csv_discovery(spark: SparkSession, d: str) -> DataFrame:
    found = files.find_csv(spark, f"{_csv_folder(spark, d)}/in").select(F.regexp_extract("path", "trap_type=([^/]+)/", 1).alias("trap_type"), (F.col("length") > 0).alias("f"))
    return found.groupBy("trap_type").agg(F.bool_or("f").alias("has_files"))


@R.add("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def jdbc_fetch(spark: SparkSession, d: str) -> DataFrame:
    """A table put into a database that goes with the job, for want of a server, and read back by the executors in ranges of its key."""
    cols, driver = ("n_nationkey", "n_name", "n_regionkey"), {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    url = files.packed_database(spark, table(spark, d, "nation", *cols), "nation_copy")
    return files.read_jdbc(spark, url, "nation_copy", "n_nationkey", (0, 25), 4, options=driver).select(*cols)


@R.add("SELECT region, count(*) AS n_rows, CAST(sum(traps_set) AS DOUBLE) AS traps FROM data_monitoring_traps_clean GROUP BY region")
def intake_stream(spark: SparkSession, d: str) -> DataFrame:
    folder = _csv_folder(spark, d)
    intake.run_once(intake.intake_stream(spark, f"{folder}/in", _CONTRACT), f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out").groupBy("region").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("traps_set").alias("traps"))


@R.add("""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
  SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n_events FROM s GROUP BY user_id, k""")
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    out = intake.sessions_of(e, "user_id", "ts", "6 hours", "1 day")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


_DICTIONARY = " UNION ALL ".join(
    f"""SELECT '{t}' AS table_name, c.column_name, CASE c.data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' WHEN 'DATE' THEN 'date' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' END AS data_type,
    CASE WHEN (SELECT count(*) FROM duckdb_columns() x WHERE x.column_name = c.column_name AND x.table_name IN ('data_monitoring_traps_clean', 'data_long', 'counts_grids_mallee')) = 3 THEN 'shared' ELSE 'own' END AS scope,
    CASE c.column_name WHEN 'site_data_id' THEN 'paddock' WHEN 'traps_set' THEN 'traps put out' WHEN 'region' THEN 'survey region' ELSE 'not yet documented' END AS description, CAST((SELECT count(*) FROM duckdb_columns() x WHERE x.table_name = '{t}') AS INTEGER) AS n_columns, (SELECT count(*) FROM {t}) AS n_rows
    FROM duckdb_columns() c WHERE c.table_name = '{t}'"""
    for t in ("data_monitoring_traps_clean", "data_long", "counts_grids_mallee")
)


@R.add(_DICTIONARY)
def data_dictionary(spark: SparkSession, d: str) -> DataFrame:
    tables = {n: table(spark, d, n) for n in (TRAPS, "data_long", "counts_grids_mallee")}
    return files.data_dictionary(spark, tables, {"site_data_id": "paddock", "traps_set": "traps put out", "region": "survey region"})


@R.add("SELECT DISTINCT 'http://localhost/' || lower(regexp_replace(subsite, '[^A-Za-z0-9]+', '_', 'g')) || '.nc' AS url FROM site_data")
def xml_catalogue(spark: SparkSession, d: str) -> DataFrame:
    path = F.regexp_replace(F.lower("subsite"), "[^a-z0-9]+", "_")
    xml = table(spark, d, "site_data", "subsite").select(F.concat(F.lit('<catalog><dataset name="x" urlPath="'), path, F.lit('.nc"/><dataset urlPath="notes.txt"/></catalog>')).alias("xml"))
    return files.catalogue_urls(xml, "xml", "http://localhost/")


@R.add()
def posterior_draws(spark: SparkSession, d: str) -> DataFrame:
    """Draw summaries of the sampler for each zone and season of data_long."""
    from quadrat.operators import sampler

    t = table(spark, d, "data_long", "ae_zone", cal.parse_label(F.col("season_year_adj")).alias("time"), "mice", "traps").where("traps BETWEEN 1 AND 100 AND mice IS NOT NULL")
    draws = sampler.sample_draws(t.withColumn("share", F.col("mice") / F.col("traps")), "ae_zone", "time", "share")
    return forecast.summarise_draws(draws, "ae_zone")


@R.add()
def beta_forecasts(spark: SparkSession, d: str) -> DataFrame:
    """Summaries of the beta state-space model of each zone, two seasons on, with four lags of the share and the season as covariates."""
    from quadrat.operators import panel, sampler

    t = table(spark, d, "data_long", "ae_zone", cal.parse_label(F.col("season_year_adj")).alias("time"), "mice", "traps").where("traps BETWEEN 1 AND 100 AND mice IS NOT NULL AND ae_zone IS NOT NULL")
    t = t.groupBy("ae_zone", "time").agg((F.sum("mice") / F.sum("traps")).alias("share"))
    t = panel.lags(t, ["ae_zone"], "time", ["share"], 4).withColumns({f"season{i}": (F.pmod("time", F.lit(4)) == i).cast("int") for i in range(3)})
    draws = sampler.beta_forecast(t, "ae_zone", "time", "share", [*(f"share_lag{i}" for i in range(1, 5)), *(f"season{i}" for i in range(3))])
    return forecast.summarise_draws(draws, "ae_zone")


QUERIES, SQL = R.queries, R.sql
