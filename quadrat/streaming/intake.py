"""Incremental intake: new files of a folder go once through the same cleaning as a batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.sources.files import TRAPPING, text_schema, typed


def intake_stream(spark: SparkSession, folder: str, contract: tuple = TRAPPING) -> DataFrame:
    """A stream of the typed rows of CSV files as they arrive, with ``source_file``."""
    raw = spark.readStream.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").schema(text_schema(contract)).csv(folder)
    return typed(raw.withColumn("source_file", F.col("_metadata.file_name")), contract)


def run_once(stream: DataFrame, out: str, checkpoint: str, clean: Callable[[DataFrame], DataFrame] = lambda d: d) -> None:
    """Takes what is new and appends it, cleaned, to a Parquet table; a batch that is run again replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        clean(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def sessions_of(events: DataFrame, user: str, ts: str, gap: str, late: str) -> DataFrame:
    """(user, session_start, session_end, n_events): sessions closed by a gap, late rows waited for; for streams and batches."""
    w = F.session_window(ts, gap)
    out = events.withWatermark(ts, late).groupBy(user, w.alias("w")).agg(F.count(F.lit(1)).alias("n_events"))
    return out.select(user, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events")
