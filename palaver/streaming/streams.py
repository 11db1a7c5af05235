"""Streaming counterparts: windowed label counts, sessions, deliveries without repeats, resumed work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_table(spark: SparkSession, path: str, schema, glob: str = "*.parquet", files_per_trigger: int = 16) -> DataFrame:
    """A stream of Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def first_deliveries(rows: DataFrame, keys: list[str], at: str, late: str = "7 days") -> DataFrame:
    """Rows without repeated deliveries of the same keys within the watermark's reach."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(rows: DataFrame, at: str, kind: str, length: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts of each kind in tumbling windows; late rows beyond the watermark are dropped by it."""
    return rows.withWatermark(at, late).groupBy(F.window(at, length).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def sessions(rows: DataFrame, at: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each key: start, end and number of rows."""
    return rows.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over what has arrived, resuming from its checkpoint, and appends to Parquet."""
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
