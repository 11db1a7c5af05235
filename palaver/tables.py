"""Loaders of the test tables and the removal of repeated deliveries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def first_delivery(df: DataFrame, keys: list[str], arrival: str, keep: list[str]) -> DataFrame:
    """One row for each key, with the ``keep`` columns of its earliest delivery.

    A hash aggregation with map-side combining, so a key with very many repeats is reduced before
    the shuffle. Ties in ``arrival`` fall to the least row by value; rows with a null arrival count
    as the latest. Rows whose key is null throughout are kept apart by content, not merged.
    """
    late = F.coalesce(F.col(arrival).cast("timestamp"), F.to_timestamp(F.lit("9999-01-01")))
    body = [F.col(c) for c in keep]
    best = df.groupBy(*[F.col(k) for k in keys], F.when(_all_null(keys), F.xxhash64(*body)).alias("__apart")).agg(
        F.min(F.struct(late.alias("__at"), *body)).alias("__row")
    )
    return best.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in keep if c not in keys])


def _all_null(keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).isNull()
    return out
