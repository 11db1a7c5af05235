"""Queries on reading levels (problem 9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.llm.reading import Model
from palaver.tables import table


def _scored(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return Model(docs, table(spark, d, "level_labels")).scored(docs)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Every document with text and the level it is written in."""
    # Deliveries of one document have the same text, hence the same level.
    return _scored(spark, d).groupBy("doc_id").agg(F.min("reading_level").alias("reading_level"))


def p9_profile(spark: SparkSession, d: str) -> DataFrame:
    """Documents, mean grade, mean of the median surprisal and shares of the levels by source and language."""
    tidy = lambda c: F.regexp_replace(F.lower(F.trim(F.col(c))), "[- ]", "_")
    docs = table(spark, d, "documents").groupBy("doc_id").agg(F.min(tidy("source")).alias("source"), F.min(F.substring(tidy("lang"), 1, 2)).alias("lang"))
    rows = _scored(spark, d).groupBy("doc_id").agg(F.min("grade").alias("grade"), F.min("reading_level").alias("reading_level"), F.min("surprisal_p50").alias("surprisal")).join(docs, "doc_id")
    share = lambda k: F.avg((F.col("reading_level") == k).cast("double")).alias(f"share_{k}")
    return rows.groupBy("source", "lang").agg(F.count("*").alias("n_docs"), F.avg("grade").alias("mean_grade"), F.avg("surprisal").alias("mean_surprisal"), *[share(k) for k in ("easy", "middle", "hard")])


QUERIES = {f.__name__: f for f in (p9_found, p9_profile)}
SQL: dict[str, str] = {}
