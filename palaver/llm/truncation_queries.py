"""Queries on truncated texts (problem 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.llm import truncation as t
from palaver.tables import table


def _ends(spark: SparkSession, d: str) -> DataFrame:
    cap = F.col("debug_info.output_token_count") >= F.col("max_new_tokens")
    return t.endings(t.values(
        ("vote_results", table(spark, d, "vote_results"), "result_id", "source", "raw_response", cap, None),
        ("prelim_results", table(spark, d, "prelim_results"), "prelim_id", "model_name", "raw_response", cap, F.col("question")),
        ("vote_file_level", table(spark, d, "vote_file_level"), "file_row_id", "source", "justification", None, None),
    ))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Every row whose text ends before its content does."""
    return t.posteriors(_ends(spark, d)).where("posterior > 0.5").select("table_name", "row_id").distinct()


def p1_rates(spark: SparkSession, d: str) -> DataFrame:
    """How often each source (or model) truncates: distinct rows with text and the share cut."""
    p = t.posteriors(_ends(spark, d)).groupBy("table_name", "grp", "row_id").agg(F.max("posterior").alias("p"))
    return p.groupBy("table_name", "grp").agg(
        F.count("*").alias("n_texts"), F.sum((F.col("p") > 0.5).cast("long")).alias("n_truncated"), F.avg((F.col("p") > 0.5).cast("double")).alias("share_truncated")
    )


def p1_limits(spark: SparkSession, d: str) -> DataFrame:
    """The fitted length distribution of each source and the limits at which it cuts."""
    return t.fits(_ends(spark, d)).select("table_name", "grp", F.col("bin").alias("limit_chars"), "n", "n_cut", "mu", "sigma", "prior")


QUERIES = {f.__name__: f for f in (p1_found, p1_rates, p1_limits)}
SQL: dict[str, str] = {}
