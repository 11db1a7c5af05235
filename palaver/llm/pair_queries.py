"""Queries on question and response pairs (problem 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.llm import pairs as p
from palaver.llm import truncation as t
from palaver.tables import first_delivery, table


def _judged(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "prelim_results")
    rows = first_delivery(raw, ["prelim_id"], "created_at", ["question", "raw_response", "max_new_tokens", "debug_info"])
    cap = F.col("debug_info.output_token_count") >= F.col("max_new_tokens")
    # Endings are judged where the deliveries lie; only their figures are shuffled.
    ends = t.posteriors(t.endings(t.values(("prelim_results", raw, "prelim_id", "model_name", "raw_response", cap, F.col("question")))))
    once = ends.groupBy(F.col("row_id").alias("prelim_id")).agg(F.max("log_lr").alias("cut_lr"), F.max("prior").alias("cut_prior"))
    got = rows.join(once, "prelim_id", "left")
    return p.judged(got.select(F.col("prelim_id").alias("row_id"), "question", F.col("raw_response").alias("raw"), "cut_lr", "cut_prior", cap.alias("at_cap")), table(spark, d, "documents"), train=raw.select("question", F.col("raw_response").alias("raw")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Every defective pair of ``prelim_results`` with one defect, in the order of ``pairs.DEFECTS``."""
    return p.worst(p.defects(_judged(spark, d))).select(F.col("row_id").alias("prelim_id"), "defect")


def p4_labels(spark: SparkSession, d: str) -> DataFrame:
    """Every defect above its cutoff with its posterior: a pair may have several."""
    return p.defects(_judged(spark, d)).select(F.col("row_id").alias("prelim_id"), "defect", "posterior")


QUERIES = {f.__name__: f for f in (p4_found, p4_labels)}
SQL: dict[str, str] = {}
