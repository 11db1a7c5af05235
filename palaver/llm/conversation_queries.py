"""Queries on conversations (problem 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.llm import conversations as c
from palaver.tables import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Every conversation to drop, with the first reason that fits."""
    verdict, _ = c.rebuild(table(spark, d, "messages"))
    return verdict.where("reason is not null").select("episode_id", "reason")


def p3_conversations(spark: SparkSession, d: str) -> DataFrame:
    """The messages of the kept conversations in their order, with roles."""
    return c.conversations(table(spark, d, "messages"))


QUERIES = {f.__name__: f for f in (p3_found, p3_conversations)}
SQL: dict[str, str] = {}
