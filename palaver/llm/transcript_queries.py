"""Queries on transcripts (problem 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palaver.llm.transcripts import turns
from palaver.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Every turn of every game by its first and last line."""
    return turns(table(spark, d, "utterances"), table(spark, d, "game_index"), text=False).select("game_id", "first_line_id", "last_line_id", "speaker")


def p2_turns(spark: SparkSession, d: str) -> DataFrame:
    """Every turn with its clean text."""
    return turns(table(spark, d, "utterances"), table(spark, d, "game_index"))


QUERIES = {f.__name__: f for f in (p2_found, p2_turns)}
SQL: dict[str, str] = {}
