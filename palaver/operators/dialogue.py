"""Records of dialogues: visibility, numbering, structural checks, ordered drop reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def is_public(visible: Column) -> Column:
    """Whether a message is for all, in any shape of the field; false for null."""
    names = F.split(F.regexp_replace(F.lower(F.coalesce(visible, F.lit(""))), r"[\[\]\"]", ""), ",")
    return F.array_contains(F.transform(names, lambda x: F.trim(x)), "all")


def without_lines(df: DataFrame, text: str, key: str, marker: str) -> DataFrame:
    """Rows without the one line of each key that holds ``marker``.

    A key with several such lines is an error when it is read: the marker would not be unique.
    """
    hit = F.coalesce(F.col(text).contains(marker), F.lit(False))
    n = df.groupBy(key).agg(F.count_if(hit).alias("__n"))
    ok = F.when(F.col("__n") <= 1, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("marker is not unique in "), F.col(key).cast("string"))).cast("boolean"))
    return df.join(n, key).where(ok).where(~hit).drop("__n")


def numbered(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows with ``turn_no`` from 1 within their key."""
    return df.withColumn("turn_no", F.row_number().over(W.partitionBy(key).orderBy(*order)).cast("long"))


def episode_problems(df: DataFrame, least: int = 3) -> DataFrame:
    """The structural problems of each episode in their order."""
    n = F.count("*")
    p = F.array(
        F.when(n < least, "too_few_messages"), F.when(F.count("turn") < n, "turn_missing"),
        F.when(F.count_if(F.trim(F.coalesce("content", F.lit(""))) == "") > 0, "content_missing"), F.when(F.count("visible_to") < n, "visibility_missing"),
    )
    return df.groupBy("episode_id").agg(F.filter(p, lambda x: x.isNotNull()).alias("problems"))


def reasons(df: DataFrame, ordered: list[tuple[Column, str]], kept: str = "kept") -> DataFrame:
    """How many rows each reason drops, the first that holds counting."""
    out = None
    for test, name in ordered:
        out = F.when(test, name) if out is None else out.when(test, name)
    return df.groupBy(out.otherwise(kept).alias("reason")).agg(F.count("*").alias("n"))
