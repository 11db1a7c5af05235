"""Queries on containers (problem 7) and mixes (problem 8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.llm import mixing as m
from palaver.llm import packing as p
from palaver.llm.tokens import counted
from palaver.session import cut
from palaver.tables import table


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of each document, counted over the whole text of every row; a delivery counts once."""
    return cut(counted(table(spark, d, "documents"), ["doc_id"]).groupBy("doc_id").agg(F.min("n_tokens").alias("n_tokens")))


def _tiers(spark: SparkSession, d: str, most: int = 1_000) -> list[tuple[str, int]]:
    rows = table(spark, d, "container_sizes").select("container_kind", "capacity_tokens").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} kinds of container")
    return [(r[0], r[1]) for r in rows]


def p7_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Every document (or piece of one beyond the largest capacity) with its container and step."""
    return p.pack(_sizes(spark, d), _tiers(spark, d))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every container with its unused room."""
    tiers = _tiers(spark, d)
    return p.containers(p.pack(_sizes(spark, d), tiers), tiers)


def p7_room(spark: SparkSession, d: str) -> DataFrame:
    """Containers, tokens and unused share of each kind, all tiers together and each capacity alone."""
    tiers, sizes = _tiers(spark, d), _sizes(spark, d)
    out = p.containers(p.pack(sizes, tiers), tiers).withColumn("plan", F.lit("tiers"))
    for t in tiers:
        out = out.unionByName(p.containers(p.pack(sizes, [t]), [t]).withColumn("plan", F.lit("alone")))
    return out.groupBy("plan", "container_kind", "capacity_tokens").agg(
        F.count("*").alias("n_containers"), F.sum("used_tokens").alias("used_tokens"), F.sum("unused_tokens").alias("unused_tokens"),
        (F.sum("unused_tokens") / F.sum("capacity_tokens")).alias("unused_share"),
    )


def p7_alone(spark: SparkSession, d: str) -> DataFrame:
    """All documents packed into containers of each capacity by itself."""
    sizes, out = _sizes(spark, d), None
    for t in _tiers(spark, d):
        one = p.pack(sizes, [t]).withColumn("container_kind", F.lit(t[0]))
        out = one if out is None else out.unionByName(one)
    return out


def _pool(spark: SparkSession, d: str) -> DataFrame:
    """Documents with tokens and source; copies of one text share the weight of one document."""
    docs = table(spark, d, "documents")
    body = F.xxhash64(F.regexp_replace(F.lower(F.trim("text")), r"(?U)\s+", " "))
    base = docs.select("doc_id", m.tidy(F.col("source")).alias("source"), body.alias("same"), "text")
    rows = cut(counted(base, ["doc_id", "source", "same"]).where("n_tokens > 0 and source is not null").groupBy("doc_id").agg(F.min(F.struct("source", "same", "n_tokens")).alias("r")).select("doc_id", "r.*"))
    copies = rows.groupBy("same").agg(F.count("*").alias("copies")).where("copies > 1")
    # Texts that occur once need no join; AQE splits a text with very many copies.
    return rows.join(copies, "same", "left").select("doc_id", "source", "n_tokens", (1.0 / F.coalesce("copies", F.lit(1))).alias("weight"))


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    pool = cut(_pool(spark, d))
    plans = cut(m.plan(pool, table(spark, d, "mix_targets")))
    return plans, m.draw(pool, plans)


def p8_selection(spark: SparkSession, d: str) -> DataFrame:
    """The chosen documents of every mix with their repeats."""
    return _mixed(spark, d)[1]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached token shares of every mix and source."""
    plans, drawn = _mixed(spark, d)
    return m.shares(drawn, plans)


QUERIES = {f.__name__: f for f in (p7_assignment, p7_containers, p7_room, p7_alone, p8_selection, p8_shares)}
SQL: dict[str, str] = {}
