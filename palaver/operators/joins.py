"""Join patterns: strict lookups, zero-filled grids, name-insensitive sums, pairings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.functions.keys import name_key


def strict(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join that fails if a left key is missing on the right.

    The check is part of the plan: a left join whose missing rows raise an error when read.
    """
    marked = right.withColumn("__here", F.lit(True))
    x = left.join(marked, keys, "left")
    ok = F.when(F.col("__here"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no match for "), F.to_json(F.struct(*keys)))).cast("boolean"))
    return x.where(ok).drop("__here")


def with_unmatched(left: DataFrame, right: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(matched rows, left rows without a match)."""
    return left.join(right, keys), left.join(right, keys, "left_anti")


def grid(rows: DataFrame, items: DataFrame, counts: DataFrame, row: str, item: str, n: str, most_items: int = 5_000) -> DataFrame:
    """Every row with every item and its count, 0 where there is none.

    ``items`` is a closed list: beyond ``most_items`` this stops, as the grid grows with both. The
    items are an array in each row, so there is no join of rows with items.
    """
    known = [r[0] for r in items.select(item).distinct().limit(most_items + 1).collect()]
    if len(known) > most_items:
        raise ValueError(f"more than {most_items} items")
    kind = items.schema[item].dataType
    full = rows.select(row, F.explode(F.array(*[F.lit(k) for k in sorted(known)]).cast(f"array<{kind.simpleString()}>")).alias(item))
    return full.join(counts.select(row, item, n), [row, item], "left").fillna(0, [n])


def summed_by_name(roster: DataFrame, sources: list[DataFrame], keys: list[str], name: str, features: list[str]) -> DataFrame:
    """Features of each roster name; spellings that fall together add up (J10); absent ones are 0."""
    long = None
    for s in sources:
        one = s.select(*keys, name_key(F.col(name)).alias("__k"), *[(F.col(f) if f in s.columns else F.lit(0)).cast("double").alias(f) for f in features])
        long = one if long is None else long.unionByName(one)
    g = long.groupBy(*keys, "__k").agg(*[F.sum(f).alias(f) for f in features])
    return roster.withColumn("__k", name_key(F.col(name))).join(g, [*keys, "__k"], "left").drop("__k").fillna(0.0, features)


def with_missing(df: DataFrame, columns: list[str], default: float = 0.0) -> DataFrame:
    """``df`` with absent columns added as ``default`` (schema helper for dynamic loaders)."""
    return df.select("*", *[F.lit(default).alias(c) for c in columns if c not in df.columns])


def pairings(df: DataFrame, unit: list[str], who: str, values: list[str]) -> DataFrame:
    """Each unordered pair of different ``who`` over the units both have."""
    a = df.select(*unit, F.col(who).alias("a"), *[F.col(v).alias(f"{v}_a") for v in values])
    b = df.select(*unit, F.col(who).alias("b"), *[F.col(v).alias(f"{v}_b") for v in values])
    return a.join(b, unit).where("a < b")


def in_group(value: Column, members: Column) -> Column:
    """Whether a value is in an array of members; false for nulls."""
    return F.coalesce(F.array_contains(members, value), F.lit(False))
