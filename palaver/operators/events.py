"""Accusation and claim events: flattening, conflicts, contradictions, positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

UNKNOWN = "UNKNOWN"
TOTALS = (
    "instances", "no_relation", "with_relation", "relations", "unknown_relations", "unknown_instances", "instances_lost",
    "kept_instances", "kept_relations", "accusations", "from_group", "duplicates",
)


def accusation_totals(records: DataFrame, items: str = "items") -> DataFrame:
    """The counters of a corpus of accusation records in one row (A10).

    A relation that names UNKNOWN is unresolved as a whole (T6). Each item is reduced to its own
    counters where it lies, so only sums are shuffled.
    """
    rel = F.filter(F.coalesce(F.col("it.relations"), F.array().cast("array<struct<type:string,accused:array<string>,evidence:string>>")), lambda r: r.isNotNull())
    acc = lambda r: F.coalesce(r["accused"], F.array().cast("array<string>"))
    i = records.select(F.explode(items).alias("it")).where("it is not null").select(rel.alias("r")).select(
        "r", F.filter("r", lambda r: ~F.exists(acc(r), lambda a: a.eqNullSafe(UNKNOWN))).alias("k")
    )
    targets = F.flatten(F.transform("k", lambda r: F.transform(acc(r), lambda a: F.concat_ws("\u0000", F.coalesce(r["type"], F.lit("")), a))))
    group = F.aggregate(F.transform("k", lambda r: F.when(F.size(acc(r)) > 1, F.size(acc(r))).otherwise(0)), F.lit(0), lambda s, x: s + x)
    n, k, t = F.size("r"), F.size("k"), F.size(targets)
    one = {
        "instances": F.lit(1), "no_relation": (n == 0).cast("int"), "with_relation": (n > 0).cast("int"), "relations": n, "unknown_relations": n - k,
        "unknown_instances": (n > k).cast("int"), "instances_lost": ((n > 0) & (k == 0)).cast("int"), "kept_instances": (k > 0).cast("int"), "kept_relations": k,
        "accusations": t, "from_group": group, "duplicates": t - F.size(F.array_distinct(targets)),
    }
    return i.select(*[one[c].alias(c) for c in TOTALS]).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in TOTALS])


def role_conflicts(claims: DataFrame, keys: list[str], player: str = "player", role: str = "role") -> DataFrame:
    """Roles of a game that two or more players claim (A13), with the sorted players."""
    d = claims.select(*keys, role, player).distinct()
    return d.groupBy(*keys, role).agg(F.array_sort(F.collect_set(player)).alias("players"), F.count("*").alias("n_players")).where("n_players >= 2")


def self_contradictions(sets: DataFrame, keys: list[str], roles: str = "roles") -> DataFrame:
    """Whether no role satisfies all claims of a player with two or more claim lines.

    Counted instead of intersected: a role is in every set if it occurs on as many lines as there
    are, so a player with very many lines needs no collected list.
    """
    n = sets.groupBy(*keys).agg(F.count("*").alias("n_lines")).where("n_lines >= 2")
    per = sets.select(*keys, F.explode(F.array_distinct(F.col(roles))).alias("role")).groupBy(*keys, "role").agg(F.count("*").alias("on"))
    best = per.groupBy(*keys).agg(F.max("on").alias("most"))
    return n.join(best, keys, "left").select(*keys, "n_lines", (F.coalesce("most", F.lit(0)) < F.col("n_lines")).alias("is_contradiction"))


def conflict_features(claims: DataFrame, keys: list[str], player: str = "player", role: str = "role") -> DataFrame:
    """Each player's distinct roles, contested roles and other claimants of them."""
    d = claims.select(*keys, player, role).distinct()
    c = role_conflicts(claims, keys, player, role).select(*keys, role, "players")
    x = d.join(c, [*keys, role], "left")
    g = x.groupBy(*keys, player).agg(
        F.array_sort(F.collect_set(role)).alias("roles_claimed"), F.array_sort(F.collect_set(F.when(F.col("players").isNotNull(), F.col(role)))).alias("conflicting_roles"),
        F.array_distinct(F.flatten(F.collect_list("players"))).alias("all"),
    )
    return g.select(*keys, player, "roles_claimed", F.size("roles_claimed").alias("n_roles"), (F.size("conflicting_roles") > 0).alias("in_conflict"), F.size(F.array_remove("all", F.col(player))).alias("n_claimants"), "conflicting_roles")


def ordinal_at(points: DataFrame, marks: DataFrame, keys: list[str], at: str, mark: str, out: str) -> DataFrame:
    """For each point the number of marks of its key at or before it (J18, an as-of rank).

    A union and one running count, not a range join; marks at the point's own place count.
    """
    p = points.select("*", F.col(at).cast("double").alias("__at"), F.lit(1).alias("__kind"), F.lit(0).alias("__one"))
    m = marks.select(*keys, F.col(mark).cast("double").alias("__at"), F.lit(0).alias("__kind"), F.lit(1).alias("__one"))
    w = W.partitionBy(*keys).orderBy("__at", "__kind").rowsBetween(W.unboundedPreceding, 0)
    u = p.unionByName(m, allowMissingColumns=True).withColumn(out, F.sum("__one").over(w))
    return u.where("__kind = 1").drop("__at", "__kind", "__one")


def as_of(points: DataFrame, marks: DataFrame, keys: list[str], at: str, mark: str, values: list[str]) -> DataFrame:
    """Each point with the ``values`` of the last mark of its key at or before it, null if none."""
    p = points.select("*", F.col(at).alias("__at"), F.lit(1).alias("__kind"))
    m = marks.select(*keys, F.col(mark).alias("__at"), F.lit(0).alias("__kind"), F.struct(*values).alias("__v"))
    w = W.partitionBy(*keys).orderBy("__at", "__kind").rowsBetween(W.unboundedPreceding, 0)
    u = p.unionByName(m, allowMissingColumns=True).withColumn("__v", F.last("__v", True).over(w))
    return u.where("__kind = 1").select(*points.columns, *[F.col(f"__v.{v}").alias(v) for v in values])


def context(targets: DataFrame, rows: DataFrame, keys: list[str], at: str, reach: int) -> DataFrame:
    """All rows within ``reach`` places of a target (J19): targets spread to places, then an equi-join."""
    t = targets.select(*keys, F.col(at).alias("target_at"), F.explode(F.sequence(F.col(at) - reach, F.col(at) + reach)).alias(at))
    return t.join(rows, [*keys, at])


def most_accused(counts: DataFrame, keys: list[str], player: str, n: str) -> DataFrame:
    """The player with the most accusations, the first by name at a tie, null if none has any (X11)."""
    return counts.groupBy(*keys).agg(F.min_by(player, F.struct(-F.col(n), F.col(player))).alias("player"), F.max(n).alias("n")).withColumn("player", F.when(F.col("n") > 0, F.col("player")))


def half_of_line(ordinal: Column, n: Column) -> Column:
    """``early`` if the line's ordinal lies in the first half of the dialogue."""
    return F.when((n > 0) & (ordinal * 2 <= n), "early").otherwise("late")
