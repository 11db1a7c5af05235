"""Vote distributions, agreement, destinations and lift, in long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from palaver.functions.mathx import entropy_term


def distribution(v: DataFrame, keys: list[str], target: str = "target") -> DataFrame:
    """Each key's targets with ``n``, ``total`` and mass ``p``. Two aggregations, no window on votes."""
    c = v.groupBy(*keys, target).agg(F.count("*").alias("n"))
    w = W.partitionBy(*keys)
    return c.withColumn("total", F.sum("n").over(w)).withColumn("p", F.col("n") / F.col("total"))


def majority(dist: DataFrame, keys: list[str], target: str = "target") -> DataFrame:
    """Entropy in nats, top share, and the strict majority: a single top with over half."""
    g = dist.groupBy(*keys).agg(F.sum("n").alias("n_votes"), F.sum(entropy_term(F.col("p"))).alias("entropy"), F.max("p").alias("top_share"), F.max_by(target, F.struct("n", target)).alias("top"))
    return g.withColumn("majority", F.when(F.col("top_share") > 0.5, F.col("top"))).drop("top")


def plurality(dist: DataFrame, keys: list[str], target: str = "target", least: int = 2, circle: str = "circle") -> DataFrame:
    """All targets with the most votes, sorted; ``circle`` if that is under ``least`` votes."""
    top = dist.groupBy(*keys).agg(F.max("n").alias("most"), F.collect_list(F.struct("n", target)).alias("l"))
    names = F.array_sort(F.transform(F.filter("l", lambda s: s["n"] == F.col("most")), lambda s: s[target]))
    return top.select(*keys, "most", F.when(F.col("most") < least, F.array(F.lit(circle).cast(dict(dist.dtypes)[target]))).otherwise(names).alias("winners"))


def agreement(dist: DataFrame, unit: str, who: str, target: str = "target") -> DataFrame:
    """Mean expected agreement of two voters over the units both have: sum of p_a p_b.

    Joined on (unit, target), so only targets that both chose meet; ``a = b`` is self-agreement.
    """
    left = dist.select(unit, target, F.col(who).alias("a"), F.col("p").alias("pa"))
    right = dist.select(unit, target, F.col(who).alias("b"), F.col("p").alias("pb"))
    per = left.join(right, [unit, target]).where("a <= b").groupBy("a", "b").agg(F.sum(F.col("pa") * F.col("pb")).alias("mass"))
    units = dist.select(unit, who).distinct()
    both = units.withColumnRenamed(who, "a").join(units.withColumnRenamed(who, "b"), unit).where("a <= b").groupBy("a", "b").agg(F.count("*").alias("n_units"))
    return both.join(per, ["a", "b"], "left").select("a", "b", "n_units", (F.coalesce("mass", F.lit(0.0)) / F.col("n_units")).alias("agreement"))


def destination(is_circle: Column, is_correct: Column, end_role: Column, start_role: Column) -> Column:
    """Where a vote goes, by precedence (A23): nobody, a werewolf, a former one, the tanner, another."""
    return (
        F.when(is_circle, "circle").when(end_role == "Werewolf", "werewolf").when(start_role == "Werewolf", "former_werewolf")
        .when(end_role == "Tanner", "tanner").otherwise("other")
    )


def lift(observed: DataFrame, seats: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """Observed mass of each kind against its share of the seats.

    ``observed``: keys, kind, mass; ``seats``: keys, kind, n_seats, n_all. The expected mass of a key
    is its whole mass times the kind's share of the seats.
    """
    total = observed.groupBy(*keys).agg(F.sum("mass").alias("whole"))
    x = seats.join(total, keys).join(observed, [*keys, kind], "left")
    g = x.groupBy(kind).agg(F.sum(F.coalesce("mass", F.lit(0.0))).alias("observed"), F.sum(F.col("whole") * F.col("n_seats") / F.col("n_all")).alias("expected"))
    return g.withColumn("lift", F.try_divide("observed", "expected"))


def game_class(has_wolf: Column, n_votes: Column, winners: Column, wolves: Column) -> Column:
    """no_werewolf, no_human_votes, aligned, dissociated or mixed_tie."""
    inside, outside = F.size(F.array_intersect(winners, wolves)), F.size(F.array_except(winners, wolves))
    return (
        F.when(~has_wolf, "no_werewolf").when(F.coalesce(n_votes, F.lit(0)) == 0, "no_human_votes").when(outside == 0, "aligned")
        .when(inside == 0, "dissociated").otherwise("mixed_tie")
    )
