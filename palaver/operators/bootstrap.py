"""Deterministic cluster bootstraps.

A replicate gives every cluster a Poisson(1) weight from a hash of its key and the replicate's
number: the same on every run and in every engine. Values are summed by cluster first; clusters are
then spread over replicates and summed at once, so only one row for each replicate is shuffled on.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.functions.keys import hash_rank

#: The inverse of the Poisson(1) distribution function: weight w below these bounds.
POISSON = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(8)]


def weight(key: Column, rep: Column) -> Column:
    """The weight of a cluster in a replicate, 0 to 8."""
    u = hash_rank(key, rep) / 4294967296.0
    out = F.when(u < POISSON[0], 0)
    for k in range(1, 8):
        out = out.when(u < POISSON[k], k)
    return out.otherwise(8)


def replicate_sums(clusters: DataFrame, key: str, sums: list[str], reps: int, by: list[str] = ()) -> DataFrame:
    """Weighted sums and total weight (``w``) of each replicate."""
    x = clusters.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("__w", weight(F.col(key), F.col("rep")))
    return x.where("__w > 0").groupBy(*by, "rep").agg(F.sum("__w").alias("w"), *[F.sum(F.col("__w") * F.col(c)).alias(c) for c in sums])


def interval(draws: DataFrame, value: Column, by: list[str] = (), low: float = 0.025, high: float = 0.975) -> DataFrame:
    """The percentile interval (linear interpolation) of the draws that are not null."""
    return draws.select(*by, value.alias("__v")).where("__v is not null").groupBy(*by).agg(F.count("*").alias("n_draws"), F.percentile("__v", F.array(F.lit(low), F.lit(high))).alias("q")).select(*by, "n_draws", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))


def order_interval(draws: DataFrame, value: Column, by: list[str] = ()) -> DataFrame:
    """The interval between order statistics int(.025 n) and int(.975 n) - 1, counted from 0.

    The draws of a group are as many as replicates, a parameter.
    """
    s = draws.select(*by, value.alias("__v")).where("__v is not null").groupBy(*by).agg(F.array_sort(F.collect_list("__v")).alias("v"))
    n = F.size("v")
    return s.select(*by, n.alias("n_draws"), F.get("v", F.floor(n * 0.025).cast("int")).alias("lo"), F.get("v", (F.floor(n * 0.975) - 1).cast("int")).alias("hi"))


def mean(clusters: DataFrame, key: str, value: str, reps: int, by: list[str] = ()) -> DataFrame:
    """Mean over clusters with its interval."""
    point = clusters.groupBy(*by).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    draws = replicate_sums(clusters.where(F.col(value).isNotNull()), key, [value], reps, by)
    ci = interval(draws, F.col(value) / F.col("w"), by)
    return point.join(ci, list(by)) if by else point.join(ci)


def differences(clusters: DataFrame, key: str, value: str, arm: str, reps: int) -> DataFrame:
    """Mean of one arm less that of another for every pair of arms, arms resampled apart.

    Columns first, second, difference, n_draws, lo, hi. Arms are a closed list; null arms are left out.
    """
    x = clusters.where(F.col(arm).isNotNull() & F.col(value).isNotNull()).withColumn("__k", F.concat_ws("|", arm, key))
    point = x.groupBy(F.col(arm).alias("g")).agg(F.avg(value).alias("m"))
    d = replicate_sums(x, "__k", [value], reps, [arm]).select(F.col(arm).alias("g"), "rep", (F.col(value) / F.col("w")).alias("m"))
    pair = lambda t, on: t.select(*on, F.col("g").alias("first"), F.col("m").alias("a")).join(t.select(*on, F.col("g").alias("second"), F.col("m").alias("b")), on if on else F.lit(True)).where("first < second")
    ci = interval(pair(d, ["rep"]), F.col("a") - F.col("b"), ["first", "second"])
    return pair(point, []).select("first", "second", (F.col("a") - F.col("b")).alias("difference")).join(ci, ["first", "second"])


def paired(clusters: DataFrame, key: str, a: str, b: str, reps: int, weights: str | None = None, least: float = 0.5, by: list[str] = ()) -> DataFrame:
    """Mean of a - b over clusters that have both, optionally weighted.

    Null if fewer than ``least`` of the replicates give a value.
    """
    w = F.col(weights) if weights else F.lit(1.0)
    x = clusters.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*by, key, (w * (F.col(a) - F.col(b))).alias("num"), w.alias("den"))
    point = x.groupBy(*by).agg(F.try_divide(F.sum("num"), F.sum("den")).alias("difference"), F.count("*").alias("n"))
    ci = interval(replicate_sums(x, key, ["num", "den"], reps, by), F.try_divide("num", "den"), by)
    ok = F.col("n_draws") >= least * reps
    both = point.join(ci, list(by)) if by else point.join(ci)
    return both.select(*by, "difference", "n", "n_draws", F.when(ok, F.col("lo")).alias("lo"), F.when(ok, F.col("hi")).alias("hi"))


def ratio(clusters: DataFrame, key: str, num: str, den: str, reps: int, by: list[str] = (), per: float = 100.0, tests: int = 1) -> DataFrame:
    """Sum over sum, per hundred, with an interval corrected for ``tests`` comparisons."""
    tail = 0.025 / tests
    point = clusters.groupBy(*by).agg((F.try_divide(F.sum(num), F.sum(den)) * per).alias("rate"))
    ci = interval(replicate_sums(clusters, key, [num, den], reps, by), F.try_divide(num, den) * per, by, tail, 1 - tail)
    return point.join(ci, list(by)) if by else point.join(ci)


def contrast(clusters: DataFrame, key: str, num1: str, den1: str, num2: str, den2: str, reps: int) -> DataFrame:
    """num1/den1 - num2/den2 with the order-statistic interval."""
    v = F.try_divide(num1, den1) - F.try_divide(num2, den2)
    point = clusters.agg((F.try_divide(F.sum(num1), F.sum(den1)) - F.try_divide(F.sum(num2), F.sum(den2))).alias("difference"))
    return point.join(order_interval(replicate_sums(clusters, key, [num1, den1, num2, den2], reps), v))


def f1_auc_draws(rows: DataFrame, key: str, by: str, label: str, predicted: str, score: str, reps: int, steps: int = 100) -> DataFrame:
    """F1 and AUC of each ``by`` in each replicate, clusters resampled; replicate -1 is the data themselves.

    Scores between 0 and 1 are counted in ``steps`` bins by cluster, so a replicate is a weighted
    histogram of at most ``steps`` + 1 cells. AUC is null without both classes.
    """
    y, p = F.col(label) == 1, F.col(predicted) == 1
    b = F.greatest(F.lit(0), F.least(F.floor(F.col(score) * steps + 1e-9), F.lit(steps))).cast("int")
    c = rows.groupBy(by, key, b.alias("b")).agg(F.count_if(y).alias("p"), F.count_if(~y).alias("n"), F.count_if(y & p).alias("tp"), F.count_if(p).alias("pp"))
    x = c.withColumn("rep", F.explode(F.sequence(F.lit(-1), F.lit(reps - 1)))).withColumn("w", F.when(F.col("rep") < 0, 1).otherwise(weight(F.col(key), F.col("rep")))).where("w > 0")
    cell = x.groupBy(by, "rep", "b").agg(*[F.sum(F.col("w") * F.col(k)).cast("double").alias(k) for k in ("p", "n", "tp", "pp")])
    g = cell.groupBy(by, "rep").agg(F.array_sort(F.collect_list(F.struct("b", "p", "n"))).alias("h"), *[F.sum(k).alias(k) for k in ("p", "n", "tp", "pp")])
    zero = F.struct(F.lit(0.0).alias("below"), F.lit(0.0).alias("wins"))
    wins = F.aggregate("h", zero, lambda a, e: F.struct((a["below"] + e["n"]).alias("below"), (a["wins"] + e["p"] * (a["below"] + e["n"] / 2)).alias("wins")))["wins"]
    return g.select(by, "rep", F.try_divide(2 * F.col("tp"), F.col("p") + F.col("pp")).alias("f1"), F.try_divide(wins, F.col("p") * F.col("n")).alias("auc"))


def f1_auc_intervals(draws: DataFrame, by: str) -> DataFrame:
    """Intervals of both metrics by ``by`` and of their differences over common replicates, paired."""
    long = draws.select(F.col(by).alias("first"), "rep", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in ("f1", "auc")])).alias("x")).select("first", "rep", "x.*")
    other = long.select("rep", "metric", F.col("first").alias("second"), F.col("v").alias("u"))
    pair = long.join(other, ["rep", "metric"]).where("first < second").select("first", "second", "metric", "rep", (F.col("v") - F.col("u")).alias("v"))
    both = long.select("first", F.lit("").alias("second"), "metric", "rep", "v").unionByName(pair)
    keys = ["first", "second", "metric"]
    return both.where("rep < 0").select(*keys, F.col("v").alias("value")).join(interval(both.where("rep >= 0"), F.col("v"), keys), keys)
