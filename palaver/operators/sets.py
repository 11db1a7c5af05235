"""Set operations with a defined order, and deterministic samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from palaver.functions.keys import hash_rank


def keep_one(df: DataFrame, keys: list[str], order: list[Column], last: bool = False) -> DataFrame:
    """One row for each key, the first or last in ``order`` (U02, U03): an aggregation, no window."""
    best = F.struct(*[o.alias(f"__o{i}") for i, o in enumerate(order)], *[F.col(c).alias(f"__c{i}") for i, c in enumerate(df.columns)])
    g = df.groupBy(*keys).agg((F.max if last else F.min)(best).alias("__r"))
    return g.select(*[F.col(f"__r.__c{i}").alias(c) for i, c in enumerate(df.columns)])


def set_report(expected: Column, got: Column) -> Column:
    """(missing, extra, duplicated) of two arrays (U04), each sorted."""
    e, g = F.coalesce(expected, F.array().cast("array<int>")), F.coalesce(got, F.array().cast("array<int>"))
    dup = F.array_sort(F.array_distinct(F.filter(g, lambda x: F.size(F.filter(g, lambda y: y == x)) > 1)))
    return F.struct(F.array_sort(F.array_except(e, g)).alias("missing"), F.array_sort(F.array_except(g, e)).alias("extra"), dup.alias("duplicated"))


def overlap_count(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """How many distinct keys two tables share (U09: 0 means no leak)."""
    return a.select(*keys).intersect(b.select(*keys)).agg(F.count("*").alias("n_shared"))


def stratified(df: DataFrame, strata: list[str], row_id: str, per_cell: int, seed: int = 0) -> DataFrame:
    """``per_cell`` rows of each stratum by hash rank, the same on every run.

    The rank is cut in bins first: a stratum with very many rows is thinned to the bins that can
    reach the sample before anything is sorted.
    """
    h = hash_rank(F.col(row_id), F.lit(seed))
    x = df.withColumn("__h", h)
    counts = x.groupBy(*strata, F.shiftright("__h", 20).alias("__b")).agg(F.count("*").alias("__n"))
    w = W.partitionBy(*strata).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    need = counts.withColumn("__before", F.coalesce(F.sum("__n").over(w), F.lit(0))).where(F.col("__before") < per_cell).select(*strata, "__b")
    near = x.withColumn("__b", F.shiftright("__h", 20)).join(need, [*strata, "__b"], "left_semi")
    k = F.row_number().over(W.partitionBy(*strata).orderBy("__h", row_id))
    return near.withColumn("__k", k).where(F.col("__k") <= per_cell).drop("__h", "__b", "__k")


def topped_up(df: DataFrame, strata: list[str], row_id: str, per_cell: int, total: int, seed: int = 0) -> DataFrame:
    """``per_cell`` rows of each stratum, then rows of all strata by hash rank up to ``total`` in all.

    ``is_top_up`` tells the two apart. Only ``total`` rows can be taken beyond the strata, so the rest is limited before it is sorted in.
    """
    cells = stratified(df, strata, row_id, per_cell, seed).withColumn("is_top_up", F.lit(False))
    rest = df.join(cells.select(row_id), row_id, "left_anti").orderBy(hash_rank(F.col(row_id), F.lit(seed)), row_id).limit(total).withColumn("is_top_up", F.lit(True))
    both = cells.unionByName(rest)
    return both.orderBy("is_top_up", hash_rank(F.col(row_id), F.lit(seed)), row_id).limit(total)


def split_by_share(df: DataFrame, by: list[str], row_id: str, share: float, seed: int = 0) -> DataFrame:
    """``df`` with ``split``: ``val`` for the first round(n * share) hash ranks of each bucket, else ``train``.

    Ranks are counted in bins; only the bin that the border runs through is sorted, so a bucket of
    very many rows is no single task.
    """
    x = df.withColumn("__h", hash_rank(F.col(row_id), F.lit(seed))).withColumn("__b", F.shiftright("__h", 20))
    counts = x.groupBy(*by, "__b").agg(F.count("*").alias("__n"))
    w = W.partitionBy(*by)
    bins = counts.select(*[F.col(c).alias(f"__k_{c}") for c in by], F.col("__b").alias("__k"), "__n", F.coalesce(F.sum("__n").over(w.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.round(F.sum("__n").over(w) * share).alias("__goal"))
    at = F.col("__b") == F.col("__k")
    for c in by:
        at = at & F.col(c).eqNullSafe(F.col(f"__k_{c}"))
    y = x.join(bins, at)
    border = (F.col("__before") < F.col("__goal")) & (F.col("__before") + F.col("__n") > F.col("__goal"))
    ranked = y.where(border).withColumn("__r", F.col("__before") + F.row_number().over(W.partitionBy(*by, "__b").orderBy("__h", row_id)))
    whole = y.where(~border).withColumn("__r", F.col("__before") + 1)
    return ranked.unionByName(whole).withColumn("split", F.when(F.col("__r") <= F.col("__goal"), "val").otherwise("train")).select(*df.columns, "split")


def largest_remainder(shares: DataFrame, total: int, key: str, weight: str) -> DataFrame:
    """Whole numbers that add to ``total`` in proportion to ``weight``, ties by key."""
    all_ = W.partitionBy(F.lit(1))
    x = shares.withColumn("__q", F.col(weight) * total / F.sum(weight).over(all_)).withColumn("__f", F.floor("__q"))
    left = F.lit(total) - F.sum("__f").over(all_)
    k = F.row_number().over(all_.orderBy(F.desc(F.col("__q") - F.col("__f")), key))
    return x.withColumn("n", (F.col("__f") + (k <= left).cast("int")).cast("int")).drop("__q", "__f")


def round_robin(df: DataFrame, runs: str, prefer: str, row_id: str, n: int) -> DataFrame:
    """``n`` rows taken from the runs in turn, each run offering unseen ``prefer`` values first.

    Within a run the first row of each ``prefer`` value comes before its repeats; runs alternate by
    their row's number. No more than ``n`` rows of a run or a value can be taken, so both rankings
    are limited to ``n`` where the rows lie, before they are shuffled.
    """
    h = hash_rank(F.col(row_id))
    x = df.withColumn("__h", h)
    x = x.withColumn("__again", F.row_number().over(W.partitionBy(runs, prefer).orderBy("__h", row_id))).where(F.col("__again") <= n)
    x = x.withColumn("__turn", F.row_number().over(W.partitionBy(runs).orderBy("__again", "__h", row_id))).where(F.col("__turn") <= n)
    return x.orderBy("__turn", runs).limit(n).drop("__again", "__turn", "__h")


def slice_rows(df: DataFrame, order: list[str], start: int, most: int) -> DataFrame:
    """Rows ``start`` to ``start + most`` in ``order``."""
    return df.orderBy(*order).offset(start).limit(most)


def pending(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work whose key is not among the completed ones."""
    return work.join(done, keys, "left_anti")


def upsert(store: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The store with rows of ``new`` in place of those of the same key."""
    return store.join(new, keys, "left_anti").unionByName(new, allowMissingColumns=True)
