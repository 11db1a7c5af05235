"""Multi-label annotation statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def label_array(x: Column, none: str) -> Column:
    """Labels of a list text, a bare word or null, each once in first order.

    Null, blank and empty lists, and lists of nothing but ``none``, give one label ``none``.
    """
    listed = F.from_json(F.when(x.startswith("["), x), "array<string>")
    got = F.array_distinct(F.filter(F.coalesce(listed, F.array(F.trim(x))), lambda v: v.isNotNull() & (F.trim(v) != "")))
    return F.when(x.isNull() | (F.size(got) == 0), F.array(F.lit(none))).otherwise(got)


def exploded(df: DataFrame, labels: str = "labels") -> DataFrame:
    """One row for each row and label, with ``label``."""
    return df.withColumn("label", F.explode(labels))


def label_counts(df: DataFrame, row_id: str, group_id: str, none: str) -> DataFrame:
    """Each label's assignments, rows and groups with percentages of the totals."""
    e = exploded(df).where(F.col("label") != none)
    total = e.agg(F.count("*").alias("ta")).crossJoin(df.agg(F.countDistinct(row_id).alias("tr"), F.countDistinct(group_id).alias("tg")))
    c = e.groupBy("label").agg(F.count("*").alias("n_assignments"), F.countDistinct(row_id).alias("n_rows"), F.countDistinct(group_id).alias("n_groups"))
    pct = lambda a, b: F.try_divide(F.col(a) * 100.0, F.col(b))
    return c.crossJoin(F.broadcast(total)).select("label", "n_assignments", "n_rows", "n_groups", pct("n_assignments", "ta").alias("pct_assignments"), pct("n_rows", "tr").alias("pct_rows"), pct("n_groups", "tg").alias("pct_groups"))


def shares(df: DataFrame, group: list[str], value: str, count: str = "n", pct: str = "pct") -> DataFrame:
    """Counts of ``value`` within ``group`` and their percentage of the group.

    Counted before the window, so the window sorts distinct values and no rows.
    """
    c = df.groupBy(*group, value).agg(F.count("*").alias(count))
    return c.withColumn(pct, F.col(count) * 100.0 / F.sum(count).over(W.partitionBy(*group) if group else W.partitionBy(F.lit(1))))


def histogram(df: DataFrame, none: str, labels: str = "labels") -> DataFrame:
    """How many rows carry 0, 1, 2, … labels."""
    return df.groupBy(F.size(F.array_remove(F.col(labels), none)).alias("n_labels")).agg(F.count("*").alias("n_rows"))


def conditional_counts(df: DataFrame, keys: list[str], kinds: tuple[str, ...], prefix: str = "n_", labels: str = "labels") -> DataFrame:
    """For each key the rows, rows with any kind, and rows with each kind, by one aggregation."""
    name = lambda k: prefix + k.lower().replace(" ", "_")
    has = lambda k: F.array_contains(F.col(labels), k)
    known = F.array(*[F.lit(k) for k in kinds])
    return df.groupBy(*keys).agg(
        F.count("*").alias("n_rows"), F.count_if(F.arrays_overlap(F.col(labels), known)).alias("n_labelled"),
        F.count_if(F.size(F.array_intersect(F.col(labels), known)) == 1).alias("n_single"), *[F.count_if(has(k)).alias(name(k)) for k in kinds],
    )


def positions(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """1-based ``position`` and ``n`` of each row within its key."""
    w = W.partitionBy(*key)
    return df.withColumn("position", F.row_number().over(w.orderBy(*order))).withColumn("n", F.count("*").over(w))


def third(position: Column, n: Column) -> Column:
    """``beginning``, ``middle`` or ``end`` by right-closed thirds of the relative position."""
    return F.when(position * 3 <= n, "beginning").when(position * 3 <= n * 2, "middle").otherwise("end")


def half(position: Column, n: Column) -> Column:
    """``early`` up to and including the middle of the dialogue, else ``late``."""
    return F.when(position * 2 <= n, "early").otherwise("late")


def own_half(position: Column, n: Column) -> Column:
    """``early`` for the first ``n div 2`` of the speaker's own rows (A42's other rule, T2)."""
    return F.when(position <= F.floor(n / 2), "early").otherwise("late")


def cooccurrence(df: DataFrame, row_id: str, none: str) -> DataFrame:
    """Rows that carry both labels of each unordered pair (A56): pairs within one row's own labels."""
    have = F.array_sort(F.array_remove(F.col("labels"), none))
    pairs = F.flatten(F.transform(have, lambda a: F.transform(F.filter(have, lambda b: b > a), lambda b: F.struct(a.alias("label_a"), b.alias("label_b")))))
    return df.select(row_id, F.explode(pairs).alias("p")).groupBy("p.label_a", "p.label_b").agg(F.count("*").alias("n_rows"))


def conditional(df: DataFrame, none: str, by: list[str] = ()) -> DataFrame:
    """100 · P(column label | row label) for each pair of different labels (A57); no diagonal."""
    have = F.array_remove(F.col("labels"), none)
    one = df.select(*by, F.explode(have).alias("row_label")).groupBy(*by, "row_label").agg(F.count("*").alias("n_given"))
    pairs = F.flatten(F.transform(have, lambda a: F.transform(F.filter(have, lambda b: b != a), lambda b: F.struct(a.alias("row_label"), b.alias("col_label")))))
    two = df.select(*by, F.explode(pairs).alias("p")).groupBy(*by, "p.row_label", "p.col_label").agg(F.count("*").alias("n_both"))
    return two.join(one, [*by, "row_label"]).withColumn("pct", F.col("n_both") * 100.0 / F.col("n_given"))


def describe(df: DataFrame, value: str, group: list[str]) -> DataFrame:
    """Count, sum, mean, sample deviation, extremes and exact interpolated quantiles."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75), F.lit(0.9)))
    g = df.groupBy(*group).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("min"), F.max(value).alias("max"), q.alias("q"))
    return g.select(*group, "n", "total", "mean", "sd", "min", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75"), F.col("q")[3].alias("p90"), "max")
