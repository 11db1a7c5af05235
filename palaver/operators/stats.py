"""Statistical tests and classification metrics over grouped counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from palaver.functions.mathx import binomial_two_sided, chi2_sf, student_sf
from palaver.session import cut


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """chi2, df, n, Cramer's V, least expected count and p of two categories.

    Rows with a null are left out; cells that are absent count as observed 0.
    """
    c = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("o"))
    all_ = W.partitionBy(F.lit(1))
    x = c.withColumn("r", F.sum("o").over(W.partitionBy("a"))).withColumn("k", F.sum("o").over(W.partitionBy("b"))).withColumn("n", F.sum("o").over(all_))
    # sum((o - e)^2 / e) = sum over present cells of o^2 / e, less n.
    g = x.agg(F.sum(F.col("o") * F.col("o") * F.col("n") / (F.col("r") * F.col("k"))).alias("s"), F.max("n").alias("n"), F.countDistinct("a").alias("na"), F.countDistinct("b").alias("nb"), F.min("r").alias("mr"), F.min("k").alias("mk"))
    chi = F.col("s") - F.col("n")
    df_ = ((F.col("na") - 1) * (F.col("nb") - 1)).cast("int")
    p = F.udf(lambda s, d: None if s is None or not d else chi2_sf(s, d), "double")  # one row
    return g.select(chi.alias("chi2"), df_.alias("df"), "n", F.sqrt(F.try_divide(chi, F.col("n") * F.least(F.col("na") - 1, F.col("nb") - 1))).alias("cramers_v"), (F.col("mr") * F.col("mk") / F.col("n")).alias("min_expected"), p(chi, df_).alias("p"))


def mcnemar(df: DataFrame, a: str, b: str) -> DataFrame:
    """Exact McNemar test of each category against all others, with Holm's correction."""
    x = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    moves = x.groupBy("a", "b").agg(F.count("*").alias("n"))
    g = moves.select(F.explode(F.array(F.struct(F.col("a").alias("category"), F.col("n").alias("lost"), F.lit(0).cast("long").alias("gained")), F.struct(F.col("b").alias("category"), F.lit(0).cast("long").alias("lost"), F.col("n").alias("gained")))).alias("s")).select("s.*")
    g = g.groupBy("category").agg(F.sum("lost").alias("lost"), F.sum("gained").alias("gained"))
    p = F.udf(lambda k, m: binomial_two_sided(k, k + m), "double")  # one row for each category
    return holm(g.withColumn("p", p("lost", "gained")), "p", ["category"])


def holm(df: DataFrame, p: str, ties: list[str]) -> DataFrame:
    """Holm's step-down correction: the running maximum of (m - i) p, at most 1."""
    o = W.partitionBy(F.lit(1)).orderBy(p, *ties)
    m, k = F.count("*").over(W.partitionBy(F.lit(1))), F.row_number().over(o)
    x = df.withColumn("__s", F.least(F.lit(1.0), (m - k + 1) * F.col(p)))
    return x.withColumn("p_holm", F.max("__s").over(o.rowsBetween(W.unboundedPreceding, 0))).drop("__s")


def marginal_homogeneity(df: DataFrame, a: str, b: str) -> tuple[float, int, float]:
    """Stuart and Maxwell's statistic, its degrees of freedom and p.

    Counts of category pairs go to the driver (a closed list of categories); categories that never
    change are left out, and the covariance is inverted by its pseudo-inverse.
    """
    import numpy as np

    got = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n")).limit(250_001).collect()
    if len(got) > 250_000:
        raise ValueError("too many categories")
    names = sorted({r["a"] for r in got} | {r["b"] for r in got})
    n = np.zeros((len(names), len(names)))
    for r in got:
        n[names.index(r["a"]), names.index(r["b"])] = r["n"]
    row, col = n.sum(1), n.sum(0)
    live = [i for i in range(len(names)) if row[i] + col[i] > 2 * n[i, i]]
    if len(live) < 2:
        return 0.0, 0, 1.0
    n, row, col = n[np.ix_(live, live)], row[live], col[live]
    d = (row - col)[:-1]
    v = -(n + n.T)
    np.fill_diagonal(v, row + col - 2 * np.diag(n))
    stat = float(d @ np.linalg.pinv(v[:-1, :-1]) @ d)
    return stat, len(d), chi2_sf(stat, len(d))


def below(counts: DataFrame, keys: list[str], value: str, sums: list[str]) -> DataFrame:
    """``counts`` with ``<c>_below``: for each of ``sums`` the total over all smaller values of the same keys.

    ``counts`` has one row for each (keys, value). Rows are range-partitioned by keys and value, so
    the parts are of like size whatever the distribution; totals of the parts are added up first and
    a window runs only inside a part. No task sorts all values.
    """
    n = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Cut, so that the sampled bounds of the ranges are the same in both uses.
    x = cut(counts.repartitionByRange(n, *keys, value).withColumn("__b", F.spark_partition_id()))
    per = x.groupBy(*keys, "__b").agg(*[F.sum(c).alias(f"__{c}") for c in sums])
    before = (W.partitionBy(*keys) if keys else W.partitionBy(F.lit(1))).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    base = per.select(*keys, "__b", *[F.coalesce(F.sum(f"__{c}").over(before), F.lit(0)).alias(f"__{c}") for c in sums])
    inside = W.partitionBy(*keys, "__b").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    return x.join(base, [*keys, "__b"]).select(*counts.columns, *[(F.col(f"__{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(f"{c}_below") for c in sums])


def value_ranks(df: DataFrame, value: str) -> DataFrame:
    """Each distinct value with its count and average rank; nulls are left out."""
    c = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
    return below(c, [], "v", ["c"]).select("v", "c", (F.col("c_below") + (F.col("c") + 1) / 2.0).alias("rank"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Spearman's rho with its two-sided p, null without variation or with under three rows."""
    x = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
    ra, rb = value_ranks(x, "a").select(F.col("v").alias("a"), F.col("rank").alias("ra")), value_ranks(x, "b").select(F.col("v").alias("b"), F.col("rank").alias("rb"))
    pairs = x.groupBy("a", "b").agg(F.count("*").alias("w"))  # weighted pairs: repeats meet once
    y = pairs.join(ra, "a").join(rb, "b")
    w, s = F.col("w"), lambda c: F.sum(F.col("w") * c)
    g = y.agg(F.sum(w).alias("n"), s(F.col("ra")).alias("sa"), s(F.col("rb")).alias("sb"), s(F.col("ra") * F.col("ra")).alias("aa"), s(F.col("rb") * F.col("rb")).alias("bb"), s(F.col("ra") * F.col("rb")).alias("ab"))
    va, vb = F.col("aa") - F.col("sa") * F.col("sa") / F.col("n"), F.col("bb") - F.col("sb") * F.col("sb") / F.col("n")
    rho = F.when((F.col("n") >= 3) & (va > 0) & (vb > 0), (F.col("ab") - F.col("sa") * F.col("sb") / F.col("n")) / F.sqrt(va * vb))

    def tail(r, n):
        if r is None:
            return None
        return 0.0 if abs(r) >= 1 else 2 * student_sf(abs(r) * ((n - 2) / (1 - r * r)) ** 0.5, n - 2)

    return g.select("n", rho.alias("rho"), F.udf(tail, "double")(rho, F.col("n")).alias("p"))


def auc(df: DataFrame, label: str, score: str, keys: list[str] = ()) -> DataFrame:
    """Area under the ROC curve by average ranks, null with a single class.

    Rows with a null key, label or score are left out.
    """
    keys = list(keys)
    c = df.dropna(subset=[*keys, label, score]).groupBy(*keys, F.col(score).alias("s")).agg(F.sum(F.col(label)).alias("p"), F.sum(1 - F.col(label)).alias("n"))
    x = below(c, keys, "s", ["n"])
    pos, neg = F.sum("p"), F.sum("n")
    g = x.groupBy(*keys) if keys else x.groupBy()
    return g.agg(pos.alias("n_pos"), neg.alias("n_neg"), F.try_divide(F.sum(F.col("p") * (F.col("n_below") + F.col("n") / 2.0)), pos * neg).alias("auc"))


def threshold_counts(df: DataFrame, label: str, score: str, keys: list[str] = (), steps: int = 100) -> DataFrame:
    """Confusion counts and F1 at 1/steps … (steps-1)/steps from one histogram of the scores."""
    b = F.greatest(F.lit(0), F.least(F.floor(F.col(score) * steps + 1e-9), F.lit(steps))).cast("int")
    h = df.groupBy(*keys, b.alias("b")).agg(F.sum(label).alias("p"), F.count("*").alias("n"))
    lists = h.groupBy(*keys).agg(F.collect_list(F.struct("b", "p", "n")).alias("h"), F.sum("p").alias("pos"))  # at most steps + 1 bins
    x = lists.select(*keys, "h", "pos", F.explode(F.sequence(F.lit(1), F.lit(steps - 1))).alias("t"))
    add = lambda f: F.aggregate(F.filter("h", lambda s: s["b"] >= F.col("t")), F.lit(0).cast("long"), lambda a, s: a + s[f])
    x = x.withColumn("tp", add("p")).withColumn("pp", add("n"))
    return x.select(*keys, (F.col("t") / float(steps)).alias("threshold"), "tp", (F.col("pp") - F.col("tp")).alias("fp"), (F.col("pos") - F.col("tp")).alias("fn"), F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("pp") + F.col("pos")), F.lit(0.0)).alias("f1"))


def best_threshold(df: DataFrame, label: str, score: str, keys: list[str] = (), steps: int = 100) -> DataFrame:
    """The least threshold with the greatest F1."""
    x = threshold_counts(df, label, score, keys, steps)
    return x.groupBy(*keys).agg(F.min_by(F.struct("threshold", "f1"), F.struct(-F.col("f1"), F.col("threshold"))).alias("b")).select(*keys, "b.threshold", "b.f1")


def classification(df: DataFrame, label: str, predicted: str, keys: list[str] = ()) -> DataFrame:
    """F1, accuracy and the rates of true and predicted positives."""
    y, p = F.col(label) == 1, F.col(predicted) == 1
    tp, n = F.count_if(y & p), F.count("*")
    return df.groupBy(*keys).agg(n.alias("n"), F.coalesce(F.try_divide(2.0 * tp, F.count_if(y) + F.count_if(p)), F.lit(0.0)).alias("f1"), F.avg((y == p).cast("double")).alias("accuracy"), F.avg(y.cast("double")).alias("positive_rate"), F.avg(p.cast("double")).alias("predicted_rate"))


def ranking(df: DataFrame, group: list[str], label: str, score: str, row_id: str) -> DataFrame:
    """Top-1 accuracy (first row at ties) and mean reciprocal rank of labelled rows."""
    w = W.partitionBy(*group)
    x = df.withColumn("__r", F.rank().over(w.orderBy(F.desc(score)))).withColumn("__k", F.row_number().over(w.orderBy(F.desc(score), row_id)))
    return x.agg(F.avg(F.when(F.col("__k") == 1, (F.col(label) == 1).cast("double"))).alias("top1_accuracy"), F.avg(F.when(F.col(label) == 1, 1.0 / F.col("__r"))).alias("mrr"), F.count_if(F.col("__k") == 1).alias("n_groups"))


def standardised(df: DataFrame, columns: list[str], train: Column | None = None) -> DataFrame:
    """Columns less their mean over their population deviation (1 if 0), both of training rows."""
    t = df.where(train) if train is not None else df
    st = F.broadcast(t.agg(*[F.avg(c).alias(f"__m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"__s_{c}") for c in columns]))
    x = df.join(st)
    sd = lambda c: F.when(F.coalesce(F.col(f"__s_{c}"), F.lit(0.0)) == 0, 1.0).otherwise(F.col(f"__s_{c}"))
    return x.select(*[c for c in df.columns if c not in columns], *[((F.col(c) - F.col(f"__m_{c}")) / sd(c)).alias(c) for c in columns])
