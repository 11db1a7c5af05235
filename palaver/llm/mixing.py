"""Sources mixed to target shares of tokens by Pareto order sampling.

A mix is as large as its scarcest source allows at its cap of repeats. A source's target is so many
whole copies of each document and a fraction, drawn without replacement: documents are ranked by
their random odds divided by the odds of their inclusion, and taken in that order up to the token
target. The ranks are binned, bins below the target are taken whole, and only the one bin in which
the target falls is sorted, so a source with a third of all rows is no single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

RANK_BINS = 4096
WEIGHT_BINS = 16  # for each octave of weight


def tidy(source: Column) -> Column:
    """One spelling of a source: lower case, no outer spaces, ``_`` for spaces and hyphens."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[\s-]+", "_")


def plan(sizes: DataFrame, targets: DataFrame, budget: float | None = None, most: int = 10_000) -> DataFrame:
    """Each mix and source with its target tokens, whole copies and fraction.

    ``sizes`` has source, n_tokens; ``targets`` mix_name, source, target_weight, max_repeats. Weights
    are normalised over the sources that are there; absent ones come out with no tokens. Null,
    negative or zero weights and caps below 1 count as no target. ``budget`` limits a mix's tokens.
    """
    size = sizes.groupBy("source").agg(F.sum("n_tokens").alias("size"), F.count("*").alias("n_docs"))
    want = targets.select("mix_name", tidy(F.col("source")).alias("source"), F.greatest(F.coalesce("target_weight", F.lit(0.0)), F.lit(0.0)).alias("w"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("cap"))
    want = want.groupBy("mix_name", "source").agg(F.sum("w").alias("w"), F.max("cap").alias("max_repeats"))
    if want.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} targets")
    x = want.join(size, "source", "left").fillna(0, ["size", "n_docs"])
    live = (F.col("size") > 0) & (F.col("w") > 0) & (F.col("max_repeats") >= 1)
    m = W.partitionBy("mix_name")
    x = x.withColumn("share", F.when(live, F.col("w") / F.sum(F.when(live, F.col("w"))).over(m)).otherwise(0.0)).withColumn("asked", F.coalesce(F.try_divide(F.col("w"), F.sum("w").over(m)), F.lit(0.0)))
    x = x.withColumn("total", F.min(F.when(live, F.col("max_repeats") * F.col("size") / F.col("share"))).over(m))
    if budget is not None:
        x = x.withColumn("total", F.least("total", F.lit(float(budget))))
    need = F.coalesce(F.col("share") * F.col("total"), F.lit(0.0))
    copies = F.when(F.col("size") > 0, need / F.col("size")).otherwise(0.0)
    whole = F.least(F.floor(copies + 1e-9), F.col("max_repeats")).cast("int")
    return x.select("mix_name", "source", F.col("asked").alias("target_share"), F.col("share").alias("share_of_present"), "max_repeats", "size", "n_docs", need.alias("target_tokens"), whole.alias("whole"), F.greatest(need - whole * F.col("size"), F.lit(0.0)).alias("part_tokens"))


def _uniform(*cols: Column) -> Column:
    return (F.pmod(F.xxhash64(*cols), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def draw(sizes: DataFrame, plans: DataFrame, seed: int = 7) -> DataFrame:
    """mix_name, doc_id, source, n_tokens, repeats of every document that is drawn.

    ``sizes`` has distinct doc_id with source, n_tokens > 0 and weight (inclusion is proportional to
    it up to certainty). The token target of each source is met to half a document. Every document's
    repeats are at most its source's cap.
    """
    b = F.broadcast(plans.where("target_tokens > 0").select("mix_name", "source", "whole", "part_tokens", "max_repeats"))
    x = sizes.join(b, "source")
    # The scale c with sum(tokens * min(1, c * weight)) = part, from a histogram of weights.
    wbin = F.floor(F.log2(F.greatest(F.col("weight"), F.lit(1e-12))) * WEIGHT_BINS)
    hist = x.where("part_tokens > 0").groupBy("mix_name", "source", "part_tokens", wbin.alias("wb")).agg(F.sum("n_tokens").alias("t"), F.sum(F.col("n_tokens") * F.col("weight")).alias("tw"))
    w = W.partitionBy("mix_name", "source").orderBy(F.desc("wb")).rowsBetween(W.unboundedPreceding, -1)
    rest = W.partitionBy("mix_name", "source").orderBy(F.desc("wb")).rowsBetween(0, W.unboundedFollowing)
    sure = F.coalesce(F.sum("t").over(w), F.lit(0))
    c = (F.col("part_tokens") - sure) / F.sum("tw").over(rest)
    # The heaviest bins are certain as long as that leaves a scale at which the next bin is not.
    scale = hist.withColumn("sure", sure).withColumn("c", c).where("c >= 0 and part_tokens >= sure").withColumn("ok", F.col("c") * F.pow(F.lit(2.0), F.col("wb") / WEIGHT_BINS) <= 1.0)
    scale = scale.groupBy("mix_name", "source").agg(F.coalesce(F.min(F.when(F.col("ok"), F.col("c"))), F.max("c")).alias("c"))
    p = x.join(F.broadcast(scale), ["mix_name", "source"], "left").withColumn("pi", F.least(F.coalesce("c", F.lit(0.0)) * F.col("weight"), F.lit(1.0)))
    u = _uniform(F.col("doc_id"), F.col("mix_name"), F.lit(seed))
    # q / (1 + q) of the Pareto rank q = (u / (1 - u)) / (pi / (1 - pi)): the same order, in [0, 1].
    rank = u * (1 - F.col("pi")) / (u * (1 - F.col("pi")) + (1 - u) * F.col("pi"))
    p = p.withColumn("rank", F.when(F.col("pi") >= 1, 0.0).when(F.col("pi") <= 0, 1.0).otherwise(rank)).withColumn("bin", F.least(F.floor(F.col("rank") * RANK_BINS), F.lit(RANK_BINS - 1)))
    sums = p.where("part_tokens > 0").groupBy("mix_name", "source", "part_tokens", "bin").agg(F.sum("n_tokens").alias("t"))
    run = W.partitionBy("mix_name", "source").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    cut = sums.withColumn("before", F.coalesce(F.sum("t").over(run), F.lit(0))).where("before < part_tokens").groupBy("mix_name", "source").agg(F.max("bin").alias("last_bin"), F.max("before").alias("before"))
    y = p.join(F.broadcast(cut), ["mix_name", "source"], "left")
    edge = y.where("bin = last_bin")
    order = W.partitionBy("mix_name", "source").orderBy("rank", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    at = F.col("before") + F.sum("n_tokens").over(order)
    edge = edge.withColumn("extra", (at - F.col("n_tokens") / 2 <= F.col("part_tokens")).cast("int"))
    rows = y.where("bin <> last_bin or last_bin is null").withColumn("extra", F.coalesce((F.col("bin") < F.col("last_bin")).cast("int"), F.lit(0))).unionByName(edge)
    return rows.select("mix_name", "doc_id", "source", "n_tokens", F.least(F.col("whole") + F.col("extra"), F.col("max_repeats")).alias("repeats")).where("repeats > 0")


def shares(drawn: DataFrame, plans: DataFrame) -> DataFrame:
    """Target and actual shares of every mix and source, absent sources included."""
    got = drawn.groupBy("mix_name", "source").agg(F.count("*").alias("n_drawn"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most_repeats"))
    x = plans.join(got, ["mix_name", "source"], "left").fillna(0, ["n_drawn", "tokens", "most_repeats"])
    total = F.sum("tokens").over(W.partitionBy("mix_name"))
    return x.select("mix_name", "source", "target_share", "share_of_present", "max_repeats", "n_docs", "n_drawn", "tokens", "most_repeats", F.when(total > 0, F.col("tokens") / total).otherwise(0.0).alias("actual_share"))
