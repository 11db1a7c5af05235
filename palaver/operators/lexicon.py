"""Lexicon matching and rates."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from palaver.functions.text import alternation, word_count

MATCHES = "array<struct<marker:string,category:string,start:int,end:int>>"


def greedy_matcher(lexicon: dict[str, str]):
    """A pandas UDF with the non-overlapping matches of a text, longest first over the whole text.

    Candidates of all markers are ordered by length, then place; each is kept unless it overlaps a
    kept one. One compiled alternation finds the candidates of each word count, so a text is read
    once for each phrase length and not once for each marker.
    """
    by_words: dict[int, list[str]] = {}
    for m in lexicon:
        by_words.setdefault(len(m.split()), []).append(m)
    compiled = [re.compile(r"(?<!\w)(?=(" + "|".join(r"\s+".join(map(re.escape, m.split())) for m in sorted(ms, key=lambda m: (-len(m), m))) + r")(?!\w))", re.I) for _, ms in sorted(by_words.items())]

    def one(text: str | None) -> list:
        if not text:
            return []
        found = [(m.start(1), m.end(1), m[1]) for p in compiled for m in p.finditer(text)]
        kept: list[tuple[int, int, str]] = []
        taken = bytearray(len(text))
        for s, e, t in sorted(found, key=lambda x: (x[0] - x[1], x[0])):
            if not any(taken[s:e]):
                taken[s:e] = b"\x01" * (e - s)
                kept.append((s, e, t))
        rows = []
        for s, e, t in sorted(kept):
            marker = " ".join(t.lower().split())
            rows.append({"marker": marker, "category": lexicon.get(marker), "start": s, "end": e})
        return rows

    @F.pandas_udf(MATCHES)
    def match(x: pd.Series) -> pd.Series:
        return x.map(one)

    return match


def alternation_counts(text: Column, lexicon: dict[str, str]) -> dict[str, Column]:
    """Matches of each category by one left-to-right alternation (X03), all in column functions."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(alternation(list(lexicon))), F.lit(1)), lambda w: F.regexp_replace(F.lower(w), r"\s+", " "))

    def hits(category: str) -> Column:
        return F.size(F.filter(found, lambda w: w.isin(*[m for m, k in lexicon.items() if k == category])))

    return {c: hits(c) for c in sorted(set(lexicon.values()))}


def rates(df: DataFrame, row_id: str, text: str, lexicon: dict[str, str]) -> DataFrame:
    """Each row's matches, words, and matches per hundred words by category in long form."""
    m = df.select(row_id, word_count(F.col(text)).alias("n_words"), greedy_matcher(lexicon)(F.col(text)).alias("m"))
    cats = sorted(set(lexicon.values()))

    def hits(category: str) -> Column:
        return F.size(F.filter("m", lambda x: x["category"] == category))

    per = F.array(*[F.struct(F.lit(c).alias("category"), hits(c).alias("n_matches")) for c in cats])
    return m.select(row_id, "n_words", F.explode(per).alias("p")).select(row_id, "n_words", "p.category", "p.n_matches", F.try_divide(F.col("p.n_matches") * 100.0, F.col("n_words")).alias("per_100"))


def usage(hits: DataFrame, totals: DataFrame, run: list[str], group: list[str], item: str, n: str, words: str) -> DataFrame:
    """Frequency and coverage of an item by run, then mean and deviation over runs.

    ``hits``: run, group, item, n, covered (0/1) for rows with the item; ``totals``: run, group,
    n_rows, words. A run without an item counts as 0; the deviation of one run is null.
    """
    items = hits.select(item).distinct()
    full = totals.crossJoin(F.broadcast(items))
    g = hits.groupBy(*run, *group, item).agg(F.sum(n).alias("__n"), F.sum("covered").alias("__c"))
    x = full.join(g, [*run, *group, item], "left").fillna(0, ["__n", "__c"])
    x = x.withColumn("rate", F.col("__n") * 100.0 / F.col(words)).withColumn("coverage", F.col("__c") / F.col("n_rows"))
    return x.groupBy(*group, item).agg(F.count("*").alias("n_runs"), F.avg("rate").alias("mean_rate"), F.stddev_samp("rate").alias("sd_rate"), F.avg("coverage").alias("mean_coverage"))


def assigned_category(entries: DataFrame, marker: str, category: str, frequency: str) -> DataFrame:
    """One category for each marker: the most frequent, else with most entries, ties by name.

    ``sum`` of no frequency at all is null, not 0 (A32), and then entries decide.
    """
    g = entries.groupBy(marker, category).agg(F.sum(frequency).alias("f"), F.count("*").alias("n"))
    any_f = F.max(F.col("f").isNotNull()).over(W.partitionBy(marker))
    x = g.withColumn("score", F.when(any_f, F.coalesce("f", F.lit(0))).otherwise(F.col("n")).cast("double"))
    w = W.partitionBy(marker)
    x = x.withColumn("k", F.row_number().over(w.orderBy(F.desc("score"), category))).withColumn("share", F.try_divide("score", F.sum("score").over(w))).withColumn("top", F.max("score").over(w))
    tie = F.count_if(F.col("score") == F.col("top")).over(w) > 1
    return x.withColumn("is_tie", tie).where("k = 1").select(marker, category, "score", F.col("share").alias("dominance_share"), "is_tie")


def between(matches: Column, text: Column, a: str, b: str) -> Column:
    """Whether a match lies between two mentions (X05): ``a`` and ``b`` are patterns of one group."""
    first = F.least(F.when(F.regexp_instr(text, F.lit(a)) > 0, F.regexp_instr(text, F.lit(a))), F.when(F.regexp_instr(text, F.lit(b)) > 0, F.regexp_instr(text, F.lit(b))))
    last = F.greatest(F.regexp_instr(text, F.lit(a)), F.regexp_instr(text, F.lit(b)))
    both = (F.regexp_instr(text, F.lit(a)) > 0) & (F.regexp_instr(text, F.lit(b)) > 0)
    return F.coalesce(both & F.exists(matches, lambda m: (m["start"] + 1 > first) & (m["end"] < last)), F.lit(False))


def attribution(mentioned: Column, start: Column, end: Column) -> Column:
    """both, end_only, start_only, neither or no_mention of a swapped player's roles."""
    s, e = F.coalesce(F.array_contains(mentioned, start), F.lit(False)), F.coalesce(F.array_contains(mentioned, end), F.lit(False))
    return F.when(F.size(mentioned) == 0, "no_mention").when(s & e, "both").when(e, "end_only").when(s, "start_only").otherwise("neither")
