"""Truncated texts: JSON states, endings, censored fits."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from palaver.llm import truncation as T

V = "table_name string, row_id long, grp string, text string, at_cap boolean, other string"


@pytest.mark.parametrize("text,state", [
    ('{"a": "x", "b": 1}', "closed"), ('```json\n{"a": "x"}\n```', "closed"), ('{"a": "x {", "b": "}"', "open"), ('"a": "x", "b": "y"}', "closed"), ('"a": "x", "b', "open"),
    ('Answer: {"a": "x\\"y"} Done.', "closed"), ('{"a": "x\\', "open"), ("```json\n{", "open"), ("plain text", None), ("", None), ("{}", "closed"),
])
def test_json_state(spark, text, state):
    assert spark.createDataFrame([(text,)], "t string").select(T.json_state(F.col("t")).alias("s")).first()["s"] == state


def _corpus():
    out = []
    for i in range(200):
        n = ["Ann", "Bob", "Cyd", "Dee"][i % 4]
        out.append(f"The story of {n} does not hold and the others know it well. " * (1 + i % 3) + f"Therefore my vote goes to {n}" + ("" if i % 10 == 0 else "."))
    return out


def test_prose_endings(spark):
    base = _corpus()
    cut = ["The story of Ann does not hold and the oth", "The story of Bob does not hold and the", "The story of Cyd does not hold. Therefore my vote goes to De", "The story of Ann does not hold…", "The story of Bob does not [truncated]", "The story of Bob does n\\u00"]
    rows = [("t", i, "s", x, None, None) for i, x in enumerate(base + cut)] + [("t", 900, "s", "null", None, None), ("t", 901, "s", "```json\n```", None, None), ("t", 902, "s", "the others know who it is", None, "Do the others know who it is?"), ("t", 903, "s", None, None, None), ("t", 904, "s", " \n", None, None)]
    p = {r["row_id"]: r["posterior"] for r in T.posteriors(T.endings(spark.createDataFrame(rows, V))).collect()}
    assert {i for i, v in p.items() if v > 0.5} == set(range(len(base), len(base) + len(cut)))
    assert 903 not in p and 904 not in p


ENDS = "table_name string, row_id long, grp string, n_chars long, at_cap boolean, sign int"


@pytest.mark.parametrize("limit", [300, 8192, 65_535])
def test_limit_is_found_and_censoring_fitted(spark, limit):
    rng = np.random.default_rng(0)
    full = np.exp(rng.normal(math.log(limit) - 0.2, 0.5, 3000))
    lengths, cut = np.minimum(full, limit).astype(int), full > limit
    mu, sd = T.fit_censored(*map(np.array, zip(*[(x, (~cut & (lengths == x)).sum(), (cut & (lengths == x)).sum()) for x in np.unique(lengths)])))
    assert abs(mu - math.log(limit) + 0.2) < 0.03 and abs(sd - 0.5) < 0.03
    ends = spark.createDataFrame([("t", i, "s", int(n), False, T._AT["open" if c else "closed"]) for i, (n, c) in enumerate(zip(lengths, cut))], ENDS)
    f = T.fits(ends).collect()
    assert [r["bin"] for r in f if r["bin"]] == [limit] and f[1]["prior"] > 0.95
    assert abs(f[0]["mu"] - mu) < 0.05 and f[0]["n_cut"] == pytest.approx(cut.sum(), abs=2)


def test_limit_decides_an_ambiguous_ending(spark):
    rng = np.random.default_rng(1)
    full = np.exp(rng.normal(5.2, 0.5, 4000)).astype(int)
    limit = 250
    rows = [("t", i, "s", int(min(n, limit)), False, T._AT["stop" if n <= limit else "torn_word"]) for i, n in enumerate(full)]
    rows += [("t", 10_000, "s", limit, False, T._AT["even"]), ("t", 10_001, "s", limit - 13, False, T._AT["even"]), ("t", 10_002, "s", limit, False, T._AT["stop"]), ("t", 10_003, "s", limit, False, T._AT["usual"])]
    # Another source without the limit: the same ending at the same length is whole there.
    rows += [("t", 20_000 + i, "o", int(n), False, T._AT["stop"]) for i, n in enumerate(full)] + [("t", 10_004, "o", limit, False, T._AT["even"])]
    p = {r["row_id"]: r for r in T.posteriors(spark.createDataFrame(rows, ENDS)).where("row_id between 10000 and 10004").collect()}
    assert {i: r["posterior"] > 0.5 for i, r in p.items()} == {10_000: True, 10_001: False, 10_002: False, 10_003: False, 10_004: False}
    assert p[10_000]["prior"] > 0.9 > 0.1 > p[10_001]["prior"]


def test_token_cap_is_a_limit(spark):
    rows = [("t", i, "s", 200 + i % 40, i % 5 == 0, T._AT["torn_word" if i % 5 == 0 and i % 10 else "stop"]) for i in range(2000)]
    rows += [("t", 9000, "s", 215, True, T._AT["even"]), ("t", 9001, "s", 215, False, T._AT["even"])]
    p = {r["row_id"]: r["posterior"] for r in T.posteriors(spark.createDataFrame(rows, ENDS)).where("row_id >= 9000").collect()}
    assert p[9000] > 0.5 > p[9001]


def test_bins_are_bounded(spark):
    df = spark.createDataFrame([(i,) for i in (1, 4096, 4097, 10**6, 10**9)], "n long").select(T.length_bin(F.col("n")).alias("b"))
    b = [r["b"] for r in df.collect()]
    assert b[:2] == [1, 4096] and all(0.98 < x / n <= 1.001 for x, n in zip(b, (1, 4096, 4097, 10**6, 10**9)))


def test_empty_and_very_long(spark):
    assert T.posteriors(T.endings(spark.createDataFrame([], V))).count() == 0
    long = "word " * 50_000
    r = T.posteriors(T.endings(spark.createDataFrame([("t", 1, None, long + "end.", None, None), ("t", 2, "s", '{"a": "' + long, True, None)], V))).collect()
    assert {x["row_id"]: x["posterior"] > 0.5 for x in r} == {1: False, 2: True} and math.isfinite(r[0]["log_lr"])
