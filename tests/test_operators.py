"""Operators on small tables with ties, nulls, repeats and empty inputs."""

import itertools
import math
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from palaver.operators import bootstrap as B
from palaver.operators import choice as C
from palaver.operators import events as E
from palaver.operators import graphs as G
from palaver.operators import joins as J
from palaver.operators import labels as L
from palaver.operators import lexicon as LX
from palaver.operators import sets as S
from palaver.operators import stats as T
from palaver.operators import votes as V


def test_three_half_rules(spark):
    df = spark.createDataFrame([("g", i, "AABAB"[i - 1]) for i in range(1, 6)], "g string, i int, p string")
    a = L.positions(df, ["g"], ["i"]).select("i", L.half(F.col("position"), F.col("n")).alias("h"))
    assert [r["h"] for r in a.orderBy("i").collect()] == ["early", "early", "late", "late", "late"]
    b = L.positions(df, ["g", "p"], ["i"]).select("i", L.own_half(F.col("position"), F.col("n")).alias("h"))
    assert [r["h"] for r in b.orderBy("i").collect()] == ["early", "late", "early", "late", "late"]


def test_label_arrays(spark):
    df = spark.createDataFrame([('["A", "B", "A"]',), ("A",), (None,), ("[]",), (" ",), ("[broken",)], "x string")
    got = [r[0] for r in df.select(L.label_array(F.col("x"), "No")).collect()]
    assert got[:5] == [["A", "B"], ["A"], ["No"], ["No"], ["No"]]


def test_votes(spark):
    v = spark.createDataFrame([("u", "A"), ("u", "A"), ("t", "A"), ("t", "A"), ("t", "B"), ("d", "A"), ("d", "B"), ("d", "C"), ("x", "A"), ("x", "A"), ("x", "B"), ("x", "B")], "g string, target string")
    d = V.distribution(v, ["g"])
    m = {r["g"]: r for r in V.majority(d, ["g"]).collect()}
    assert m["u"]["majority"] == "A" and m["u"]["entropy"] == 0 and m["t"]["majority"] == "A" and m["d"]["majority"] is None and m["x"]["majority"] is None
    assert m["d"]["entropy"] == pytest.approx(math.log(3))
    p = {r["g"]: r["winners"] for r in V.plurality(d, ["g"]).collect()}
    assert p == {"u": ["A"], "t": ["A"], "d": ["circle"], "x": ["A", "B"]}
    assert V.majority(V.distribution(v.limit(0), ["g"]), ["g"]).count() == 0


def test_contradictions(spark):
    s = spark.createDataFrame([("a", ["H", "T"]), ("a", ["T"]), ("b", ["V"]), ("b", ["W"]), ("c", ["H", "T"]), ("c", ["T", "V"]), ("c", ["V"]), ("d", ["H"]), ("e", ["H", "H"]), ("e", ["H"])], "p string, roles array<string>")
    got = {r["p"]: r["is_contradiction"] for r in E.self_contradictions(s, ["p"]).collect()}
    assert got == {"a": False, "b": True, "c": True, "e": False}


def test_accusation_totals_drop_whole_relations(spark):
    schema = "items array<struct<line_number:int,relations:array<struct<type:string,accused:array<string>,evidence:string>>>>"
    rows = [([(1, [("w", ["A", "UNKNOWN"], None), ("w", ["A", "B"], None), ("w", ["A"], None)]), (2, []), (3, None), None, (4, [("d", [None, "UNKNOWN"], None)])],), (None,)]
    r = E.accusation_totals(spark.createDataFrame(rows, schema)).first()
    assert (r["instances"], r["no_relation"], r["unknown_relations"], r["instances_lost"], r["accusations"], r["from_group"], r["duplicates"]) == (4, 2, 2, 1, 3, 2, 1)


def test_ordinal_and_as_of(spark):
    p = spark.createDataFrame([("g", 0), ("g", 5), ("g", 9), ("h", 1)], "g string, at int")
    m = spark.createDataFrame([("g", 1, "a"), ("g", 5, "b"), ("g", 5, "b"), ("g", 7, "c")], "g string, r int, v string")
    assert sorted((r["g"], r["at"], r["n"]) for r in E.ordinal_at(p, m, ["g"], "at", "r", "n").collect()) == [("g", 0, 0), ("g", 5, 3), ("g", 9, 4), ("h", 1, 0)]
    assert sorted((r["g"], r["at"], r["v"]) for r in E.as_of(p, m, ["g"], "at", "r", ["v"]).collect()) == [("g", 0, None), ("g", 5, "b"), ("g", 9, "c"), ("h", 1, None)]


def test_strict_join_fails_on_a_missing_key(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x")], "k int, v string")
    assert J.strict(a.where("k = 1"), b, ["k"]).count() == 1
    with pytest.raises(PySparkException):
        J.strict(a, b, ["k"]).collect()


def test_names_that_fall_together_add_up(spark):
    roster = spark.createDataFrame([("g", "Ann"), ("g", "Bo")], "g string, p string")
    src = spark.createDataFrame([("g", "ann ", 2), ("g", "ANN", 3), ("g", "Cy", 9), ("g", None, 1)], "g string, p string, f int")
    assert {r["p"]: r["f"] for r in J.summed_by_name(roster, [src], ["g"], "p", ["f"]).collect()} == {"Ann": 5.0, "Bo": 0.0}


def test_samples_are_stable_and_exact(spark):
    df = spark.range(5000).withColumn("k", F.when(F.col("id") < 4000, "hot").otherwise("cold"))
    a = {r["id"] for r in S.stratified(df, ["k"], "id", 40).collect()}
    b = {r["id"] for r in S.stratified(df.repartition(7), ["k"], "id", 40).collect()}
    assert a == b and len(a) == 80 and sum(i < 4000 for i in a) == 40
    s = S.largest_remainder(spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "k string, w int"), 10, "k", "w")
    assert {r["k"]: r["n"] for r in s.collect()} == {"a": 4, "b": 3, "c": 3}


def test_keep_one(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, "x"), ("b", None, "y")], "k string, o int, v string")
    assert {r["k"]: r["v"] for r in S.keep_one(df, ["k"], [F.col("o")], last=True).collect()} == {"a": "x", "b": "y"}


def test_statistics_against_direct_formulas(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.choice("xyz"), rng.randrange(5), rng.randrange(4)) for _ in range(300)]
    df = spark.createDataFrame([*rows, (None, "x", None, 1)], "a string, b string, u int, v int")
    r = T.chi_square(df, "a", "b").first()
    o = np.array([[sum(x[0] == i and x[1] == j for x in rows) for j in "xyz"] for i in "ab"], float)
    e = np.outer(o.sum(1), o.sum(0)) / o.sum()
    assert r["chi2"] == pytest.approx(((o - e) ** 2 / e).sum()) and r["df"] == 2 and r["min_expected"] == pytest.approx(e.min())

    def ranks(x):
        x = np.array(x, float)
        return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])

    s = T.spearman(df, "u", "v").first()
    assert s["n"] == 300 and s["rho"] == pytest.approx(np.corrcoef(ranks([x[2] for x in rows]), ranks([x[3] for x in rows]))[0, 1])
    lab = spark.createDataFrame([(x[2], int(x[0] == "a")) for x in rows], "s int, y int")
    pos, neg = [x[2] for x in rows if x[0] == "a"], [x[2] for x in rows if x[0] != "a"]
    want = np.mean([(p > q) + 0.5 * (p == q) for p, q in itertools.product(pos, neg)])
    assert T.auc(lab, "y", "s").first()["auc"] == pytest.approx(want)
    assert T.auc(lab.where("y = 1"), "y", "s").first()["auc"] is None


def test_holm(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.9)], "k string, p double")
    got = {r["k"]: r["p_holm"] for r in T.holm(df, "p", ["k"]).collect()}
    assert got == pytest.approx({"a": 0.04, "b": 0.09, "c": 0.09, "d": 0.9})


def test_bootstrap_is_deterministic_and_near_the_normal_interval(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(5, 2, 400)
    df = spark.createDataFrame([(f"k{i}", float(v)) for i, v in enumerate(x)], "k string, v double")
    a, b = B.mean(df, "k", "v", 400).first(), B.mean(df.repartition(3), "k", "v", 400).first()
    assert tuple(a) == pytest.approx(tuple(b))
    half = 1.96 * x.std() / 20
    assert abs(a["lo"] - (x.mean() - half)) < half / 2 and abs(a["hi"] - (x.mean() + half)) < half / 2


def _simulated(spark, n, beta, seed=0, j=4):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(n):
        X = rng.normal(size=(j, len(beta)))
        v = X @ beta
        p = np.exp(v - v.max())
        c = rng.multinomial(3, p / p.sum())
        rows += [(f"g{g}", f"a{i}", int(c[i]), *map(float, X[i])) for i in range(j)]
    cols = [f"f{i}" for i in range(len(beta))]
    return spark.createDataFrame(rows, "g string, a string, n int, " + ", ".join(f"{c} double" for c in cols)), cols


def test_choice_model_recovers_coefficients(spark):
    beta = np.array([1.0, -0.5, 0.0])
    df, cols = _simulated(spark, 700, beta)
    fit = C.fitted(C.choice_sets(df, ["g"], "a", "n", cols), cols)
    assert np.abs(fit["beta"] / fit["sd"] - beta).max() < 0.12
    s = fit["sums"]
    assert np.abs(s.grad[0]).max() < 1e-3 * s.n[0]  # a stationary point
    assert C.wald(fit, ["f0"])[2] < 1e-6 and C.odds_table(fit)[2][5] > 0.001


def test_two_alternatives_equal_a_binary_logit_on_differences(spark):
    df, cols = _simulated(spark, 300, np.array([0.8, -0.4]), seed=2, j=2)
    fit = C.fitted(C.choice_sets(df, ["g"], "a", "n", cols), cols)
    rows = df.toPandas().sort_values(["g", "a"])
    a, b = rows[rows.a == "a0"], rows[rows.a == "a1"]
    X, y, m = (a[cols].to_numpy() - b[cols].to_numpy()), a.n.to_numpy(), (a.n.to_numpy() + b.n.to_numpy())
    w = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-X @ w))
        w += np.linalg.solve((X * (m * p * (1 - p))[:, None]).T @ X, X.T @ (y - m * p))
    assert np.abs(fit["beta"] / fit["sd"] - w).max() < 1e-4


def test_lasso_zeroes_noise(spark):
    df, cols = _simulated(spark, 250, np.array([1.2, 0.0, 0.0]), seed=4)
    sets = C.cut(C.choice_sets(df, ["g"], "a", "n", cols))
    mean, sd = C.moments(sets, 3)
    b, _ = C.solve(sets, 3, [C.Problem(l1=80.0), C.Problem(l1=1e6)], mean, sd)
    assert b[0][0] != 0 and b[0][1] == 0 and b[0][2] == 0 and (b[1] == 0).all()


def test_sets_without_votes_are_left_out(spark):
    df = spark.createDataFrame([("g", "a", 0, 1.0), ("g", "b", 0, 2.0), ("h", "a", 1, None), ("h", "b", None, 2.0)], "g string, a string, n int, f double")
    assert [r["key"] for r in C.choice_sets(df, ["g"], "a", "n", ["f"]).collect()] == ["h"]


def test_groups_are_fitted_apart_in_one_pass(spark):
    a, cols = _simulated(spark, 120, np.array([1.0, -0.5]), seed=5)
    b, _ = _simulated(spark, 120, np.array([-1.0, 0.3]), seed=6)
    both = a.withColumn("m", F.lit("a")).unionByName(b.withColumn("m", F.lit("b")))
    got = C.fitted_by(C.choice_sets(both, ["g"], "a", "n", cols, "m"), cols)
    assert sorted(got) == ["a", "b"]
    for m, df in (("a", a), ("b", b)):
        alone = C.fitted(C.choice_sets(df, ["g"], "a", "n", cols), cols)
        assert np.abs(got[m]["beta"] - alone["beta"]).max() < 1e-5 and got[m]["sums"].n[0] == alone["sums"].n[0]


def test_scores_are_held_out(spark):
    df, cols = _simulated(spark, 40, np.array([0.0, 0.0, 0.0, 0.0, 0.0, 0.0]), seed=8)
    x = C.choice_sets(df, ["g"], "a", "n", cols)
    inside = C.fitted(x, cols)["sums"]
    fit = C.tuned(x, cols, learner="clogit", seeds=(0, 1))
    got = {r["key"]: r["ll"] for r in C.held_out_scores(fit).collect()}
    held = C.held_out(fit)
    # Each set is scored once for each seed, under a fit that has not seen it: noise does not help.
    assert len(got) == 40 and held.n.sum() == 2 * inside.n[0] and held.ll.sum() / held.n.sum() < inside.null[0] / inside.n[0] < inside.ll[0] / inside.n[0]
    assert np.mean(list(got.values())) == pytest.approx(held.ll.sum() / held.n.sum(), abs=1e-9)
    loss = C.permutation_importance(C.tuned(x, cols, penalties=(0.1, 10.0), folds=3, inner=2, seeds=(0,)))
    assert len(loss) == 6 and all(0 <= r[3] <= 1 for r in loss)


def test_rule_hits_break_ties_at_random(spark):
    from palaver.plans.model_queries import rule_hits

    b = spark.createDataFrame([("m", f"g{g}", p, s, n) for g in range(40) for p, s, n in (("x", 1.0, 1), ("y", 1.0, 0), ("z", 0.0, 3))], "model_name string, game_id string, player string, s double, n int")
    assert abs(rule_hits(b, "s").first()["hit_rate"] - 0.125) < 0.02  # x or y, a vote of four for x


def test_model_queries_cover_every_model(spark, monkeypatch):
    import palaver.plans.model_queries as Q

    f = spark.createDataFrame([(g, p, "v", float(i)) for g in ("g1", "g2") for i, p in enumerate("xyz")], "game_id string, player string, end_role string, f double")
    monkeypatch.setattr(Q, "features", lambda s, d: f.select("game_id", "player", *[F.col("f").alias(c) for c in Q.A + Q.BB]))
    v = spark.createDataFrame([("m1", "stochastic", "g1", "x"), ("m2", "stochastic", "g1", "y"), ("m2", "stochastic", "g2", "z"), ("m2", "greedy", "g2", "x")], "model_name string, decoding string, game_id string, target string")
    monkeypatch.setattr(Q, "valid_votes", lambda s, d: v)
    assert sorted((r["group"], r["key"], sum(r["n"]), len(r["alts"])) for r in Q.sets(spark, "", Q.FULL).collect()) == [("m1", "g1", 1.0, 4), ("m2", "g1", 1.0, 4), ("m2", "g2", 1.0, 4)]


def test_lexicon_matchers_differ(spark):
    lex = {"as long as": "C", "as": "T", "if": "C", "even if": "X", "long as it": "Z"}
    df = spark.createDataFrame([("As long as it rains, even if cold, as is.",), (None,), ("",)], "x string")
    got = [[m["marker"] for m in r["m"]] for r in df.select(LX.greedy_matcher(lex)("x").alias("m")).collect()]
    assert got == [["as long as", "even if", "as"], [], []]
    alt = df.select(*[v.alias(k) for k, v in LX.alternation_counts(F.col("x"), lex).items()]).first()
    assert (alt["C"], alt["T"], alt["X"], alt["Z"]) == (1, 1, 1, 0)


def test_graphs(spark):
    e = spark.createDataFrame([("c", 1, "a", "b", "r", "g"), ("c", 2, "b", "c", "r", "g"), ("c", 3, "c", "a", "s", "h"), ("t", 1, "a", "b", "r", "x"), ("t", 2, "a", "b", "r", "x"), ("t", 3, "b", "d", "q", "y"), ("s", 1, "z", "z", "r", ""), ("n", 1, None, "a", "r", None)], "graph string, pos int, source string, target string, relation string, grp string")
    n = spark.createDataFrame([("c", 1, " a", "P", "x"), ("c", 2, "b", "P", ""), ("c", 3, "c", "End", "y"), ("t", 1, "a", "P", "x"), ("t", 2, "a", "P", "x"), ("t", 3, "b", "Bad", "x"), ("s", 1, "z", "P", "q")], "graph string, pos int, id string, role string, text string")
    assert {r["graph"] for r in G.cyclic(e).collect()} == {"c", "s"}
    assert G.cyclic(e.limit(0)).count() == 0
    got = {(r["graph"], r["issue"]) for r in G.issues(n, e, ["P", "End"], ["r", "s"], "End").collect()}
    assert {("c", "cycle"), ("c", "empty_node_text"), ("c", "conclusion_has_outgoing"), ("t", "duplicate_node_id"), ("t", "invalid_role"), ("t", "duplicate_edge"), ("t", "missing_target"), ("t", "invalid_relation"), ("s", "self_edge"), ("s", "edge_without_group"), ("n", "missing_source")} <= got
    x = {(r["graph"], r["grp"]): r for r in G.expected_groups(e).collect()}
    assert x[("c", "g")]["sources"] == ["a", "b"] and x[("c", "g")]["mixes_targets"] and not x[("t", "x")]["mixes_targets"]
    nodes, edges, repairs = G.normalised(n, e)
    assert {r["id"] for r in nodes.where("graph = 'c'").collect()} == {"n1", "n2", "n3"}
    assert {(r["graph"], r["repair"]) for r in repairs.collect()} >= {("c", "outer_whitespace_trimmed"), ("t", "exact_duplicate_node_removed"), ("t", "exact_duplicate_edge_removed")}


def test_cycles_are_exact_on_long_chains_and_large_graphs(spark):
    chain = [("chain", f"v{i}", f"v{i + 1}") for i in range(5_000)]
    loop = [("loop", f"v{i}", f"v{(i + 1) % 700}") for i in range(700)] + [("loop", "v3", "out"), ("loop", "in", "v5")]
    e = spark.createDataFrame(chain + loop, "graph string, source string, target string")
    assert {r["graph"]: r["n_edges_left"] for r in G.cyclic(e).collect()} == {"loop": 700}
    small = [("chain", f"v{i}", f"v{i + 1}") for i in range(24)]
    tied = [("tied", *x) for x in ("ab", "bc", "ca", "cd", "de", "ef", "fd", "xa", "fy")] + [("self", "z", "z"), ("self", "z", "w")]
    f = spark.createDataFrame(small + tied, "graph string, source string, target string")
    want = {r["graph"]: r["n_edges_left"] for r in G.cyclic(f).collect()}
    assert want == {"tied": 7, "self": 1}  # the edge between the two cycles counts
    assert {r["graph"]: r["n_edges_left"] for r in G.cyclic(f, local=3).collect()} == want


def test_large_exact_binomials():
    from palaver.functions.mathx import binomial_two_sided

    exact = lambda k, n: min(1.0, 2 * sum(math.comb(n, i) for i in range(min(k, n - k) + 1)) / 2**n)
    for k, n in ((0, 1001), (450, 1001), (990, 2000), (1500, 3000), (100, 3000)):
        assert math.isclose(binomial_two_sided(k, n), exact(k, n), rel_tol=1e-9)
    assert 0 < binomial_two_sided(499_990_000, 1_000_000_000) < 1


def test_cross_validation_equals_a_plain_reading(spark):
    df, cols = _simulated(spark, 90, np.array([0.9, -0.6, 0.0]), seed=11)
    df = df.withColumn(cols[0], F.col(cols[0]) * F.when(F.col("g") < "g4", 20.0).otherwise(1.0))  # spreads differ between folds
    x = C.choice_sets(df, ["g"], "a", "n", cols)
    rows = [(int(r["h"]), np.array(r["x"]).reshape(-1, 3), np.array(r["n"])) for r in x.collect()]
    lam, folds = 5.0, 3
    at = np.floor(C._uniform(np.array([r[0] for r in rows]), 0) * folds).astype(int)

    def plain(train, held):
        flat = np.concatenate([r[1] for r in train])
        mean, sd = flat.mean(0), flat.std(0)
        b = np.zeros(3)
        for _ in range(60):
            g, h = -lam * b, lam * np.eye(3)
            for _, X, n in train:
                Z = (X - mean) / sd
                q = np.exp(Z @ b - (Z @ b).max())
                q /= q.sum()
                g += (n - n.sum() * q) @ Z
                h += n.sum() * (Z.T @ (q[:, None] * Z) - np.outer(q @ Z, q @ Z))
            b = b + np.clip(np.linalg.solve(h, g), -1, 1)
        ll = n_all = 0.0
        for _, X, n in held:
            v = (X - mean) / sd @ b
            ll += n @ (v - np.log(np.exp(v).sum()))
            n_all += n.sum()
        return ll / n_all

    want = np.mean([plain([r for r, a in zip(rows, at) if a != f], [r for r, a in zip(rows, at) if a == f]) for f in range(folds)])
    got = C.cross_validated(x, cols, [lam], folds=folds, seeds=(0,))
    assert got[0][2] == pytest.approx(want, abs=1e-5)


def test_f1_and_auc_by_replicate_equal_brute_force(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), f"g{rng.randrange(12)}", rng.randrange(2), rng.randrange(2), rng.randrange(100) / 100) for _ in range(400)]
    df = spark.createDataFrame(rows, "m string, g string, y int, p int, s double")
    got = {(r["m"], r["rep"]): r for r in B.f1_auc_draws(df, "g", "m", "y", "p", "s", 5).collect()}
    w = {(r["g"], r["rep"]): r["w"] for r in df.select("g").distinct().crossJoin(spark.range(5).withColumnRenamed("id", "rep")).select("g", "rep", B.weight(F.col("g"), F.col("rep")).alias("w")).collect()}
    for (m, rep), r in got.items():
        x = [(y, p, s, 1 if rep < 0 else w[(g, rep)]) for k, g, y, p, s in rows if k == m]
        tp = sum(c for y, p, _, c in x if y and p)
        assert r["f1"] == pytest.approx(2 * tp / sum(c * (y + p) for y, p, _, c in x))
        pos, neg = [(s, c) for y, _, s, c in x if y], [(s, c) for y, _, s, c in x if not y]
        wins = sum(a * b * ((s > t) + 0.5 * (s == t)) for s, a in pos for t, b in neg)
        assert r["auc"] == pytest.approx(wins / (sum(a for _, a in pos) * sum(b for _, b in neg)))
    out = B.f1_auc_intervals(B.f1_auc_draws(df, "g", "m", "y", "p", "s", 5), "m").collect()
    assert {(r["first"], r["second"], r["metric"]) for r in out} == {(a, b, k) for a, b in (("a", ""), ("b", ""), ("a", "b")) for k in ("f1", "auc")}


def test_ranks_and_splits_in_parts_equal_whole_sorts(spark):
    rng = random.Random(6)
    vals = [rng.choice([0.0, 1e-9 * rng.random(), rng.random() ** 8, 5.0]) for _ in range(500)]
    got = {r["v"]: r["rank"] for r in T.value_ranks(spark.createDataFrame([(v,) for v in vals] + [(None,)], "x double"), "x").collect()}
    order = sorted(vals)
    for v, r in got.items():
        assert r == pytest.approx(order.index(v) + (order.count(v) + 1) / 2)
    df = spark.createDataFrame([(i, rng.choice(["big", "big", "small", None])) for i in range(900)], "i int, k string")
    share = {k: sum(r["split"] == "val" for r in x) / len(x) for k in ("big", "small", None) if (x := [r for r in S.split_by_share(df, ["k"], "i", 0.3).collect() if r["k"] == k])}
    sizes = {k: df.where(F.col("k").eqNullSafe(F.lit(k))).count() for k in share}
    assert all(round(share[k] * n) == round(n * 0.3) for k, n in sizes.items()) and sum(sizes.values()) == 900



def _counted(monkeypatch):
    """The numbers of problems of all evaluations from here on."""
    seen, plain = [], C.evaluate

    def counted(sets, k, problems, *a, **b):
        seen.append(len(problems))
        return plain(sets, k, problems, *a, **b)

    monkeypatch.setattr(C, "evaluate", counted)
    return seen


def test_inner_folds_begin_near_their_fit(spark, monkeypatch):
    df, cols = _simulated(spark, 400, np.array([0.9, -0.6, 0.2]), seed=21)
    x = C.cut(C.choice_sets(df, ["g"], "a", "n", cols))
    seen = _counted(monkeypatch)
    fit = C.tuned(x, cols, seeds=(0, 1, 2))
    tries = 15 * 5 * 3
    # A start at zero takes all problems through every step until the last one is solved.
    assert sum(seen) < 5 * tries and fit["beta"].shape == (15, 3)
    held, sums = C.held_out(fit), C.permuted(fit, (None, 0, 2))
    assert np.allclose(held.ll, sums[0].ll) and sums[1].ll.sum() < held.ll.sum() and not np.allclose(sums[1].ll, sums[2].ll)


def test_half_samples_equal_fits_from_zero(spark, monkeypatch):
    df, cols = _simulated(spark, 200, np.array([0.9, -0.6, 0.1, 0.0]), seed=22)
    x = C.cut(C.choice_sets(df, ["g"], "a", "n", cols))
    mean, sd = C.moments_by(x, 4)
    halves = [C.Problem(l1=12.0, seed=100 + i, half=True, group="") for i in range(40)]
    seen = _counted(monkeypatch)
    near, _ = C.solve(x, 4, halves, mean, sd)
    assert sum(seen) < 4 * len(halves) + 20
    monkeypatch.setattr(C, "_starts", lambda sets, k, problems, *a: np.zeros((len(problems), k)))
    far, _ = C.solve(x, 4, halves, mean, sd)
    assert np.abs(near - far).max() < 1e-5 and ((near != 0) == (far != 0)).all() and (near == 0).any()


def test_stability_in_few_passes_equals_fits_from_zero(spark, monkeypatch):
    one, cols = _simulated(spark, 150, np.array([0.9, -0.6, 0.1, 0.0]), seed=26)
    two, _ = _simulated(spark, 120, np.array([0.0, 0.7, -0.2, 0.4]), seed=27)
    x = C.cut(C.choice_sets(one.withColumn("m", F.lit("a")).unionByName(two.withColumn("m", F.lit("b"))), ["g"], "a", "n", cols, "m"))
    mean, sd = C.moments_by(x, 4)
    seen = _counted(monkeypatch)
    rows = {(r[0], r[1]): r[2:] for r in C.stability(x, cols, 2, samples=30, tries=4)}
    assert len(seen) <= 20  # 27 when each penalty was begun at zero
    monkeypatch.setattr(C, "_starts", lambda sets, k, problems, *a: np.zeros((len(problems), k)))
    for g in "ab":
        at = rows[g, cols[0]][1]
        kept = [(C.solve(x, 4, [C.Problem(l1=at * f, group=g)], mean, sd)[0][0] != 0).sum() for f in (0.95, 1.05)]
        assert kept[0] >= 2 >= kept[1]
        beta, _ = C.solve(x, 4, [C.Problem(l1=at, seed=100 + i, half=True, group=g) for i in range(30)], mean, sd)
        assert [rows[g, f][0] for f in cols] == (beta != 0).mean(0).tolist()


def test_packed_sets_give_the_same_sums(spark):
    df, cols = _simulated(spark, 60, np.array([0.8, -0.4, 0.1]), seed=28)
    df = df.where("not (g < 'g3' and a = 'a0')").withColumn("m", F.when(F.col("g") < "g2", "a").otherwise("b"))
    x = C.choice_sets(df, ["g"], "a", "n", cols, "m")
    y = C.cut(C.packed(x, 3))
    assert y.count() < x.count()
    (mean, sd), (mean2, sd2) = C.moments_by(x, 3), C.moments_by(y, 3)
    assert all(np.allclose(mean[g], mean2[g]) and np.allclose(sd[g], sd2[g]) for g in "ab")
    problems = [C.Problem(l1=1.0, seed=s, half=True, group=g) for g in "ab" for s in range(5)]
    beta = np.random.default_rng(0).normal(size=(10, 3))
    a, b = C.evaluate(x, 3, problems, beta, mean, sd), C.evaluate(y, 3, problems, beta, mean, sd)
    assert all(np.allclose(getattr(a, f), getattr(b, f)) for f in ("ll", "grad", "hess", "n"))
    h = np.array([r["h"] for r in x.collect()])
    cells = [replace(q, group=None) for q in problems]
    assert (C._weights(cells, h) == np.stack([q.weights(h, h) for q in cells])).all()


def test_sets_gathered_by_key_equal_those_of_ballots(spark):
    rng = random.Random(7)
    seats = [(f"g{g}", p, rng.choice([None, 0.5, 2.0]), float(g)) for g in range(8) for p in ("x", "y", "z", "x", None)[: rng.randrange(2, 6)]]
    votes = [(m, f"g{g}", p, rng.randrange(4)) for m in ("a", None) for g in range(9) for p in ("x", "z", "nobody", "stranger") if rng.random() < 0.6]
    f = spark.createDataFrame(seats, "g string, a string, f0 double, f1 double")
    v = spark.createDataFrame(votes, "m string, g string, a string, n long").withColumn("m", F.coalesce("m", F.lit("")))
    b = f.unionByName(f.select("g").distinct().select("g", F.lit("nobody").alias("a"), F.lit(0.0).alias("f0"), F.lit(1.0).alias("f1")))
    b = v.select("m", "g").distinct().join(b, "g").join(v, ["m", "g", "a"], "left")
    want, got = C.choice_sets(b, ["g"], "a", "n", ["f0", "f1"], "m"), C.sets_by_key(f, v, "g", "a", "n", ["f0", "f1"], "m", {"nobody": [0.0, 1.0]})
    assert want.dtypes == got.dtypes and want.count() > 8
    assert sorted(map(repr, want.collect())) == sorted(map(repr, got.collect()))


def test_accused_equals_the_joined_accusations(spark, tmp_path):
    from palaver.plans.event_queries import accusations, accused

    items = "array<struct<line_number: int, accuser: string, relations: array<struct<type: string, accused: array<string>, evidence: string>>>>"
    one = [(3, "A", [("werewolf", ["B", " ", None, "C"], "e"), None, (None, ["B"], None), ("deception", None, None), ("other", [], None)])]
    rows = [(1, "g1", one, 2), (1, "g1", [], 3), (2, "g2", [None, (4, None, None), (5, "B", [("werewolf", ["UNKNOWN", "A", "A"], None)])], 1), (3, None, one, 1), (None, "g4", one, 1), (5, "g5", None, 1)]
    df = spark.createDataFrame(rows, f"record_id bigint, game_id string, items {items}, at int")
    df.select("record_id", "game_id", F.struct(F.lit("m").alias("source_file")).alias("metadata"), "items", F.timestamp_seconds("at").alias("loaded_at")).write.parquet(f"{tmp_path}/accusation_records.parquet")
    want, got = accusations(spark, str(tmp_path)).select("game_id", "type", "accused"), accused(spark, str(tmp_path))
    assert got.count() == 9 and sorted(map(repr, want.collect())) == sorted(map(repr, got.collect()))


def test_a_feature_that_training_sets_leave_open_stays_at_zero(spark):
    df, cols = _simulated(spark, 120, np.array([0.8, 0.5]), seed=23)
    x = C.choice_sets(df, ["g"], "a", "n", cols)
    mean, sd = C.moments_by(x, 2)
    parts = [C.Problem(l2=1.0, folds=3, fold=f, seed=s, group="") for s in range(4) for f in range(3)]
    at = {r["key"]: np.floor(C._uniform(np.array([r["h"]]), 0)[0] * 3) for r in x.collect()}
    only = F.col("g").isin([k for k, f in at.items() if f == 0])  # f1 varies in fold 0 of seed 0 alone
    y = C.choice_sets(df.withColumn("f1", F.when(only, F.col("f1")).otherwise(0.5)), ["g"], "a", "n", cols)
    mean, sd = C.moments_by(y, 2)
    beta, _ = C.solve(y, 2, parts, mean, sd, (1,))
    assert beta[0, 1] == 0 and np.abs(beta[1:, 1]).min() > 0.01


def test_cross_validation_reads_one_checkpoint(spark, monkeypatch):
    import palaver.plans.model_queries as Q

    df, _ = _simulated(spark, 25, np.array([0.8, -0.4]), seed=24)
    x = C.choice_sets(df.withColumns({c: F.col("f0") if i else F.col("f1") for i, c in enumerate(Q.FULL)}), ["g"], "a", "n", Q.FULL)
    cuts = []
    monkeypatch.setattr(Q, "sets", lambda *a: x)
    for where in (Q, C):
        monkeypatch.setattr(where, "cut", lambda f, plain=C.cut: cuts.append(f) or plain(f))
    rows = Q.m12(spark, "").collect()
    assert len(cuts) == 1 and sorted(str(r["penalty"]) for r in rows) == ["0.01", "0.1", "1.0", "10.0", "100.0", "None"]


def test_rules_draw_ties_only_and_as_before(spark):
    from palaver.functions.keys import hash_rank
    from palaver.plans.model_queries import rule_hits

    rng = random.Random(5)
    b = spark.createDataFrame([(m, f"g{g}", p, float(rng.randrange(3)), rng.randrange(3)) for m in "ab" for g in range(30) for p in "wxyz"], "model_name string, game_id string, player string, s double, n int")
    x = b.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(25))))
    best = F.struct("s", hash_rank(F.col("model_name"), F.col("game_id"), F.col("player"), F.col("draw")).alias("h"))
    top = x.groupBy("model_name", "game_id", "draw").agg(F.max_by("n", best).alias("hit"), F.sum("n").alias("n")).where("n > 0")
    want = {r[0]: r[1] for r in top.groupBy("model_name").agg(F.sum("hit") / F.sum("n")).collect()}
    got = rule_hits(b, "s")
    assert {r[0]: pytest.approx(r[1], abs=1e-12) for r in got.collect()} == want
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_sets_with_some_features(spark):
    df, cols = _simulated(spark, 20, np.array([0.8, -0.4, 0.1]), seed=25)
    part = C.with_features(C.choice_sets(df, ["g"], "a", "n", cols), cols, ["f2", "f0"])
    want = C.choice_sets(df, ["g"], "a", "n", ["f2", "f0"])
    assert sorted((r["key"], r["x"], r["n"]) for r in part.collect()) == sorted((r["key"], r["x"], r["n"]) for r in want.collect())


def test_bootstrap_of_scores(spark):
    from palaver.operators import bootstrap as B

    rng = np.random.default_rng(3)
    rows = [(m, f"k{i}", float(a), float(a + d)) for m, s in (("m1", 0.0), ("m2", 0.3)) for i, (a, d) in enumerate(zip(rng.normal(size=300), rng.normal(s, 1, 300)))]
    x = spark.createDataFrame(rows, "group string, key string, a double, b double")
    got = {r["model_name"]: r for r in C.score_bootstrap(x, [("a", "b")], 2000).collect()}
    for r in B.paired(x, "key", "b", "a", 2000, by=["group"]).collect():
        g = got[r["group"]]
        assert g["comparison"] == "b - a" and g["difference"] == pytest.approx(r["difference"]) and (g["n"], g["n_draws"]) == (300, r["n_draws"])
        assert abs(g["lo"] - r["lo"]) < 0.02 and abs(g["hi"] - r["hi"]) < 0.02
    assert C.score_bootstrap(x.limit(0), [("a", "b")], 10).count() == 0
