"""Schema drift against a plain reading of the definition."""

import json
import random

import numpy as np
import pytest
from brute_drift import brute_changes

from pyspark.sql import functions as F

from palaver.operators.drift import best_matching, changes, likeness, profile, shown, steady_names, unify

SCHEMA = "run_dir string, file_seq int, record string, record_no long"


def _found(spark, rows):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], SCHEMA)
    files = df.selectExpr("run_dir as run", "file_seq as seq").distinct()
    prof = profile(df, "run_dir", "file_seq", "record")
    return {(r["run"], r["seq"], r["path"], r["kind"], r["former"]) for r in changes(prof, files).collect()}


def _records(rng, n=60):
    rows = []
    for run in ("a", "b"):
        names = {"x": 1, "y": "t", "o": {"p": 1, "q": [{"r": "s"}]}, "z": True}
        for seq in range(1, 9):
            if rng.random() < 0.4:
                names.pop(rng.choice(list(names)), None)
            if rng.random() < 0.4:
                names[f"f{rng.randrange(9)}"] = rng.choice([1, "t", True, [1], {"k": None}])
            if rng.random() < 0.3:
                k = rng.choice(list(names) or ["x"])
                names[k] = rng.choice([1, "t", None])
            for _ in range(n // 16):
                rows.append((run, seq, json.dumps(names)))
        rows.append((run, 3, '{"broken": '))
        rows.append((run, 4, None))
        rows.append((run, 5, "[1, 2]"))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_changes_match_brute_force_but_for_the_choice_of_pairs(spark, seed):
    rows = _records(random.Random(seed))
    got, want = _found(spark, rows), brute_changes(rows)
    kinds = lambda s: sorted((r, q, p.rpartition(".")[0], k) for r, q, p, k, _ in s)
    assert kinds(got) == kinds(want)
    assert {g for g in got if g[3] == "retyped"} == {w for w in want if w[3] == "retyped"}


def test_likeness_decides_between_candidates(spark):
    rows = [("r", 1, '{"line_number": 5, "score": 1}'), ("r", 2, '{"lineNumber": 5, "weight": 9}')]
    got = _found(spark, rows)
    assert ("r", 2, "lineNumber", "renamed", "line_number") in got and ("r", 2, "weight", "renamed", "score") in got


def test_nothing_is_reported_below_a_change(spark):
    rows = [("r", 1, '{"o": {"a": 1, "b": 2}}'), ("r", 2, '{"u": {"a": 1, "c": 2}}'), ("r", 3, '{"u": "text"}')]
    assert _found(spark, rows) == {("r", 2, "u", "renamed", "o"), ("r", 3, "u", "retyped", "")}


def test_empty_table_and_broken_files(spark):
    assert _found(spark, []) == set()
    assert _found(spark, [("r", 1, "x"), ("r", 2, '{"a": 1}'), ("r", 3, "")]) == {("r", 2, "a", "added", ""), ("r", 3, "a", "removed", "")}


def test_matching_is_optimal():
    rng = np.random.default_rng(0)
    from itertools import permutations

    for _ in range(20):
        n, m = int(rng.integers(1, 5)), int(rng.integers(1, 5))
        w = rng.random((n, m))
        best = max(sum(w[i, j] for i, j in zip(range(n), p)) if n <= m else sum(w[j, i] for i, j in zip(range(m), p)) for p in permutations(range(max(n, m)), min(n, m)))
        assert abs(sum(w[i, j] for i, j in best_matching(w)) - best) < 1e-9


def test_unify_gives_steady_columns(spark):
    rows = [("r", 1, '{"line_number": 1, "o": {"why_text": "a"}}'), ("r", 2, '{"lineNumber": 2, "o": {"why_txt": "b"}}'), ("r", 3, '{"lineNumber": null, "record_no": 7}'), ("r", 3, "broken")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], SCHEMA)
    prof = profile(df, "run_dir", "file_seq", "record")
    names = steady_names(prof, changes(prof, df.selectExpr("run_dir as run", "file_seq as seq").distinct()))
    out = unify(df, "record", ["record_no"], names, prof)
    got = {r["record_no"]: r for r in out.collect()}
    col = next(c for c in out.columns if c.lower().startswith("line"))
    assert len(got) == 3 and got[0][col] == 1.0 and got[1][col] == 2.0 and got[2][col] is None
    assert got[2]["record_no_value"] == 7.0 and json.loads(got[0]["o"]).keys() == json.loads(got[1]["o"]).keys()


def _unified(spark, rows):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], SCHEMA)
    prof = profile(df, "run_dir", "file_seq", "record")
    names = steady_names(prof, changes(prof, df.selectExpr("run_dir as run", "file_seq as seq").distinct()))
    return names, {r["record_no"]: r for r in unify(df, "record", ["record_no"], names, prof).collect()}


def test_unlike_names_of_one_field_are_unified(spark):
    rows = [("r", 1, '{"evidence": "a", "o": {"justification": "p"}}'), ("r", 2, '{"evidence": "b", "o": {"justification": "q"}}'), ("r", 3, '{"quote": "c", "o": {"why": "s"}}')]
    names, got = _unified(spark, rows)
    assert names["quote"] == "evidence" and names["o.why"] == "o.justification"
    assert [got[i]["evidence"] for i in range(3)] == ["a", "b", "c"] and json.loads(got[2]["o"]) == {"justification": "s"}


def test_names_side_by_side_in_a_file_keep_both_values(spark):
    rows = [("r", 1, '{"evidence": "a"}'), ("r", 2, '{"quote": "b"}'), ("s", 1, '{"evidence": "c", "quote": "d"}'), ("r", 3, '{"span": "e"}')]
    _, got = _unified(spark, rows)
    assert (got[2]["evidence"], got[2]["quote"]) == ("c", "d")


def test_likeness_bounds():
    assert likeness("line_number", "lineNumber", [1], [1]) == pytest.approx(1.0)
    assert likeness("a", "zz", [1], [2]) < 0.2


def test_unify_loses_no_value(spark):
    import json

    big = 9007199254740993
    rows = [
        (1, "r", 1, '{"old_name": "a", "n": 1, "x": 0.5, "deep": {"old": 1}, "h": 5}'), (2, "r", 1, '{"old_name": "b", "n": %d, "x": 2, "deep": {"old": 2}, "h": 6}' % big),
        (3, "r", 2, '{"new_name": "a", "n": 3, "x": 7, "deep": {"new": 3}, "h": %s}' % ("9" * 400)),
        (4, "r", 3, '{"old_name": "LOST?", "new_name": "x1", "n": null, "x": %d, "deep": {"new": 4, "old": 5}, "a.b": "dot", "a": {"b": "nested"}, "h": 7}' % big),
        (5, "r", 3, '{"old_name": "same", "new_name": "same", "n": 4, "x": 1.5, "deep": {"new": null, "old": 6}, "h": 8}'),
    ]
    df = spark.createDataFrame(rows, "record_no long, run_dir string, file_seq int, record string")
    prof = profile(df, "run_dir", "file_seq", "record")
    # Told by hand, as file 3 holds both spellings side by side.
    names = {p: p for p in (r["path"] for r in prof.collect()) if p} | {"old_name": "new_name", "deep.old": "deep.new"}
    out = unify(df, "record", ["record_no"], names, prof)
    got = {r["record_no"]: r.asDict() for r in out.collect()}
    types = dict(out.dtypes)
    assert types["n"] == "bigint" and types["h"] == "string" and types["x"] == "string" and got[2]["n"] == big
    assert json.loads(got[4]["x"]) == big and json.loads(got[1]["x"]) == 0.5 and json.loads(got[3]["h"]) == int("9" * 400)
    # The first spelling in the record counts, the other is kept beside it.
    assert got[4]["new_name"] == "LOST?" and json.loads(got[4]["other_values"]) == {"new_name": ["x1"], "deep.old": [5]}
    assert got[5]["new_name"] == "same" and got[5]["other_values"] is None and json.loads(got[5]["deep"]) == {"new": 6}
    # A dot within a name does not collide with a nested field.
    assert got[4]["a%2Eb"] == "dot" and json.loads(got[4]["a"]) == {"b": "nested"}

    def values(node):
        return [x for v in (node.values() if isinstance(node, dict) else node) for x in values(v)] if isinstance(node, (dict, list)) else [] if node is None else [node]

    def back(v):
        try:
            return values(json.loads(v))
        except (TypeError, ValueError):
            return [v]

    for r in rows:
        kept = [x for k, v in got[r[0]].items() if k != "record_no" and v is not None for x in back(v)]
        assert set(map(str, values(json.loads(r[3])))) == set(map(str, kept))


def test_dotted_names_in_changes(spark):
    rows = [(1, "r", 1, '{"a": {"b": 1}}'), (2, "r", 2, '{"a": {"b": 1}, "a.b": "x"}'), (3, "r", 3, '{"a": {"b": 1}, "a.b": "x", "c": 0.5}')]
    df = spark.createDataFrame(rows, "record_no long, run_dir string, file_seq int, record string")
    prof = profile(df, "run_dir", "file_seq", "record")
    got = {(r["seq"], r["shown"], r["kind"]) for r in changes(prof, df.selectExpr("run_dir as run", "file_seq as seq").distinct()).select("seq", shown(F.col("path")).alias("shown"), "kind").collect()}
    assert got == {(2, "a.b", "added"), (3, "c", "added")}

