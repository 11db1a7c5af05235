"""Nested records: positions, nulls, blanks, empties, clashing names."""

from palaver.operators.shred import Level, leaves, shred, subtype, subtypes, variants, write_subtypes

SCHEMA = "record_id long, extra string, items array<struct<item_no:int,n:int,relations:array<struct<type:string,accused:array<string>>>>>"
LEVELS = [Level("items", "items", "item_no"), Level("relations", "relations", "relation_no"), Level("accused", "accused", "accused_no")]
ROWS = [
    (1, "a", [(9, 1, [("w", ["A", None, " ", "B"]), None, ("d", [])]), None, (8, None, None), (7, 2, [])]),
    (2, "b", None), (3, "c", []), (4, None, [None]), (5, "", [(1, 1, [(None, None), ("x", ["", "\t", "Z"])])]),
]


def _brute(rows):
    out = set()
    for rid, _, items in rows:
        its = [(i, x) for i, x in enumerate(items or [], 1) if x is not None]
        if not its:
            out.add((rid, 0, 0, 0))
        for i, it in its:
            rels = [(j, x) for j, x in enumerate(it[2] or [], 1) if x is not None]
            if not rels:
                out.add((rid, i, 0, 0))
            for j, r in rels:
                acc = [k for k, a in enumerate(r[1] or [], 1) if a and a.strip()]
                out |= {(rid, i, j, k) for k in acc} or {(rid, i, j, 0)}
    return out


def test_leaves_match_brute_force(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = [tuple(r) for r in leaves(df, "record_id", LEVELS).collect()]
    assert len(got) == len(set(got)) and set(got) == _brute(ROWS)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert leaves(df, "record_id", LEVELS).count() == 0
    assert all(t.count() == 0 for t in shred(df, "record_id", "records", LEVELS).values())


def test_flat_tables_keep_parents_and_round_trip(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    t = shred(df, "record_id", "records", LEVELS)
    assert t["records"].count() == 5
    items = {(r["record_id"], r["item_no"]): r for r in t["items"].collect()}
    assert items[(1, 1)]["item_no_value"] == 9 and items[(1, 1)]["n_children"] == 2  # the clashing field keeps its value
    assert set(items) == {(1, 1), (1, 3), (1, 4), (5, 1)}
    rel = {(r["record_id"], r["item_no"], r["relation_no"]) for r in t["relations"].collect()}
    assert all(k[:2] in items for k in rel)
    acc = {(r["record_id"], r["item_no"], r["relation_no"], r["accused_no"]): r["value"] for r in t["accused"].collect()}
    assert acc == {(1, 1, 1, 1): "A", (1, 1, 1, 4): "B", (5, 1, 2, 3): "Z"}


def test_variants_route_to_subtypes(spark):
    t = shred(spark.createDataFrame(ROWS, SCHEMA), "record_id", "records", LEVELS)
    assert sum(r["n_rows"] for r in variants(t).collect()) == sum(x.count() for x in t.values())
    v = [r["variant"] for r in t["relations"].select("variant").distinct().collect()]
    cols = {x: subtype(t["relations"], x, ["record_id", "item_no", "relation_no"]).columns for x in v}
    assert any("type" not in c for c in cols.values()) and any("type" in c for c in cols.values())
    assert sum(subtype(t["relations"], x, ["record_id"]).count() for x in v) == t["relations"].count()


def test_states_of_children_reach_the_parent(spark):
    t = shred(spark.createDataFrame(ROWS, SCHEMA), "record_id", "records", LEVELS)
    root = {r["record_id"]: (r["variant"], r["class"]) for r in t["records"].collect()}
    # Record 1: one item with a full and a childless relation (p), null, two childless items (e).
    assert root == {1: ("{items:[0|e|p]}", "p"), 2: ("{items:0}", "e"), 3: ("{items:[]}", "e"), 4: ("{items:[0]}", "e"), 5: ("{items:[p]}", "p")}
    items = {(r["record_id"], r["item_no"]): r["variant"] for r in t["items"].collect()}
    assert items[(1, 1)] == "{item_no:1,n:1,relations:[0|e|f]}" and items[(1, 3)] == "{item_no:1,n:0,relations:0}"


def test_subtypes_in_one_pass_equal_each_subtype(spark, tmp_path):
    t = shred(spark.createDataFrame(ROWS, SCHEMA), "record_id", "records", LEVELS)
    rows = subtypes(t, "record_id", LEVELS, {"items": ["n"], "relations": ["type"], "accused": ["value"]}).collect()
    assert len(rows) == sum(x.count() for x in t.values())
    keys = ["record_id", "item_no", "relation_no"]
    for v in {r["variant"] for r in rows if r["table_name"] == "relations"}:
        one = subtype(t["relations"], v, keys)
        want = {tuple(r[k] for k in keys): r["type"] if "type" in one.columns else None for r in one.collect()}
        assert want == {tuple(r[k] for k in keys): r["type"] for r in rows if r["table_name"] == "relations" and r["variant"] == v}
    write_subtypes(t["relations"], str(tmp_path / "relations"))
    back = spark.read.parquet(str(tmp_path / "relations"))
    assert back.count() == t["relations"].count() and len(list((tmp_path / "relations").glob("variant=*"))) == back.select("variant").distinct().count()
