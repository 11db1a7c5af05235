"""Argument graphs as tables of nodes, edges and groups: repair, validation, cycles, features.

``nodes``: graph, pos, id, role, text. ``edges``: graph, pos, source, target, relation, grp.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from palaver.operators.runs import sorted_groups
from palaver.session import cut

_TEXTS = {"nodes": ("id", "role", "text"), "edges": ("source", "target", "relation", "grp")}


def normalised(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, repairs) with equal meaning.

    Outer spaces go, exact duplicates go (the first stays), ids become n1, n2, … by order where all
    ids of a graph are filled and unique, and groups g1, g2, … by their first edge. ``repairs``
    counts what was done for each graph.
    """
    def trimmed(df: DataFrame, kind: str) -> DataFrame:
        changed = sum((F.coalesce((F.trim(c) != F.col(c)).cast("int"), F.lit(0)) for c in _TEXTS[kind]), F.lit(0))
        return df.withColumn("__t", changed).withColumns({c: F.trim(c) for c in _TEXTS[kind]})

    n, e = cut(trimmed(nodes, "nodes")), cut(trimmed(edges, "edges"))
    n1 = n.groupBy("graph", *_TEXTS["nodes"]).agg(F.min("pos").alias("pos"), F.count("*").alias("k"))
    e1 = e.groupBy("graph", *_TEXTS["edges"]).agg(F.min("pos").alias("pos"), F.count("*").alias("k"))
    ok = n1.groupBy("graph").agg(((F.count("*") == F.countDistinct("id")) & F.min(F.coalesce(F.col("id") != "", F.lit(False)))).alias("ok"))
    ids = n1.join(ok, "graph").withColumn("new", F.when(F.col("ok"), F.concat(F.lit("n"), F.row_number().over(W.partitionBy("graph").orderBy("pos").orderBy("pos", "id")))).otherwise(F.col("id")))
    names = ids.where("ok").select("graph", F.col("id").alias("old"), "new")
    groups = e1.where("grp is not null and grp <> ''").groupBy("graph", "grp").agg(F.min("pos").alias("at"))
    groups = groups.withColumn("gnew", F.concat(F.lit("g"), F.row_number().over(W.partitionBy("graph").orderBy("at", "grp")))).drop("at")
    s, t = names.select("graph", F.col("old").alias("source"), F.col("new").alias("s_new")), names.select("graph", F.col("old").alias("target"), F.col("new").alias("t_new"))
    e2 = e1.join(s, ["graph", "source"], "left").join(t, ["graph", "target"], "left").join(groups, ["graph", "grp"], "left")
    new_edges = e2.select("graph", "pos", F.coalesce("s_new", "source").alias("source"), F.coalesce("t_new", "target").alias("target"), "relation", F.coalesce("gnew", "grp").alias("grp"))
    new_nodes = ids.select("graph", "pos", F.col("new").alias("id"), "role", "text")
    parts = [
        (n.groupBy("graph").agg(F.sum("__t").alias("n")), "outer_whitespace_trimmed"), (e.groupBy("graph").agg(F.sum("__t").alias("n")), "outer_whitespace_trimmed"),
        (n1.groupBy("graph").agg(F.sum(F.col("k") - 1).alias("n")), "exact_duplicate_node_removed"), (e1.groupBy("graph").agg(F.sum(F.col("k") - 1).alias("n")), "exact_duplicate_edge_removed"),
        (ids.groupBy("graph").agg(F.sum((F.col("new") != F.col("id")).cast("int")).alias("n")), "node_ids_renumbered"), (groups.groupBy("graph").agg(F.sum((F.col("gnew") != F.col("grp")).cast("int")).alias("n")), "inference_group_ids_renumbered"),
    ]
    repairs = None
    for df, kind in parts:
        one = df.where("n > 0").select("graph", F.lit(kind).alias("repair"), F.col("n").cast("long").alias("n"))
        repairs = one if repairs is None else repairs.unionByName(one)
    return new_nodes, new_edges, repairs.groupBy("graph", "repair").agg(F.sum("n").alias("n"))


#: Edges of a graph that one task peels by itself; larger graphs are peeled by all tasks together.
LOCAL_EDGES = 200_000


def _peel(key: tuple, rows: list[dict]) -> Iterator[tuple]:
    """Peels one graph: edges without an edge into their source or out of their target go."""
    out: dict[str, list[int]] = {}
    into: dict[str, list[int]] = {}
    for i, r in enumerate(rows):
        out.setdefault(r["source"], []).append(i)
        into.setdefault(r["target"], []).append(i)
    n_in, n_out = {v: len(x) for v, x in into.items()}, {v: len(x) for v, x in out.items()}
    here = [True] * len(rows)
    todo = [v for v in out if v not in into] + [v for v in into if v not in out]
    while todo:
        v = todo.pop()
        for i in (*out.get(v, ()), *into.get(v, ())):
            if here[i]:
                here[i] = False
                s, t = rows[i]["source"], rows[i]["target"]
                n_out[s] -= 1
                n_in[t] -= 1
                if not n_in[t]:
                    todo.append(t)
                if not n_out[s]:
                    todo.append(s)
    if any(here):
        yield (*key, sum(here))


def _peeled_together(left: DataFrame) -> DataFrame:
    """(graph, n_edges_left) of large graphs, by rounds over all tasks until nothing changes.

    A round drops edges at open ends, then joins the two edges of a random half of the nodes on
    plain paths into one that counts for both, so a long path takes rounds in its logarithm.
    """
    left = cut(left.withColumn("w", F.lit(1).cast("long")))
    turn = 0
    while True:
        before = left.count()
        into, out = left.select("graph", F.col("target").alias("source")).distinct(), left.select("graph", F.col("source").alias("target")).distinct()
        less = cut(left.join(into, ["graph", "source"], "left_semi").join(out, ["graph", "target"], "left_semi"))
        deg = less.select("graph", F.explode(F.array(F.struct(F.col("source").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("target").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("d"))
        plain = deg.groupBy("graph", F.col("d.node").alias("target")).agg(F.sum("d.i").alias("i"), F.sum("d.o").alias("o")).where("i = 1 and o = 1").select("graph", "target")
        way = cut(less.join(plain, ["graph", "target"]).where("source <> target").select("graph", F.col("target").alias("mid"), F.col("source").alias("p"), F.col("w").alias("w1")))
        if less.count() == before and way.isEmpty():
            return less.groupBy("graph").agg(F.sum("w").alias("n_edges_left"))
        coin = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit(turn)), F.lit(2))  # noqa: E731, B023
        mid = way.where((coin("mid") == 1) & (coin("p") == 0))
        joined = less.join(mid.withColumnRenamed("mid", "source"), ["graph", "source"]).select("graph", F.col("p").alias("source"), "target", (F.col("w") + F.col("w1")).alias("w"))
        rest = less.join(mid.select("graph", F.col("mid").alias("source")), ["graph", "source"], "left_anti").join(mid.select("graph", F.col("mid").alias("target")), ["graph", "target"], "left_anti")
        left = cut(rest.select("graph", "source", "target", "w").unionByName(joined).groupBy("graph", "source", "target").agg(F.sum("w").alias("w")))
        turn += 1


def cyclic(edges: DataFrame, local: int = LOCAL_EDGES) -> DataFrame:
    """Graphs with a cycle (X17), with the number of distinct edges on or between cycles.

    Edges from nodes without incoming edges and into nodes without outgoing edges are peeled off
    until nothing changes; what is left lies on or between cycles, whatever the length of paths. A
    graph of at most ``local`` distinct edges is peeled in one task, larger ones by all tasks
    together; both are exact. Edges with a null end count for none. No edges give no rows.
    """
    e = edges.select("graph", "source", "target").where("source is not null and target is not null").distinct()
    large = e.groupBy("graph").agg(F.count("*").alias("n")).where(F.col("n") > local).select("graph")
    kinds = dict(e.dtypes)
    schema = f"graph {kinds['graph']}, n_edges_left long"
    if large.isEmpty():
        return sorted_groups(e, ["graph"], [], _peel, schema)
    e, large = cut(e), cut(large)
    same = F.col("graph").eqNullSafe(F.col("g"))
    small = sorted_groups(e.join(large.withColumnRenamed("graph", "g"), same, "left_anti"), ["graph"], [], _peel, schema)
    return small.unionByName(_peeled_together(e.join(large.withColumnRenamed("graph", "g"), same, "left_semi")))


def expected_groups(edges: DataFrame) -> DataFrame:
    """The group that edges imply (X18): sources in first order, target and relation of its first
    edge, and whether it mixes targets or relations."""
    e = edges.where("grp is not null and grp <> ''")
    g = e.groupBy("graph", "grp").agg(
        F.array_sort(F.collect_list(F.struct("pos", "source"))).alias("s"), F.min_by("target", "pos").alias("target"), F.min_by("relation", "pos").alias("relation"),
        (F.countDistinct(F.coalesce("target", F.lit(""))) > 1).alias("mixes_targets"), (F.countDistinct(F.coalesce("relation", F.lit(""))) > 1).alias("mixes_relations"),
    )
    return g.select("graph", "grp", F.array_distinct(F.transform("s", lambda x: x["source"])).alias("sources"), "target", "relation", "mixes_targets", "mixes_relations")


def issues(nodes: DataFrame, edges: DataFrame, roles: list[str], relations: list[str], conclusion: str = "Conclusion") -> DataFrame:
    """Each graph's issues by code with their number."""
    n, e = cut(nodes), cut(edges)
    ids = n.select("graph", F.col("id").alias("__id")).distinct()

    def lacking(col: str) -> DataFrame:
        return e.select("graph", F.col(col).alias("__id")).join(ids, ["graph", "__id"], "left_anti")

    end = n.where(F.col("role") == conclusion)
    dup = lambda df, keys: df.groupBy("graph", *keys).agg(F.count("*").alias("k")).where("k > 1")
    groups = expected_groups(e)
    found = {
        "empty_node_id": n.where("id is null or id = ''"), "invalid_role": n.where(~F.coalesce(F.col("role").isin(*roles), F.lit(False))),
        "empty_node_text": n.where("text is null or trim(text) = ''"), "duplicate_node_id": dup(n, ["id"]), "missing_source": lacking("source"), "missing_target": lacking("target"),
        "self_edge": e.where("source = target"), "invalid_relation": e.where(~F.coalesce(F.col("relation").isin(*relations), F.lit(False))), "edge_without_group": e.where("grp is null or grp = ''"),
        "duplicate_edge": dup(e, ["source", "target", "relation", "grp"]), "repeated_pair": dup(e, ["source", "target"]), "several_conclusions": end.groupBy("graph").agg(F.count("*").alias("k")).where("k > 1"),
        "conclusion_has_outgoing": e.join(end.select("graph", F.col("id").alias("source")), ["graph", "source"], "left_semi"), "cycle": cyclic(e),
        "group_mixes_targets": groups.where("mixes_targets"), "group_mixes_relations": groups.where("mixes_relations"),
    }
    out = None
    for code, df in found.items():
        one = df.select("graph", F.lit(code).alias("issue"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("graph", "issue").agg(F.count("*").alias("n"))


def features(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts of a graph's nodes, edges, roles, relations, roots, leaves and degrees."""
    deg = edges.select(F.explode(F.array(F.struct("graph", F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct("graph", F.col("target").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x")).select("x.*")
    d = deg.groupBy("graph", "id").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    by_node = nodes.select("graph", "id").distinct().join(d, ["graph", "id"], "left").fillna(0, ["o", "i"]).groupBy("graph").agg(
        F.count("*").alias("n_nodes"), F.count_if((F.col("i") == 0) & (F.col("o") > 0)).alias("n_roots"), F.count_if((F.col("o") == 0) & (F.col("i") > 0)).alias("n_leaves"),
        F.count_if((F.col("o") == 0) & (F.col("i") == 0)).alias("n_isolated"), F.max("i").alias("max_in"), F.max("o").alias("max_out"),
    )
    by_edge = edges.groupBy("graph").agg(F.count("*").alias("n_edges"), F.countDistinct("relation").alias("n_relations"), F.countDistinct("grp").alias("n_groups"), F.count_if(F.col("source") == F.col("target")).alias("n_self"))
    return by_node.join(by_edge, "graph", "left").fillna(0)


def group_features(nodes: DataFrame, edges: DataFrame, conclusion: str, support: str, attack: str) -> DataFrame:
    """What a graph's inference groups look like (A66): one row for each graph with a node.

    Conclusions, groups, linked groups (of several sources), targets that several groups lead to,
    groups of either relation (by their first edge), whether an edge attacks, and the sorted roles
    and relations.
    """
    own = nodes.groupBy("graph").agg(F.count_if(F.col("role") == conclusion).alias("n_conclusions"), F.array_sort(F.collect_set("role")).alias("node_roles"))
    rel = edges.groupBy("graph").agg(F.coalesce(F.max(F.col("relation") == attack), F.lit(False)).alias("has_attack"), F.array_sort(F.collect_set("relation")).alias("edge_relations"))
    g = expected_groups(edges)
    per = g.groupBy("graph").agg(
        F.count("*").alias("n_groups"), F.count_if(F.size("sources") > 1).alias("n_linked_groups"), F.count_if(F.col("relation") == support).alias("n_support_groups"), F.count_if(F.col("relation") == attack).alias("n_attack_groups")
    )
    many = g.groupBy("graph", "target").agg(F.count("*").alias("k")).where("k > 1").groupBy("graph").agg(F.count("*").alias("n_targets_with_several_groups"))
    x = own.join(rel, "graph", "left").join(per, "graph", "left").join(many, "graph", "left")
    counts = ["n_groups", "n_linked_groups", "n_support_groups", "n_attack_groups", "n_targets_with_several_groups"]
    return x.fillna(0, counts).select("graph", "n_conclusions", *counts, F.coalesce("has_attack", F.lit(False)).alias("has_attack"), "node_roles", F.coalesce("edge_relations", F.array().cast("array<string>")).alias("edge_relations"))
