"""Nested records into related flat tables, one structural variant at a time.

A bottom-up tree automaton classifies every node. The state of a leaf value says whether it is null
(``0``), blank (``b``) or filled (``1``). A node is of class ``0`` if it is null, ``e`` (a leaf of
the record) if no child counts, ``f`` if every way down from it reaches the last level and ``p`` if
some do: its class follows from the classes of its children alone. An array's state is the set of
its elements' classes or states, an object's *variant* the list of its fields' states. So states of
children reach the parent, and there are few variants however long and deep the arrays are.

:func:`nodes` routes every node of a record by its level and class; the leaves are the nodes of
class ``e`` and those of the last level. :func:`shred` gives the flat table of each level with the
variant of each row, :func:`subtype` the typed table of one variant, :func:`subtypes` all of them in
one pass and :func:`write_subtypes` a folder for each. Every subtype keeps the keys of the common
table and of its parents.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def filled(text: Column) -> Column:
    """True where a text has a character that is no white space (Unicode); false for null."""
    return F.coalesce(text.rlike(r"(?U)\S"), F.lit(False))


@dataclass(frozen=True)
class Level:
    """A level of nesting: the table's name, the array's field in its parent, its position column."""

    table: str
    field: str
    number: str


def _scalar(dtype: T.DataType) -> bool:
    return not isinstance(dtype, (T.StructType, T.ArrayType, T.MapType))


def node_class(col: Column, dtype: T.DataType, path: list[str]) -> Column:
    """The automaton's class of a node whose children lie along ``path`` (array fields, downwards)."""
    if not path:
        return F.when(col.isNull(), "0").when(~filled(col), "b").otherwise("f") if isinstance(dtype, T.StringType) else F.when(col.isNull(), "0").otherwise("f")
    elem = _element(dtype, path[0])
    below = F.filter(F.transform(col.getField(path[0]), lambda x: node_class(x, elem, path[1:])), lambda c: ~c.isin("0", "b"))
    return F.when(col.isNull(), "0").when(F.coalesce(F.size(below), F.lit(0)) <= 0, "e").when(F.forall(below, lambda c: c == "f"), "f").otherwise("p")


def state(col: Column, dtype: T.DataType, path: list[str] = ()) -> Column:
    """The automaton's state of a value; of an object it is its variant.

    The array field ``path[0]`` of an object holds its children and has the set of their classes;
    other arrays have the set of their elements' states, in which an object only counts as there.
    """
    if isinstance(dtype, T.StructType):
        fields = [F.concat(F.lit(f.name + ":"), _array_state(col.getField(f.name), f.dataType, path[1:]) if path and f.name == path[0] else state(col.getField(f.name), f.dataType)) for f in dtype.fields]
        return F.when(col.isNull(), "0").otherwise(F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}")))
    if isinstance(dtype, T.ArrayType):
        return _array_state(col, dtype, [])
    if isinstance(dtype, T.MapType):
        return F.when(col.isNull(), "0").when(F.size(col) == 0, "<>").otherwise("<1>")
    if isinstance(dtype, T.StringType):
        return F.when(col.isNull(), "0").when(~filled(col), "b").otherwise("1")
    return F.when(col.isNull(), "0").otherwise("1")


def _array_state(col: Column, dtype: T.ArrayType, path: list[str]) -> Column:
    elem = dtype.elementType
    one = (lambda x: state(x, elem)) if _scalar(elem) else (lambda x: node_class(x, elem, path))
    states = F.array_sort(F.array_distinct(F.transform(col, one)))
    return F.when(col.isNull(), "0").when(F.size(col) == 0, "[]").otherwise(F.concat(F.lit("["), F.array_join(states, "|"), F.lit("]")))


def _children(array: Column, elem: T.DataType) -> Column:
    """Elements that count as children, each with its stored position: no nulls, no blank texts."""
    numbered = F.transform(array, lambda x, i: F.struct((i + 1).cast("int").alias("no"), x.alias("v")))
    if isinstance(elem, T.StringType):
        return F.filter(numbered, lambda s: filled(s["v"]))
    return F.filter(numbered, lambda s: s["v"].isNotNull())


def _element(dtype: T.DataType, name: str) -> T.DataType:
    for f in dtype.fields if isinstance(dtype, T.StructType) else []:
        if f.name == name and isinstance(f.dataType, T.ArrayType):
            return f.dataType.elementType
    raise ValueError(f"no array field {name}")


def nodes(schema: T.StructType, levels: list[Level]) -> Column:
    """All nodes of a record, root and last level included, as an array of (level, class, positions).

    ``level`` is 0 for the record; positions count from 1 as stored and are 0 below the node. Null
    elements and blank texts are no nodes but keep their position. Null or missing arrays count as
    empty. An expression over the row itself: no shuffle, and no text survives it.
    """
    names = [lv.field for lv in levels]

    def made(depth: int, at: list[Column], kind: Column) -> Column:
        places = [*at, *[F.lit(0)] * (len(levels) - len(at))]
        return F.struct(F.lit(depth).alias("level"), kind.alias("class"), *[p.cast("int").alias(lv.number) for p, lv in zip(places, levels)])

    def walk(depth: int, value: Column, dtype: T.DataType, at: list[Column]) -> Column:
        own = F.array(made(depth, at, node_class(value, dtype, names[depth:])))
        if depth == len(levels):
            return own
        elem = _element(dtype, names[depth])
        kids = F.coalesce(_children(value.getField(names[depth]), elem), F.array().cast(T.ArrayType(T.StructType([T.StructField("no", T.IntegerType()), T.StructField("v", elem)]))))
        return F.concat(own, F.flatten(F.transform(kids, lambda k: walk(depth + 1, k["v"], elem, [*at, k["no"]]))))

    return walk(0, F.struct(F.col(names[0]).alias(names[0])), T.StructType([schema[names[0]]]), [])


def leaves(df: DataFrame, key: str, levels: list[Level], routed: str | None = None) -> DataFrame:
    """One row for each leaf: ``key`` and a position for each level, 0 below a childless node.

    The leaves are those nodes that the automaton routes to a childless class (``e``), and those of
    the last level; ``routed`` names a column that already holds :func:`nodes`. A row of ``df``
    without children gives one row of zeros, so no parent is lost. Repeated rows of ``df`` repeat
    their leaves (remove them first). Extra columns are ignored. An empty table has no leaves.
    """
    all_ = F.col(routed) if routed else nodes(df.schema, levels)
    ends = F.filter(all_, lambda n: (n["class"] == "e") | (n["level"] == len(levels)))
    return df.select(F.col(key), F.explode(ends).alias("__n")).select(key, *[F.col(f"__n.{lv.number}").alias(lv.number) for lv in levels])


def shred(df: DataFrame, key: str, root: str, levels: list[Level]) -> dict[str, DataFrame]:
    """Flat tables for the root and each level, with keys, parent links and the variant of each row.

    Every table has ``key``, the positions down to its own level, ``variant`` (the automaton's state
    of the row), ``class``, the scalar fields, and ``n_children``; a row links to its parent by the
    key without the last position. Fields whose names clash with a position or link column come out
    as ``<name>_value``.
    """
    out: dict[str, DataFrame] = {}
    path = [lv.field for lv in levels]
    first = path[0]
    taken = {key, "variant", "class", "n_children", *(x.number for x in levels)}
    size = lambda a, e: F.when(a.isNull(), 0).otherwise(F.size(_children(a, e)))
    safe = lambda c, name: c.alias(f"{name}_value" if name in taken else name)
    whole = F.struct(F.col(first).alias(first))
    rooted = T.StructType([df.schema[first]])
    out[root] = df.select(
        key, state(whole, rooted, path).alias("variant"), node_class(whole, rooted, path).alias("class"),
        *[safe(F.col(f.name), f.name) for f in df.schema.fields if f.name not in (key, first)], size(F.col(first), _element(df.schema, first)).alias("n_children"),
    )
    base, elem, numbers = df.select(key, F.col(first).alias("__a")), _element(df.schema, first), []
    for i, lv in enumerate(levels):
        base = base.select(key, *numbers, F.explode(_children(F.col("__a"), elem)).alias("__c"))
        numbers = [*numbers, lv.number]
        base = base.select(key, *numbers[:-1], F.col("__c.no").alias(lv.number), F.col("__c.v").alias("__v"))
        rest = path[i + 1 :]
        if isinstance(elem, T.StructType):
            fields = [safe(F.col(f"__v.{f.name}"), f.name) for f in elem.fields if f.name not in rest[:1]]
        else:
            fields = [F.col("__v").alias("value")]
        n = size(F.col(f"__v.{rest[0]}"), _element(elem, rest[0])) if rest else F.lit(0)
        out[lv.table] = base.select(key, *numbers, state(F.col("__v"), elem, rest).alias("variant"), node_class(F.col("__v"), elem, rest).alias("class"), *fields, n.alias("n_children"))
        if rest:
            base, elem = base.select(key, *numbers, F.col(f"__v.{rest[0]}").alias("__a")), _element(elem, rest[0])
    return out


def variants(tables: dict[str, DataFrame]) -> DataFrame:
    """How many rows of each table have each variant: the catalogue of subtype tables."""
    parts = [t.groupBy("variant").agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("table_name"), "variant", "n_rows") for n, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_EMPTY = r"(?:0|b|\[\]|<>)"


def _fills(column: str) -> Column:
    """Whether a row's variant fills ``column``; the value of a scalar element always counts."""
    return ~F.col("variant").startswith("{") | F.col("variant").rlike(rf"[{{,]{re.escape(column.removesuffix('_value'))}:(?!{_EMPTY}[,}}])")


def subtype(flat: DataFrame, variant: str, keys: list[str]) -> DataFrame:
    """The typed subtype table of one variant: the supertype keys and the fields that it fills."""
    held = {m[1] for m in re.finditer(rf"[{{,](\w+):(?!{_EMPTY}[,}}])", variant)}
    keep = [c for c in flat.columns if c not in (*keys, "variant", "class", "n_children") and (variant[:1] != "{" or c in held or c.removesuffix("_value") in held)]
    return flat.where(F.col("variant") == variant).select(*keys, *keep)


def subtypes(tables: dict[str, DataFrame], key: str, levels: list[Level], fields: dict[str, list[str]]) -> DataFrame:
    """The rows of all subtype tables under the keys they share, routed in one pass over each table.

    ``table_name`` and ``variant`` name the subtype, ``fields`` lists the columns of each table to
    carry; a column is null where its table or the row's variant has it not, so a subtype's rows are
    those of :func:`subtype` with typed nulls for what it lacks. Each row of a flat table is in
    exactly one subtype.
    """
    numbers = [lv.number for lv in levels]
    out = None
    for depth, (name, flat) in enumerate(tables.items()):
        links = [F.col(n) if i < depth else F.lit(0).alias(n) for i, n in enumerate(numbers)]
        one = flat.select(F.lit(name).alias("table_name"), "variant", "class", key, *links, *[F.when(_fills(c), F.col(c)).alias(c) for c in fields.get(name, [])])
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def write_subtypes(flat: DataFrame, folder: str) -> None:
    """A Parquet folder for each variant of a flat table, written in one pass (no shuffle).

    ``spark.read.parquet(folder).where(variant = ...)`` then reads that subtype's folder alone.
    """
    flat.write.partitionBy("variant").mode("overwrite").parquet(folder)
