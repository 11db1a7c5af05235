"""Queries on nested records (problem 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.operators.shred import Level, leaves, nodes, shred, subtypes, variants
from palaver.tables import first_delivery, table

LEVELS = [Level("items", "items", "item_no"), Level("relations", "relations", "relation_no"), Level("accused", "accused", "accused_no")]


def _records(spark: SparkSession, d: str, keep: tuple[str, ...] = ("items",)) -> DataFrame:
    return first_delivery(table(spark, d, "accusation_records"), ["record_id"], "loaded_at", list(keep))


def _tables(spark: SparkSession, d: str, keep: tuple[str, ...] = ("items",)) -> dict[str, DataFrame]:
    return shred(_records(spark, d, keep), "record_id", "records", LEVELS)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Every leaf of ``accusation_records`` by its stored positions.

    The automaton runs where the records lie; only the routed nodes of a record are shuffled.
    """
    raw = table(spark, d, "accusation_records")
    routed = raw.select("record_id", "loaded_at", nodes(raw.schema, LEVELS).alias("routed"))
    return leaves(first_delivery(routed, ["record_id"], "loaded_at", ["routed"]), "record_id", LEVELS, "routed")


def p6_records(spark: SparkSession, d: str) -> DataFrame:
    """The record table: one row for each record, childless ones included."""
    return _tables(spark, d, ("game_id", "metadata", "items"))["records"].select("record_id", "game_id", F.col("metadata.source_file").alias("source_file"), "n_children")


def p6_items(spark: SparkSession, d: str) -> DataFrame:
    """The item table, linked to records."""
    return _tables(spark, d)["items"].drop("variant", "class")


def p6_relations(spark: SparkSession, d: str) -> DataFrame:
    """The relation table, linked to items."""
    return _tables(spark, d)["relations"].drop("variant", "class")


def p6_accused(spark: SparkSession, d: str) -> DataFrame:
    """The accused table, linked to relations."""
    return _tables(spark, d)["accused"].select("record_id", "item_no", "relation_no", "accused_no", F.col("value").alias("accused"))


def p6_variants(spark: SparkSession, d: str) -> DataFrame:
    """The variants of the four tables and how many rows each has."""
    return variants(_tables(spark, d))


def p6_subtypes(spark: SparkSession, d: str) -> DataFrame:
    """Every row of the four tables in its typed subtype, with the keys of the common table."""
    fields = {"items": ["line_number", "accuser", "requires_review"], "relations": ["type", "evidence"], "accused": ["value"]}
    return subtypes(_tables(spark, d), "record_id", LEVELS, fields).withColumnRenamed("value", "accused").withColumnRenamed("class", "node_class")


QUERIES = {f.__name__: f for f in (p6_found, p6_records, p6_items, p6_relations, p6_accused, p6_variants, p6_subtypes)}

_BASE = """
with r as (select record_id, game_id, metadata, items from (
    select *, row_number() over (partition by record_id order by loaded_at) as k from accusation_records) where k = 1),
i as (select record_id, i as item_no, items[i] as it from (select record_id, items, unnest(range(1, coalesce(len(items), 0) + 1)) as i from r) where items[i] is not null),
l as (select record_id, item_no, j as relation_no, it.relations[j] as re from (select record_id, item_no, it, unnest(range(1, coalesce(len(it.relations), 0) + 1)) as j from i) where it.relations[j] is not null),
a as (select record_id, item_no, relation_no, k as accused_no, re.accused[k] as accused from (select record_id, item_no, relation_no, re, unnest(range(1, coalesce(len(re.accused), 0) + 1)) as k from l)
      where re.accused[k] is not null and regexp_matches(re.accused[k], '\\S'))
"""
SQL = {
    "p6_found": _BASE + """
select record_id, cast(item_no as int) as item_no, cast(relation_no as int) as relation_no, cast(accused_no as int) as accused_no from (
select record_id, item_no, relation_no, accused_no from a
union all select record_id, item_no, relation_no, 0 from l anti join a using (record_id, item_no, relation_no)
union all select record_id, item_no, 0, 0 from i anti join l using (record_id, item_no)
union all select record_id, 0, 0, 0 from r anti join i using (record_id))""",
    "p6_records": _BASE + "select record_id, game_id, metadata.source_file as source_file, cast((select count(*) from i where i.record_id = r.record_id) as int) as n_children from r",
    "p6_items": _BASE + "select record_id, cast(item_no as int) as item_no, it.line_number as line_number, it.accuser as accuser, it.requires_review as requires_review, cast(coalesce(len(list_filter(it.relations, lambda x: x is not null)), 0) as int) as n_children from i",
    "p6_relations": _BASE + "select record_id, cast(item_no as int) as item_no, cast(relation_no as int) as relation_no, re.type as type, re.evidence as evidence, cast(coalesce(len(list_filter(re.accused, lambda x: x is not null and regexp_matches(x, '\\S'))), 0) as int) as n_children from l",
    "p6_accused": _BASE + "select record_id, cast(item_no as int) as item_no, cast(relation_no as int) as relation_no, cast(accused_no as int) as accused_no, accused from a",
}

# The variant of every row by joins instead of an automaton: counts of childless children decide.
_STATE = "case when {0} is null then '0' when not regexp_matches({0}, '\\S') then 'b' else '1' end"
_VARIANTS = _BASE.rstrip() + """,
lv as (select record_id, item_no, relation_no, re, (select count(*) from a where a.record_id = l.record_id and a.item_no = l.item_no and a.relation_no = l.relation_no) as na from l),
iv as (select i.record_id, i.item_no, it, coalesce(n, 0) as n, coalesce(ne, 0) as ne, coalesce(len(it.relations), 0) as len from i
       left join (select record_id, item_no, count(*) as n, count_if(na = 0) as ne from lv group by all) using (record_id, item_no)),
rv as (select r.record_id, items, coalesce(n, 0) as n, coalesce(ne, 0) as ne, coalesce(np, 0) as np, coalesce(len(items), 0) as len from r
       left join (select record_id, count(*) as n, count_if(n = 0) as ne, count_if(n > 0 and ne > 0) as np from iv group by all) using (record_id)),
s as (
select 'records' as table_name, '{items:' || case when items is null then '0' when len = 0 then '[]' else '[' || array_to_string(list_filter([case when n < len then '0' end, case when ne > 0 then 'e' end, case when n > ne + np then 'f' end, case when np > 0 then 'p' end], lambda x: x is not null), '|') || ']' end || '}' as variant,
  case when n = 0 then 'e' when ne + np > 0 then 'p' else 'f' end as node_class, record_id, 0 as item_no, 0 as relation_no, 0 as accused_no, null::int as line_number, null::varchar as accuser, null::boolean as requires_review, null::varchar as type, null::varchar as evidence, null::varchar as accused from rv
union all select 'items', '{line_number:' || case when it.line_number is null then '0' else '1' end || ',accuser:' || """ + _STATE.format("it.accuser") + """ || ',relations:' || case when it.relations is null then '0' when len = 0 then '[]' else '[' || array_to_string(list_filter([case when n < len then '0' end, case when ne > 0 then 'e' end, case when n > ne then 'f' end], lambda x: x is not null), '|') || ']' end
  || ',requires_review:' || case when it.requires_review is null then '0' else '1' end || '}', case when n = 0 then 'e' when ne > 0 then 'p' else 'f' end, record_id, item_no, 0, 0, it.line_number, case when regexp_matches(it.accuser, '\\S') then it.accuser end, it.requires_review, null, null, null from iv
union all select 'relations', '{type:' || """ + _STATE.format("re.type") + """ || ',accused:' || case when re.accused is null then '0' when len(re.accused) = 0 then '[]' else '[' || array_to_string(list_sort(list_distinct(list_transform(re.accused, lambda x: """ + _STATE.format("x") + """))), '|') || ']' end
  || ',evidence:' || """ + _STATE.format("re.evidence") + """ || '}', case when na = 0 then 'e' else 'f' end, record_id, item_no, relation_no, 0, null, null, null, case when regexp_matches(re.type, '\\S') then re.type end, case when regexp_matches(re.evidence, '\\S') then re.evidence end, null from lv
union all select 'accused', '1', 'f', record_id, item_no, relation_no, accused_no, null, null, null, null, null, accused from a)
"""
SQL["p6_subtypes"] = _VARIANTS + "select * replace (item_no::int as item_no, relation_no::int as relation_no, accused_no::int as accused_no, line_number::int as line_number) from s"
SQL["p6_variants"] = _VARIANTS + "select table_name, variant, count(*) as n_rows from s group by all"
