"""Queries on drifting schemas (problem 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.operators.drift import changes, profile, shown, steady_names, unify
from palaver.session import cut
from palaver.tables import first_delivery, table


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_records").select("record_no", "run_dir", "file_name", "file_seq", "line_no", "record")


def _files(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).groupBy(F.col("run_dir").alias("run"), F.col("file_seq").alias("seq")).agg(F.max("file_name").alias("file_name"))


def _changed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    files = _files(spark, d)
    prof = cut(profile(_rows(spark, d), "run_dir", "file_seq", "record"))
    return prof, files, changes(prof, files)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Every change of a file of ``raw_records`` against the file before it in its run."""
    _, files, ch = _changed(spark, d)
    return ch.join(files, ["run", "seq"]).select(
        "file_name", shown(F.col("path")).alias("field_path"), F.col("kind").alias("change_kind"), shown(F.col("former")).alias("former_path")
    )


def p5_profile(spark: SparkSession, d: str) -> DataFrame:
    """The fields of each file with their JSON types and counts; a row that came again counts once."""
    rows = first_delivery(table(spark, d, "raw_records"), ["record_no"], "exported_at", ["run_dir", "file_seq", "record"])
    prof = profile(rows, "run_dir", "file_seq", "record").where("path != ''")
    names = F.array(*[F.when(F.col("types").bitwiseAND(1 << i) != 0, F.lit(t)) for i, t in enumerate(("object", "array", "string", "number", "boolean"))])
    return prof.select(
        F.col("run").alias("run_dir"), F.col("seq").alias("file_seq"), shown(F.col("path")).alias("field_path"),
        F.array_join(F.filter(names, lambda x: x.isNotNull()), "|").alias("json_types"), "n_rows", "n_null",
    )


def p5_unified(spark: SparkSession, d: str) -> DataFrame:
    """All records that parse in one table with steady columns, repeated rows taken away."""
    prof, _, ch = _changed(spark, d)
    rows = first_delivery(table(spark, d, "raw_records"), ["record_no"], "exported_at", ["run_dir", "file_seq", "line_no", "record"])
    return unify(rows, "record", ["record_no", "run_dir", "file_seq", "line_no"], steady_names(prof, ch), prof)


QUERIES = {"p5_found": p5_found, "p5_profile": p5_profile, "p5_unified": p5_unified}

_KIND = "case json_type({0}) when 'OBJECT' then 'object' when 'ARRAY' then 'array' when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'NULL' then null else 'number' end"
# Records walked level by level: an object gives its fields, an array its elements under the same path.
_FIELDS = """
with recursive r as (select record_no, run_dir, file_seq, file_name, record from raw_records qualify row_number() over (partition by record_no order by exported_at) = 1),
p as (select record_no, run_dir, file_seq, try_cast(record as json) as j from r where json_valid(record) and json_type(try_cast(record as json)) = 'OBJECT'),
w as (
  select record_no, run_dir, file_seq, '' as path, j, 0 as named from p
  union all
  select record_no, run_dir, file_seq, case when e.k is null then path else path || case when path = '' then '' else '.' end || e.k end, e.v, (e.k is not null)::int
  from (select w.*, unnest(case when json_type(j) = 'OBJECT' then list_transform(json_keys(j), lambda k: {k: k, v: json_extract(j, '$."' || k || '"')})
                                when json_type(j) = 'ARRAY' then list_transform(json_extract(j, '$[*]'), lambda x: {k: null::varchar, v: x}) end) as e from w where json_type(j) in ('OBJECT', 'ARRAY')) as w),
f as (select record_no, run_dir, file_seq, path, """ + _KIND.format("j") + """ as kind from w where named = 1)
"""
SQL = {"p5_profile": _FIELDS + """select run_dir, file_seq, path as field_path, array_to_string(list_filter(['object', 'array', 'string', 'number', 'boolean'], lambda t: list_contains(ks, t)), '|') as json_types, n_rows, n_null
from (select run_dir, file_seq, path, list(distinct kind) filter (kind is not null) as ks, count(distinct record_no) as n_rows, count_if(kind is null) as n_null from f group by run_dir, file_seq, path)"""}
