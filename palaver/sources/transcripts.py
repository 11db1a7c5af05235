"""Transcript lines and headers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TIMED = r"(?s)^([^:(\[]{1,40}?)\s*\((\d{1,2}(?::\d{2}){1,2})\):\s*(.*)$"
_PLAIN = r"(?s)^([^:]{1,40}):\s*(.*)$"
_NUMBERED = r"(?s)^\[(\d+)\]\s*([^:]{1,40}):\s*(.*)$"


def parsed_line(line: Column) -> Column:
    """(speaker, time, text) of ``Speaker (MM:SS): text`` or ``Speaker: text`` (S11); nulls if neither."""
    timed = line.rlike(_TIMED)
    get = lambda p, i: F.trim(F.regexp_replace(F.regexp_extract(line, p, i), r"\n", " "))
    return F.when(timed, F.struct(get(_TIMED, 1).alias("speaker"), get(_TIMED, 2).alias("time"), get(_TIMED, 3).alias("text"))).when(
        line.rlike(_PLAIN), F.struct(get(_PLAIN, 1).alias("speaker"), F.lit(None).cast("string").alias("time"), get(_PLAIN, 2).alias("text"))
    )


def processed_turn(line: Column) -> Column:
    """(number, speaker, text) of ``[n] Speaker: text`` (S12); null for a malformed line."""
    get = lambda i: F.trim(F.regexp_extract(line, _NUMBERED, i))
    return F.when(line.rlike(_NUMBERED), F.struct(get(1).cast("int").alias("number"), get(2).alias("speaker"), get(3).alias("text")))


def header(text: Column) -> Column:
    """(source, session, game, players) of a processed transcript's first lines."""
    f = lambda k: F.nullif(F.trim(F.regexp_extract(text, rf"(?m)^{k}:[ \t]*(.*)$", 1)), F.lit(""))
    return F.struct(f("Source").alias("source"), f("Session").alias("session"), f("Game").alias("game"), F.filter(F.transform(F.split(f("Players"), ","), lambda x: F.trim(x)), lambda x: x != "").alias("players"))


def turns_of(files: DataFrame, text: str = "value", path: str = "path") -> tuple[DataFrame, DataFrame]:
    """(turns, malformed line counts) of whole transcript files."""
    body = F.element_at(F.split(F.col(text), r"(?m)^Transcript:\s*$"), -1)
    rows = files.select(path, F.posexplode(F.split(body, "\n")).alias("at", "line")).where(F.trim("line") != "")
    t = rows.withColumn("t", processed_turn(F.col("line")))
    return t.where("t is not null").select(path, "t.number", "t.speaker", "t.text"), t.groupBy(path).agg(F.count_if(F.col("t").isNull()).alias("n_malformed"))


def merged_chunks(files: DataFrame, keys: list[str], chunk: str, text: str) -> DataFrame:
    """Chunks of one game joined in their order."""
    g = files.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(chunk, text))).alias("c"))
    return g.select(*keys, F.array_join(F.col(f"c.{text}"), "\n").alias(text), F.size("c").alias("n_chunks"))


def marked(line: Column, flag: Column, mark: str) -> Column:
    """The line with a mark at its end where it is flagged."""
    return F.when(F.coalesce(flag, F.lit(False)), F.concat(line, F.lit(f" {mark}"))).otherwise(line)


def unmarked(line: Column, mark: str) -> Column:
    """(is_marked, line without the mark)."""
    return F.struct(line.contains(mark).alias("is_marked"), F.trim(F.replace(line, F.lit(mark), F.lit(""))).alias("line"))


def mark_problems(built: DataFrame, source: DataFrame, keys: list[str], line: str, flag: str, mark: str) -> DataFrame:
    """Lines whose text or mark differs from the source: changed_text, missing_mark, extra_mark, missing_line."""
    b = built.select(*keys, unmarked(F.col(line), mark).alias("u"))
    x = source.select(*keys, F.trim(F.col(line)).alias("__src"), F.col(flag).alias("__flag")).join(b, keys, "left")
    p = F.when(F.col("u").isNull(), "missing_line").when(F.col("u.line") != F.col("__src"), "changed_text").when(F.col("__flag") & ~F.col("u.is_marked"), "missing_mark").when(~F.col("__flag") & F.col("u.is_marked"), "extra_mark")
    return x.select(*keys, p.alias("problem")).where("problem is not null")
