"""Sinks: CSV with JSON cells, owned directories, JSON lines, manifests, reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_cells(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text."""
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(f.name) for f in df.schema])


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header and JSON cells."""
    json_cells(df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_json_cells(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """JSON text columns back as their types; malformed cells become null."""
    return df.select(*[F.from_json(c, types[c]).alias(c) if c in types else F.col(c) for c in df.columns])


def write_tables(tables: dict[str, DataFrame], root: str) -> list[str]:
    """A directory of tables that this call owns: sub-directories not in ``tables`` are removed.

    Gives the names that were removed. Works on any file system that Spark can reach.
    """
    if not tables:
        raise ValueError("no table")
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = []
    for s in fs.listStatus(p):
        if s.isDirectory() and s.getPath().getName() not in tables:
            gone.append(s.getPath().getName())
            fs.delete(s.getPath(), True)
    return sorted(gone)


def append_jsonl(df: DataFrame, path: str) -> None:
    """Rows added as JSON lines."""
    df.write.mode("append").json(path)


def completed(df: DataFrame, error: str, items: str, expected: str) -> DataFrame:
    """Records that need no rerun: no error, a list of items, every expected line covered."""
    got = F.transform(F.col(items), lambda i: i["line_number"])
    return df.where(F.col(error).isNull() & F.col(items).isNotNull() & (F.size(F.array_except(F.coalesce(F.col(expected), F.array().cast("array<int>")), got)) == 0))


def put_text(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small text file on any file system that Spark can reach; False if it is there already."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(p):
        return False
    out = fs.create(p, False)
    out.write(bytearray(text.encode()))
    out.close()
    return True


def check_manifest(spark: SparkSession, path: str, signature: dict) -> bool:
    """Writes a run's signature, or compares it with the one that is there.

    True if it was written now, False if it agrees; a different one is an error. Works on any file
    system that Spark can reach; a signature that is written meanwhile by another run is an error.
    """
    if put_text(spark, path, json.dumps(signature, sort_keys=True, indent=1)):
        return True
    old = json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))
    if old != signature:
        raise ValueError(f"another run's manifest: {sorted(k for k in {*old, *signature} if old.get(k) != signature.get(k))} differ")
    return False


def latex(df: DataFrame, columns: list[str], most: int = 1_000) -> str:
    """A LaTeX table of a report (S22); more than ``most`` rows are an error."""
    rows = df.select(*columns).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    text = lambda v: "--" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v).replace("&", r"\&").replace("%", r"\%").replace("_", r"\_")
    body = "\n".join(" & ".join(text(v) for v in r) + r" \\" for r in rows)
    return "\\begin{tabular}{" + "l" * len(columns) + "}\n" + " & ".join(text(c) for c in columns) + " \\\\\n\\hline\n" + body + "\n\\end{tabular}"


def examples_text(df: DataFrame, title: str, body: str, most: int = 1_000) -> str:
    """Titled examples as plain text (S22); more than ``most`` rows are an error."""
    rows = df.select(title, body).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    return "\n\n".join(f"== {r[0]}\n{r[1]}" for r in rows)
