"""Readers of JSON, JSON lines, CSV, XML, text and result directories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UTTERANCE = "array<struct<Rec_Id:int,speaker:string,timestamp:string,utterance:string,annotation:string>>"
ANNOTATION_GAME = f"video_name string, YT_ID string, EG_ID string, Game_ID string, playerNames array<string>, Dialogue {UTTERANCE}"
OUTCOME = "struct<playerNames:array<string>,startRoles:array<string>,endRoles:array<string>,votingOutcome:array<string>,warning:string>"
ACCUSATION = (
    "metadata struct<source_file:string,source:string,session:string,game:string,players:array<string>,model:string,reasoning_effort:string,prompt_path:string,generated_at_utc:string,"
    "expected_line_numbers:array<int>,validation_flags:array<string>,error:string>,"
    "items array<struct<line_number:int,accuser:string,relations:array<struct<type:string,accused:array<string>,evidence:string>>,requires_review:boolean>>"
)
#: Split files that belong to the corpus; others beside them are other games.
SPLITS = ("train", "val", "test")


def _with_file(df: DataFrame) -> DataFrame:
    return df.withColumn("path", F.col("_metadata.file_path"))


def read_json(spark: SparkSession, path: str | list[str], schema: str, strict: bool = False) -> DataFrame:
    """Whole-file JSON documents under a fixed schema.

    Files that do not parse are skipped; with ``strict`` they stop the read when it runs.
    """
    if strict:
        return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    raw = spark.read.schema(f"{schema}, _broken string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(path)
    return raw.where("_broken is null").drop("_broken")


def scan_json(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """All ``*.json`` below ``root`` with their ``path``, unreadable ones left out."""
    raw = _with_file(spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("ignoreCorruptFiles", True).text(root, wholetext=True))
    full = _with_broken(spark, schema)
    x = raw.withColumn("j", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})).where(F.col("j").isNotNull() & F.col("j._broken").isNull())
    return x.select(*[F.col(f"j.{f.name}").alias(f.name) for f in full.fields if f.name != "_broken"], "path")


def _with_broken(spark: SparkSession, schema: str) -> T.StructType:
    return spark.createDataFrame([], f"{schema}, _broken string").schema


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, broken lines with file and text) of JSON lines; blank lines are no rows."""
    raw = spark.read.text(path).withColumn("path", F.col("_metadata.file_path")).where(F.trim("value") != "")
    full = _with_broken(spark, schema)
    x = raw.withColumn("j", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}))
    names = [f.name for f in full.fields if f.name != "_broken"]
    ok = F.col("j").isNotNull() & F.col("j._broken").isNull()
    return x.where(ok).select("path", *[F.col(f"j.{n}").alias(n) for n in names]), x.where(~ok).select("path", F.col("value").alias("line"))


def annotation_games(spark: SparkSession, root: str) -> DataFrame:
    """Games of the listed split files with source and split from their path.

    ``<root>/<source>/split/<split>.json``; files of other names are not read.
    """
    games = _with_file(spark.read.schema(ANNOTATION_GAME).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "{" + ",".join(f"{s}.json" for s in SPLITS) + "}").json(root))
    m = lambda i: F.regexp_extract("path", r"([^/]+)/split/([^/]+)\.json$", i)
    x = games.select(m(1).alias("source"), m(2).alias("split"), F.coalesce("video_name", "YT_ID", "EG_ID").alias("session"), F.col("Game_ID").alias("game"), "playerNames", "Dialogue")
    return x.where("source <> '' and session is not null and game is not null")


def outcomes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Outcome sessions, files of objects keyed by game: one row for each session and game."""
    raw = _with_file(spark.read.text(path, wholetext=True))
    x = raw.select(F.regexp_extract("path", r"([^/]+)\.json$", 1).alias("session"), F.explode(F.from_json("value", f"map<string,{OUTCOME}>")).alias("game", "o"))
    return x.select("session", "game", "o.*")


def read_csv(spark: SparkSession, paths: dict[str, str], schema: str, label: str) -> DataFrame:
    """CSV files of one schema in one table, each with its label."""
    out = None
    for name, path in sorted(paths.items()):
        one = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path).withColumn(label, F.lit(name))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no file")
    return out


def read_lexicon_xml(spark: SparkSession, path: str, row: str = "entry") -> DataFrame:
    """Entries of a lexicon in XML: marker, category, frequency, is_discontinuous."""
    schema = "orths struct<orth:array<struct<part:array<struct<_VALUE:string,_type:string>>>>>, syn array<struct<sem:array<struct<pdtb3_relation:array<struct<_sense:string,_freq:long>>>>>>"
    raw = spark.read.format("xml").option("rowTag", row).schema(schema).load(path)
    m = raw.select(F.explode("orths.orth").alias("o"), "syn")
    m = m.select(F.lower(F.array_join(F.transform("o.part", lambda p: F.trim(p["_VALUE"])), " ")).alias("marker"), (F.size("o.part") > 1).alias("is_discontinuous"), F.explode_outer(F.flatten(F.flatten(F.transform("syn", lambda s: F.transform(s["sem"], lambda t: t["pdtb3_relation"]))))).alias("r"))
    return m.select("marker", F.initcap(F.split("r._sense", r"\.")[0]).alias("category"), F.col("r._freq").alias("frequency"), "is_discontinuous").distinct()


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Whole transcript files with their path."""
    return _with_file(spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(path, wholetext=True))


def result_files(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Result records with model, stage, prompt version, run and source from their path.

    ``…/<model>[__ft_<stage>]/prompt_<version>[_<run>]/<source>/<file>.json``.
    """
    x = scan_json(spark, root, schema)
    p = r"/([^/]+)/prompt_(v[^_/]+)(?:_([^/]+))?/([^/]+)/[^/]+\.json$"
    part = lambda i: F.nullif(F.regexp_extract("path", p, i), F.lit(""))
    model = F.split(part(1), "__ft_")
    return x.select("*", F.get(model, 0).alias("model_dir"), F.coalesce(F.get(model, 1), F.lit("base")).alias("stage"), part(2).alias("prompt_version"), part(3).alias("run_label"), part(4).alias("result_source"))


def one_model(results: DataFrame, part: str) -> DataFrame:
    """Results of the one model whose directory holds ``part``; none or several are an error."""
    names = [r[0] for r in results.where(F.col("model_dir").contains(part)).select("model_dir").distinct().limit(2).collect()]
    if len(names) != 1:
        raise ValueError(f"{part!r} fits {names or 'no model'}")
    return results.where(F.col("model_dir") == names[0])
