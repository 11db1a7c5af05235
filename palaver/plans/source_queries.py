"""Queries of sources and sinks (S01-S09, S13, S15-S19, S21, S22): what was written is read again.

Files go below the checkpoint folder, which all executors share. Whole tables are written and read
where a sink takes tables; formats that the tables do not have are read from small fixtures.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from palaver.plans.silver import games, slots, sql, votes
from palaver.session import checkpoint_folder
from palaver.sources import readers as R
from palaver.sources import transcripts as TR
from palaver.sources import writers as W
from palaver.tables import first_delivery, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, statement: str, long: bool = False):
    def keep(fn):
        QUERIES[name] = fn
        SQL[name] = sql(statement) if long else statement
        return fn

    return keep


def _folder(spark) -> str:
    return f"{checkpoint_folder(spark)}/sources-{uuid.uuid4().hex}"


def _put(spark, root: str, files: dict[str, str]) -> str:
    for name, text in files.items():
        W.put_text(spark, f"{root}/{name}", text)
    return root


GAME = {"video_name": "v1", "Game_ID": "Game1", "playerNames": ["Ann", "Bob"], "Dialogue": [{"Rec_Id": 1, "speaker": "Ann", "timestamp": "00:01", "utterance": "Hi.", "annotation": "No Strategy"}, {"Rec_Id": 2, "speaker": "Bob", "timestamp": "00:02", "utterance": "I am the Seer.", "annotation": "Identity Declaration"}]}


@query("S01_document", "select * from (values ('S', 2)) t(source, n_items)")
def s01(spark, d):
    """A JSON document over several lines under a fixed schema; a broken one is left out."""
    doc = {"metadata": {"source": "S"}, "items": [{"line_number": 3}, {"line_number": None}]}
    root = _put(spark, _folder(spark), {"a.json": json.dumps(doc, indent=1), "b.json": '{"metadata": '})
    return R.read_json(spark, root, R.ACCUSATION).select("metadata.source", F.size("items").alias("n_items"))


@query("S02_json_lines", "select result_path, file_row_id, model_name, justification from v", True)
def s02(spark, d):
    """All vote rows as JSON lines and back."""
    root = _folder(spark)
    votes(spark, d).select("result_path", "file_row_id", "model_name", "justification").write.json(root)
    ok, _ = R.read_jsonl(spark, root, "result_path string, file_row_id long, model_name string, justification string")
    return ok.drop("path")


@query("S03_broken_lines", "select distinct replace(replace(record, chr(10), ' '), chr(13), ' ') as line from raw_records where trim(replace(replace(record, chr(10), ' '), chr(13), ' ')) <> '' and not json_valid(replace(replace(record, chr(10), ' '), chr(13), ' '))")
def s03(spark, d):
    """The different lines of exported records that do not parse, from a text file of them all."""
    root = _folder(spark)
    table(spark, d, "raw_records").where("record is not null").select(F.translate("record", "\n\r", "  ").alias("value")).write.text(root)
    _, broken = R.read_jsonl(spark, root, "_ string")
    return broken.select("line").distinct()


@query("S04_json_scan", "select * from (values ('x.json', 'S', 0), ('y.json', 'T', 1)) t(file, source, n_items)")
def s04(spark, d):
    """All JSON files below a folder; malformed ones and other files are left out."""
    one = lambda s, n: json.dumps({"metadata": {"source": s}, "items": [{"line_number": 1}] * n})
    root = _put(spark, _folder(spark), {"x.json": one("S", 0), "a/b/y.json": one("T", 1), "a/broken.json": "{", "a/z.txt": one("U", 1)})
    return R.scan_json(spark, root, R.ACCUSATION).select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), "metadata.source", F.size("items").alias("n_items"))


@query("S05_split_files", "select * from (values ('Tube', 'train', 'v1', 'Game1', 2), ('Ego', 'test', 'v1', 'Game1', 2)) t(source, split, session, game, n_lines)")
def s05(spark, d):
    """Games of the listed split files (S05, S06); a file of another name is not read."""
    root = _put(spark, _folder(spark), {"Tube/split/train.json": json.dumps([GAME]), "Ego/split/test.json": json.dumps([GAME]), "Tube/split/other.json": json.dumps([GAME])})
    return R.annotation_games(spark, root).select("source", "split", "session", "game", F.size("Dialogue").alias("n_lines"))


@query("S07_outcomes", "select * from (values ('s1', 'Game1', 1, '0|NA'), ('s1', 'Game2', null, null), ('s2', 'Game1', 2, '1')) t(session, game, n_players, votes)")
def s07(spark, d):
    """Outcome files keyed by game, with the session from the file's stem."""
    root = _put(spark, _folder(spark), {"s1.json": json.dumps({"Game1": {"playerNames": ["A"], "votingOutcome": [0, "NA"]}, "Game2": {}}), "s2.json": json.dumps({"Game1": {"playerNames": ["A", "B"], "votingOutcome": [1]}})})
    return R.outcomes(spark, root).select("session", "game", F.when(F.col("playerNames").isNotNull(), F.size("playerNames")).alias("n_players"), F.array_join("votingOutcome", "|").alias("votes"))


@query("S08_csv_concat", " select game_no, player_names, start_roles, 'even' as part from g where game_no % 2 = 0 union all select game_no, player_names, start_roles, 'odd' from g where game_no % 2 = 1", True)
def s08(spark, d):
    """All games as CSV files with JSON cells (S17), read as one table with a label of their file."""
    root, g = _folder(spark), games(spark, d).select("game_no", "player_names", "start_roles")
    for k, part in enumerate(("even", "odd")):
        W.write_csv(g.where(F.col("game_no") % 2 == k), f"{root}/{part}")
    back = R.read_csv(spark, {p: f"{root}/{p}" for p in ("even", "odd")}, "game_no long, player_names string, start_roles string", "part")
    return W.read_json_cells(back, {"player_names": "array<string>", "start_roles": "array<string>"})


@query("S09_lexicon_xml", "select * from (values ('as long as', 'Contingency', 5, false), ('either or', 'Expansion', 2, true)) t(marker, category, frequency, is_discontinuous)")
def s09(spark, d):
    """Entries of a lexicon in XML, with nested spellings and relations."""
    entry = lambda parts, sense, n: "<entry><orths><orth>" + "".join(f'<part type="p">{p}</part>' for p in parts) + f'</orth></orths><syn><sem><pdtb3_relation sense="{sense}" freq="{n}"/></sem></syn></entry>'
    root = _put(spark, _folder(spark), {"l.xml": "<lexicon>" + entry(["as long as"], "contingency.condition", 5) + entry(["either", "or"], "expansion.disjunction", 2) + "</lexicon>"})
    return R.read_lexicon_xml(spark, f"{root}/l.xml")


@query("S13_line_speakers", "select * from (values ('g', 1, 'Ann'), ('g', 2, 'Bob'), ('g', 4, 'Ann')) t(file, number, speaker)")
def s13(spark, d):
    """Line numbers and their speakers in processed transcripts; malformed lines have none."""
    text = "Source: S\nSession: s\nGame: Game1\nPlayers: Ann, Bob\n\nTranscript:\n[1] Ann: Hello.\n[2] Bob: I am: the Seer.\nmalformed\n[4] Ann: x\n"
    root = _put(spark, _folder(spark), {"g.txt": text})
    t, _ = TR.turns_of(R.read_transcripts(spark, root).withColumnRenamed("value", "text"), "text")
    return t.select(F.regexp_extract("path", r"([^/]+)\.txt$", 1).alias("file"), "number", "speaker")


@query("S15_result_files", "select * from (values ('m1', 'x', 'v4', 'run_1', 'S', 'e'), ('m2', 'base', 'v3', null, 'T', null)) t(model_dir, stage, prompt_version, run_label, result_source, error)")
def s15(spark, d):
    """Result files with model, stage, prompt version, run and source from their path."""
    root = _put(spark, _folder(spark), {"voting/m1__ft_x/prompt_v4_run_1/S/g.json": '{"error": "e"}', "voting/m2/prompt_v3/T/h.json": '{"error": null}'})
    return R.result_files(spark, root, "error string").select("model_dir", "stage", "prompt_version", "run_label", "result_source", "error")


@query("S18_owned_tables", " select 'slots' as removed, (select count(*) from g) as n_games", True)
def s18(spark, d):
    """A folder of tables written twice: the second set owns it, so what it lacks is removed."""
    root = _folder(spark)
    W.write_tables({"games": games(spark, d), "slots": slots(spark, d)}, root)
    gone = W.write_tables({"games": games(spark, d)}, root)
    return spark.read.parquet(f"{root}/games").agg(F.lit(",".join(gone)).alias("removed"), F.count("*").alias("n_games"))


@query("S19_appended", " select game_id, player from slot", True)
def s19(spark, d):
    """Seats added to JSON lines in two goes."""
    root, s = _folder(spark), slots(spark, d).select("game_no", "game_id", "player")
    for k in (0, 1):
        W.append_jsonl(s.where(F.col("game_no") % 2 == k).drop("game_no"), root)
    return R.read_jsonl(spark, root, "game_id string, player string")[0].drop("path")


@query("S21_manifest", "select * from (values ('written'), ('agrees'), ('differs')) t(outcome)")
def s21(spark, d):
    """A run's manifest: written, found again, and refused to another run."""
    path, out = f"{_folder(spark)}/manifest.json", []
    for signature in ({"seed": 1}, {"seed": 1}, {"seed": 2}):
        try:
            out.append("written" if W.check_manifest(spark, path, signature) else "agrees")
        except ValueError:
            out.append("differs")
    return spark.createDataFrame([(o,) for o in out], "outcome string")


@query("S22_report", " select status || ' & ' || count(*) || ' \\\\' as line from v group by status", True)
def s22(spark, d):
    """The rows of a LaTeX report on vote states."""
    text = W.latex(votes(spark, d).groupBy("status").agg(F.count("*").alias("n")), ["status", "n"])
    rows = [x.replace(r"\_", "_").rstrip("\\").rstrip() for x in text.split("\n") if " & " in x and "status" not in x]
    return spark.createDataFrame([(r + r" \\",) for r in rows], "line string")
