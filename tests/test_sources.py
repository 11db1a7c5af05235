"""Readers and sinks on files, and the streaming counterparts."""

import json

import pytest
from pyspark.sql import functions as F

from palaver.sources import readers as R
from palaver.sources import writers as Wr
from palaver.streaming import streams as St


def test_json_scans_skip_broken_files(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/x.json").write_text(json.dumps({"metadata": {"source": "S"}, "items": []}))
    (tmp_path / "a/b/y.json").write_text('{"metadata": ')
    (tmp_path / "a/z.txt").write_text("no")
    df = R.scan_json(spark, str(tmp_path), R.ACCUSATION)
    assert [r["path"].rsplit("/", 1)[1] for r in df.collect()] == ["x.json"]


def test_json_lines(spark, tmp_path):
    p = tmp_path / "r.jsonl"
    p.write_text('{"a": 1, "b": "x"}\n\n   \n{"a": \n{"a": 2}\n')
    ok, broken = R.read_jsonl(spark, str(p), "a int, b string")
    assert sorted((r["a"], r["b"]) for r in ok.collect()) == [(1, "x"), (2, None)] and broken.count() == 1


def test_annotation_splits_leave_other_files_out(spark, tmp_path):
    d = tmp_path / "Tube/split"
    d.mkdir(parents=True)
    game = {"video_name": "v", "Game_ID": "Game1", "Dialogue": [{"Rec_Id": 1, "speaker": "A", "utterance": "u", "annotation": ["X"]}]}
    (d / "train.json").write_text(json.dumps([game]))
    (d / "other.json").write_text(json.dumps([game]))
    r = R.annotation_games(spark, str(tmp_path)).collect()
    assert len(r) == 1 and (r[0]["source"], r[0]["split"], r[0]["Dialogue"][0]["annotation"]) == ("Tube", "train", '["X"]')


def test_outcome_maps(spark, tmp_path):
    (tmp_path / "s1.json").write_text(json.dumps({"Game1": {"playerNames": ["A"], "votingOutcome": [0, "NA"]}, "Game2": {}}))
    got = {(r["session"], r["game"]): r["votingOutcome"] for r in R.outcomes(spark, str(tmp_path)).collect()}
    assert got == {("s1", "Game1"): ["0", "NA"], ("s1", "Game2"): None}


def test_csv_round_trip_with_json_cells(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", 'q"x'], "line\nbreak"), (2, None, None)], "k int, l array<string>, t string")
    Wr.write_csv(df, str(tmp_path / "c"))
    back = R.read_csv(spark, {"m": str(tmp_path / "c")}, "k int, l string, t string", "label")
    got = {r["k"]: r for r in Wr.read_json_cells(back, {"l": "array<string>"}).collect()}
    assert got[1]["l"] == ["a", 'q"x'] and got[1]["t"] == "line\nbreak" and got[2]["l"] is None and got[1]["label"] == "m"


def test_owned_directory_and_manifest(spark, tmp_path):
    df = spark.range(3)
    root = str(tmp_path / "t")
    Wr.write_tables({"a": df, "b": df}, root)
    assert Wr.write_tables({"a": df}, root) == ["b"] and spark.read.parquet(f"{root}/a").count() == 3
    m = str(tmp_path / "m/manifest.json")
    assert Wr.check_manifest(spark, m, {"x": 1}) and not Wr.check_manifest(spark, m, {"x": 1})
    with pytest.raises(ValueError):
        Wr.check_manifest(spark, m, {"x": 2})


def test_latex(spark):
    t = Wr.latex(spark.createDataFrame([("a_b", 0.5), (None, 2.0)], "k string, v double"), ["k", "v"])
    assert r"a\_b & 0.500 \\" in t and "-- & 2.000" in t


def test_xml_lexicon(spark, tmp_path):
    p = tmp_path / "l.xml"
    p.write_text('<lexicon><entry id="1"><orths><orth type="cont"><part type="phrasal">as long as</part></orth></orths><syn><sem><pdtb3_relation sense="contingency.condition" freq="5"/></sem></syn></entry></lexicon>')
    r = R.read_lexicon_xml(spark, str(p)).collect()
    assert [(x["marker"], x["category"], x["frequency"], x["is_discontinuous"]) for x in r] == [("as long as", "Contingency", 5, False)]


def test_result_paths(spark, tmp_path):
    d = tmp_path / "voting/m1__ft_x/prompt_v4_run_1/S"
    d.mkdir(parents=True)
    (d / "g.json").write_text('{"error": "e"}')
    x = R.result_files(spark, str(tmp_path), "error string")
    r = x.first()
    assert (r["model_dir"], r["stage"], r["prompt_version"], r["run_label"], r["result_source"]) == ("m1", "x", "v4", "run_1", "S")
    assert R.one_model(x, "m1").count() == 1
    with pytest.raises(ValueError):
        R.one_model(x, "zz")


def test_completed_records(spark):
    df = spark.createDataFrame([(1, None, [(1,), (2,)], [1, 2]), (2, "x", [(1,)], [1]), (3, None, [(1,)], [1, 2]), (4, None, None, [])], "k int, error string, items array<struct<line_number:int>>, expected array<int>")
    assert [r["k"] for r in Wr.completed(df, "error", "items", "expected").collect()] == [1]


def test_streams_equal_batches_and_resume(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"2026-01-01 {i % 5:02d}:{i % 60:02d}:00", "ab"[i % 2]) for i in range(200)], "id int, t string, k string").withColumn("t", F.to_timestamp("t"))
    src = str(tmp_path / "in")
    rows.unionByName(rows.limit(20)).repartition(3).write.parquet(src)
    s = St.first_deliveries(St.stream_table(spark, src, rows.schema), ["id"], "t")
    St.run_once(s, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 200
    St.run_once(s, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 200
    w = St.windowed_counts(St.stream_table(spark, src, rows.schema).dropDuplicates(["id"]), "t", "k")
    q = w.writeStream.outputMode("complete").format("memory").queryName("w1").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["start"], r["k"]): r["n"] for r in spark.sql("select * from w1").collect()}
    assert got == {(r["start"], r["k"]): r["n"] for r in St.windowed_counts(rows, "t", "k").collect()}
