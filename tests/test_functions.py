"""Column functions on the traps of the survey."""

import math

from pyspark.sql import functions as F

from palaver.functions import jsonx as J
from palaver.functions import keys as K
from palaver.functions import mathx as M
from palaver.functions import text as X
from palaver.sources import transcripts as T


def _one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first()["y"]


def test_session_keys_differ_on_marks(spark):
    x = " A#B  c_1-d "
    assert _one(spark, x, K.canonical_session) == "a b c_1-d"
    assert _one(spark, x, K.loose_session) == "a b c 1 d"
    assert _one(spark, "Game03", K.canonical_game) == "game3" and _one(spark, " Final ", K.canonical_game) == "final"
    assert _one(spark, None, K.canonical_game) is None


def test_sentences(spark):
    f = lambda t: _one(spark, t, X.sentences)
    assert f("He said \"it is e.g. a wolf.\" While Mr. Li left!? Ok.") == ['He said "it is e.g. a wolf."', "While Mr. Li left!?", "Ok."]
    assert f("so...') yes") == ["so...')", "yes"]
    assert f("") == [] and f(None) == [] and f("...") == []
    assert f("etc. and approx. two. Three") == ["etc. and approx. two.", "Three"]
    long = "word " * 20_000 + "end."
    assert f(long) == [long.strip()]


def test_word_counts_differ(spark):
    t = "don't well-known  ünïcode 3"
    assert _one(spark, t, X.word_count) == 4 and _one(spark, t, X.space_words) == 4
    assert _one(spark, "", X.space_words) == 1 and _one(spark, None, X.word_count) == 0


def test_json_extraction(spark):
    f = lambda t: _one(spark, t, J.prepared)
    assert f('```json\n{"a": "}{", "b": 1}\n```') == '{"a": "}{", "b": 1}'
    assert f('x {bad} {"a":1} y') == '{"a":1}' and f('{"a":"cut') == '{"a":"cut' and f(None) is None
    assert _one(spark, 'x {bad} {"a":1} y', J.json_block) == "{bad}"
    assert _one(spark, '{"a": "}"} tail', J.json_block) == '{"a": "}'


def test_votes_and_rosters(spark):
    df = spark.createDataFrame([(["Ann", "bob"], " BOB "), (["Ann"], "No Werewolf"), (["Ann"], None), (None, "Ann")], "roster array<string>, vote string")
    got = [r["n"] for r in df.select(J.roster_name(F.col("vote"), F.col("roster")).alias("n")).collect()]
    assert got == ["bob", None, None, None]
    errs = [r["e"] for r in df.select(J.vote_errors(F.lit(True), F.lit("why"), F.col("vote"), F.col("roster")).alias("e")).collect()]
    assert errs[1] == [] and errs[2] == ["missing_chosen_vote", "chosen_vote_not_nonempty_string"] and errs[3][0].startswith("chosen_vote_not_in")


def test_transcript_lines(spark):
    p = lambda t: _one(spark, t, T.parsed_line)
    assert tuple(p("Ann (01:02): hi: there")) == ("Ann", "01:02", "hi: there") and tuple(p("Ann: hi")) == ("Ann", None, "hi") and p("no colon here") is None
    assert tuple(_one(spark, "[3] Bo: x", T.processed_turn)) == (3, "Bo", "x") and _one(spark, "Bo: x", T.processed_turn) is None
    h = _one(spark, "Source: S\nSession: T U\nGame: G1\nPlayers: A, B ,C\n\nTranscript:\n", T.header)
    assert h["source"] == "S" and h["players"] == ["A", "B", "C"]


def test_numerics():
    assert abs(M.chi2_sf(3.841458820694124, 1) - 0.05) < 1e-12 and abs(M.chi2_sf(18.307038053275146, 10) - 0.05) < 1e-12
    assert M.binomial_two_sided(2, 10) == 0.109375 and M.binomial_two_sided(0, 0) == 1.0
    assert abs(M.student_sf(2.228138851964939, 10) - 0.025) < 1e-12 and abs(M.normal_sf(1.959963984540054) - 0.025) < 1e-12


def test_hypergeometric(spark):
    df = spark.createDataFrame([(10, 3, 4), (5, 5, 2), (6, 0, 3), (4, 2, 9)], "n int, k int, m int")
    got = [r[0] for r in df.select(M.hypergeometric_two_or_more(F.col("n"), F.col("k"), F.least("m", "n"))).collect()]
    for g, (n, k, m) in zip(got, [(10, 3, 4), (5, 5, 2), (6, 0, 3), (4, 2, 4)]):
        want = sum(math.comb(k, i) * math.comb(n - k, m - i) for i in range(2, min(k, m) + 1)) / math.comb(n, m)
        assert abs(g - want) < 1e-12
