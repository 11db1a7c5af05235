"""Speaker turns: labels, wordless lines, blocks, nulls."""

import datetime
import random

import pytest

from palaver.llm import transcripts as T

LINES = "line_id long, game_id string, rec_id int, speaker string, time_mark string, utterance string, loaded_at timestamp, name string"
GAMES = "game_id string, player_names array<string>, indexed_at timestamp, label string"
AT = datetime.datetime(2026, 1, 1)


def _turns(spark, lines, names=("Calluna", "Jorund", "Tormund", "Drustan"), text=True):
    df = spark.createDataFrame([(i, "g", r, s, t, u, AT, "x") for i, (r, s, t, u) in enumerate(lines, 1)], LINES)
    g = spark.createDataFrame([("g", list(names), AT, "y"), ("g", list(names), AT, "y")], GAMES)
    return sorted((r["first_line_id"], r["last_line_id"], r["speaker"], r["text"]) for r in T.turns(df, g, text).collect())


@pytest.mark.parametrize("label,name", [
    ("Calluna:", "Calluna"), (" CALLUNA (01:02)", "Calluna"), (">> calluna", "Calluna"), ("Calluna (cont'd)", "Calluna"), ("Call", "Calluna"), ("Cal.", "Calluna"),
    ("Callluna", "Calluna"), ("Claluna", "Calluna"), ("Torund", "Tormund"), ("Player 2", "Jorund"), ("P4", "Drustan"), ("SEAT #3", "Tormund"), ("player1", "Calluna"),
    ("Announcer:", "Announcer"), ("GAME AUDIO", "Announcer"), ("Game app (audio):", "Announcer"), ("Narrator", "Announcer"), ("Gong", "Announcer"),
])
def test_labels(spark, label, name):
    assert [x[2] for x in _turns(spark, [(1, label, None, "Hello there.")])] == [name]


def test_lines_join_and_wordless_ones_go(spark):
    got = _turns(spark, [
        (1, "Calluna", "0:01", "Um, I- I saw [laughter] it."), (2, "Calluna", None, "*coughs* uh..."), (3, None, "0:03", "(00:03) And more, you know, here."), (5, None, None, "[0:00:04] Jorund: One thing: no."),
        (6, None, None, "One thing: yes."), (7, "Tormund", "9:99", "..."), (8, None, None, "Announcer : Point now."), (9, "", None, "[music]"), (10, "Jorund", "0:01", None), (11, "jorund", "0:00", "Done."),
    ])
    assert [(a, b, s) for a, b, s, _ in got] == [(1, 3, "Calluna"), (4, 5, "Jorund"), (7, 7, "Announcer"), (10, 10, "Jorund")]
    assert got[0][3] == "I saw it. And more, here." and got[1][3] == "One thing: no. One thing: yes."


def test_repeats_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "g", 1, "Calluna", None, "Hi.", AT, None), (1, "g", 1, "Calluna", None, "Hi.", AT, None), (2, "g", None, "Jorund", None, "Hi.", AT, None), (3, "g", 0, None, None, "Before anybody.", AT, None), (4, None, 1, "Zed", None, "x", AT, None)], LINES)
    g = spark.createDataFrame([("g", ["Calluna", None, "Jorund"], AT, None), ("h", None, AT, None)], GAMES)
    got = {(r["game_id"], r["first_line_id"], r["last_line_id"]) for r in T.turns(df, g).collect()}
    assert ("g", 1, 1) in got and all(k[1] not in (2, 3) for k in got)
    assert T.turns(df.limit(0), g.limit(0)).count() == 0


def test_blocks_give_the_same_turns(spark, monkeypatch):
    rng = random.Random(5)
    lines = [(i, rng.choice(["Calluna", "Jorund", None, None]) if i > 1 else "Calluna", None, rng.choice(["Yes.", "Um...", "No.", "Sure."])) for i in range(1, 120)]
    whole = _turns(spark, lines)
    monkeypatch.setattr(T, "BLOCK", 7)
    assert _turns(spark, lines) == whole
    said = [(i, s) for i, (_, s, _, u) in enumerate(lines, 1) if u != "Um..."]
    want, cur = [], None
    for i, s in said:
        if s and s != cur:
            cur = s
            want.append([i, i, s])
        elif want:
            want[-1][1] = i
    assert [list(x[:3]) for x in whole] == want


def test_same_number_is_ordered_by_clock():
    r = lambda i, c, n: {"rec_id": 1, "line_id": i, "name": n, "clock": c, "text": ""}
    out = list(T._blocks(("g", 0), [r(1, 9, "A"), r(2, 3, "B")]))
    assert [(o[4], o[5]) for o in out] == [("B", 2), ("A", 1)]


def test_weakest_edges_of_cycles_are_dropped_and_counted():
    r = lambda n, i, name, clock=None: {"rec_id": n, "line_id": i, "name": name, "clock": clock, "text": ""}
    # The clock of the second line is ahead of the third: its edge runs against the dialogue order.
    rows = [r(1, 1, "A", 10), r(2, 2, "B", 50), r(3, 3, "C", 30), r(4, 4, None, 60)]
    edges = T.precedence(rows)
    assert edges[(2, 1)] == T.CLOCK and edges[(2, 3)] == T.ORDER and edges[(0, 2)] == T.CLOCK
    assert T.topological(4, edges, lambda i: (rows[i]["rec_id"], i)) == ([0, 1, 2, 3], {1: 1})
    assert [o[-1] for o in T._blocks(("g", 0), rows)] == [0, 1, 0]
    # Within one record number the clock decides, but a line without a name stays behind its own.
    same = [r(1, 1, "A", 9), r(1, 2, "B", 5), r(2, 3, None, 1)]
    assert T.topological(3, T.precedence(same), lambda i: (same[i]["rec_id"], same[i]["line_id"], i))[0] == [1, 0, 2]


def test_strong_edges_always_hold():
    import random

    rng = random.Random(0)
    for _ in range(60):
        n = rng.randrange(1, 40)
        rows = sorted(({"rec_id": rng.randrange(15), "line_id": i, "name": rng.choice(["A", "B", None]), "clock": rng.choice([None, rng.randrange(50)]), "text": ""} for i in range(n)), key=lambda r: (r["rec_id"], r["line_id"]))
        edges = T.precedence(rows)
        order, dropped = T.topological(n, edges, lambda i: (rows[i]["rec_id"], rows[i]["line_id"], i))
        at = {v: k for k, v in enumerate(order)}
        assert sorted(order) == list(range(n)) and all(at[i] < at[j] for (i, j), w in edges.items() if w > T.CLOCK)
        assert sum(dropped.values()) >= sum(at[i] > at[j] for i, j in edges)

