"""Conversations: verdicts on hand-made episodes, order, nulls, repeats, long episodes."""

from palaver.llm import conversations as C

SCHEMA = "message_id long, episode_id string, agent_name string, turn int, content string, visible_to string, sent_at timestamp, speaker string"
OPEN, CLOSE = "Welcome to the table, 3 players take part tonight.", "All votes are counted, the werewolves win."


def _episode(e, base=0, replies=("I saw it.", "Not me."), **change):
    rows = [("Moderator", OPEN, "all")]
    for i, r in enumerate(replies, 1):
        rows += [("Moderator", f"It is your turn to speak, player{i}.", "all"), (f"player{i}", r, "all")]
    rows.append(("Moderator", CLOSE, "all"))
    return [[e, a, base + t, c, v] for t, (a, c, v) in enumerate(rows)]


def _run(spark, episodes):
    import datetime

    rows = [(i, e, a, t, c, v, datetime.datetime(2026, 1, 1) + datetime.timedelta(seconds=i), "clash") for i, (e, a, t, c, v) in enumerate(x for ep in episodes for x in ep)]
    df = spark.createDataFrame(rows, SCHEMA)
    verdict, _ = C.rebuild(df)
    return {r["episode_id"]: r["reason"] for r in verdict.collect()}, df


def _common():
    return [_episode(f"ok{i}", base=i % 2) for i in range(12)]


def test_verdicts(spark):
    hole, clash, lost_turn, no_open, no_close = (_episode(k) for k in ("hole", "clash", "lost_turn", "no_open", "no_close"))
    del hole[3]
    clash.append(["clash", "player1", 2, "Something else.", "all"])
    lost_turn[2][2] = None
    del no_open[0]
    del no_close[-1]
    empty = _episode("empty", replies=(" ", "<timeout>"))
    blank = _episode("blank", replies=("I saw it.", "..."))
    wrong = _episode("wrong")
    wrong[2][1] = "player2"
    private = _episode("private")
    private[0][4] = '["player1"]'
    again = _episode("again")
    again += [["again", "PLAYER_1", 2, "  I  saw it. ", '"all"'], list(again[4])]
    got, _ = _run(spark, [*_common(), hole, clash, lost_turn, no_open, no_close, empty, blank, wrong, private, again])
    assert {k: v for k, v in got.items() if v} == {
        "hole": "broken", "clash": "broken", "lost_turn": "broken", "no_open": "broken", "no_close": "broken", "empty": "empty",
        "blank": "missing_reply", "wrong": "missing_reply", "private": "broken",
    }


def test_kept_conversations_are_in_order_with_roles(spark):
    ep = _common()
    _, df = _run(spark, [ep[0][::-1], *ep[1:]])
    rows = sorted((r["position"], r["speaker_role"], r["speaker"]) for r in C.conversations(df).where("episode_id = 'ok0'").collect())
    assert rows == [(1, "moderator", "moderator"), (2, "moderator", "moderator"), (3, "player", "player1"), (4, "moderator", "moderator"), (5, "player", "player2"), (6, "moderator", "moderator")]


def test_long_conversations_cross_blocks(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 4)
    good = _episode("long", replies=tuple("I say so." for _ in range(9)))
    gap = [[("gap" if x == "long" else x) for x in r] for r in good]
    del gap[8]
    silent = [[("silent" if x == "long" else x) for x in r] for r in good]
    silent[8][3] = "null"
    got, _ = _run(spark, [*_common(), good, gap, silent])
    assert (got["long"], got["gap"], got["silent"]) == (None, "broken", "missing_reply")


def test_nulls_and_empty_table(spark):
    got, _ = _run(spark, [[["n", None, None, None, None]], [[None, "player1", 1, "x", None]]])
    assert got == {"n": "empty", None: "broken"}
    assert C.rebuild(spark.createDataFrame([], SCHEMA))[0].count() == 0


def test_kahn_reveals_cycles_and_roots():
    row = lambda t, s: {"turn": t, "sent_at": s, "message_id": s, "speaker": "a", "says": True, "ahead": False, "to_all": True, "wording": 1, "same": s, "spoken": True, "addressee": None}
    out = list(C._kahn(("e", 0), [row(1, 1), row(2, 3), row(2, 2), row(3, 4)]))
    assert [o[4] for o in out] == [False, True, True, True]
    assert {o[5] for o in C._kahn(("e", 0), [row(1, 1), row(3, 2)])} == {2}


def test_verdicts_do_not_hang_on_the_number_of_conversations(spark):
    blank, hole = _episode("blank", replies=("I saw it.", "...")), _episode("hole")
    del hole[3]
    some = [*_common()[:3], blank, hole, _episode("odd", replies=("Yes.", "No."))]
    some[-1][0][3] = "A wording that nobody else uses opens this."
    few, df = _run(spark, some)
    copies = [[[f"{r[0]}#{k}", *r[1:]] for r in ep] for k in range(10) for ep in some]
    many, _ = _run(spark, copies)
    assert {k.split("#")[0]: v for k, v in many.items()} == few and len(many) == 10 * len(few)
    assert few["odd"] is None and few["blank"] == "missing_reply" and few["hole"] == "broken"
    # The way for very many wordings gives the same.
    order = C.ordered(C.messages(df))
    assert {r["episode_id"]: r["reason"] for r in C.verdicts(order, most=0).collect()} == few


def test_messages_without_turn_or_id_are_kept(spark):
    ep = _common()
    ep[0].append(["ok0", "player1", None, "Said at no turn.", "all"])
    ep[0].append(["ok0", "player2", None, "Said too.", "all"])
    _, df = _run(spark, ep)
    from pyspark.sql import functions as F

    df = df.withColumn("message_id", F.when(F.col("turn") != 2, F.col("message_id")))
    rows = C.conversations(df).where("episode_id = 'ok0'").collect()
    assert sorted(r["content"] for r in rows if r["position"] is None) == ["Said at no turn.", "Said too."]
    assert {r["position"]: r["content"] for r in rows}[3] == "I saw it." and len(rows) == 8
