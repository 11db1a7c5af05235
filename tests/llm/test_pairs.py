"""Defective pairs: labelled cases of every kind, which validate the cutoffs."""

import random

import numpy as np
import pytest

from palaver.llm import pairs as P

Q = "The Seer swaps the cards of Ann and Bob during the night. Which team does Ann belong to at dawn?"
D = "Seher tauscht in der Nacht die Karten von Ann und Bob. Zu welcher Seite gehört Ann am Morgen?"
CASES = [
    (Q, '{"justification": "Ann keeps the last card, so the final role counts.", "answer": "The village"}', None),
    (Q, '```json\n{"justification": "Bob cannot refuse the exchange, and sorry as that is for Ann, the new card decides.", "answer": "Bob"}\n```', None),
    (Q, '{"justification": "The card moves. I can\'t see any other reading.", "answer": "Ann"}', None),
    (Q, '{"justification": "Only the last move counts. C\'est la vie for the Seer.", "answer": "Ann"}', None),
    (Q, f'{{"justification": "{Q} The last card decides the team, and Ann has no say in the matter.", "answer": "The village"}}', None),
    (D, '{"justification": "Das Team richtet sich nach der Karte, die bei der Abstimmung vor Ann liegt.", "answer": "Das Dorf"}', None),
    (Q, None, "empty"), (Q, " \n", "empty"), (Q, "{}", "empty"), (Q, '```json\n```', "empty"), (Q, '{"justification": null, "answer": null}', "empty"), (Q, '{"justification": "...", "answer": "-"}', "empty"), (Q, "N/A", "empty"),
    (Q, "I must decline to respond to this question.", "refusal"), (Q, '{"justification": "With respect, naming a liar is not something I am comfortable doing. Please ask something else.", "answer": "N/A"}', "refusal"),
    (D, "Leider kann ich diese Frage nicht beantworten.", "refusal"), (Q, '{"justification": "The safest course is for me not to answer.", "answer": ""}', "refusal"),
    (Q, Q, "copy"), (Q, '{"justification": "You asked: ' + Q + '", "answer": "?"}', "copy"), (Q, Q.upper(), "copy"), (Q, "which team does ann belong to at dawn", "copy"),
    (Q, '{"justification": "La dernière carte compte et le rôle de Ann est perdu pour le village.", "answer": "Le village"}', "language"),
    (Q, '{"justification": "Höchstens eine Aussage stimmt, denn diese Karte gibt es nur einmal.", "answer": "Das Dorf"}', "language"),
    (D, '{"justification": "The order of waking decides this, for the earlier knowledge is stale.", "answer": "Ann"}', "language"),
]


SCHEMA = "row_id long, question string, raw string, cut_lr double, cut_prior double, at_cap boolean"
SAYS = {
    "en": ["The card that lies in front of a player decides the team.", "Whoever woke after the last move can be sure of the role.", "Both players have the same votes, so both of them leave.", "Only one of the claims can be right, as that card is unique."],
    "de": ["Die Karte vor einem Spieler entscheidet über die Seite.", "Wer nach dem letzten Tausch wach war, kann sich der Rolle sicher sein.", "Beide haben gleich viele Stimmen, also scheiden beide aus.", "Nur eine der Aussagen kann stimmen, denn die Karte gibt es einmal."],
    "fr": ["La carte posée devant un joueur décide de son camp.", "Celui qui se réveille après le dernier échange est sûr de son rôle.", "Les deux ont autant de voix, donc les deux quittent la partie.", "Une seule des affirmations peut être juste, car la carte est unique."],
}
ASKS = {"en": "What does {a} know about {b} once the night is over?", "de": "Was weiß {a} über {b}, wenn die Nacht vorbei ist?", "fr": "Que sait {a} de {b} quand la nuit est finie ?"}
REFUSES = {
    "en": ["I cannot discuss that.", "I would rather not give an answer here.", "My rules do not let me judge a person.", "Let us leave this matter to me and others.", "I am not able to help with it.", "I decline to say more.", "I must leave this question open.", "I refuse to respond to that."],
    "de": ["Ich kann dazu leider nichts sagen.", "Diese Frage möchte ich nicht beantworten.", "Leider darf ich darüber nicht urteilen."],
    "fr": ["Je ne peux pas en parler.", "Je préfère ne pas répondre à cette question.", "Il ne m'appartient pas de juger."],
}
#: More text of each language, so that its trigrams are known.
MORE = {
    "en": "With respect, naming people is not something that I would be comfortable doing. Please ask something else, for the answer would not help. She took the bus to the market and bought bread, milk and apples. My neighbours often tell me what they think about the weather. The order of waking is stale news by now. Nobody knows why the rules let them judge a person who left this matter to others.",
    "de": "Mit dem Bus fuhr sie zum Markt und kaufte Brot, Milch und Äpfel. Meine Nachbarn erzählen mir oft, was sie über das Wetter denken. Niemand weiß, warum die Regeln das erlauben. Bei dieser Frage hilft die Antwort nicht, sagte er am Morgen. Zu welcher Seite gehört der Nachbar, der die Karten tauscht?",
    "fr": "Elle a pris le bus pour aller au marché et a acheté du pain, du lait et des pommes. Mes voisins me disent souvent ce qu'ils pensent du temps. Personne ne sait pourquoi les règles le permettent. À cette question la réponse n'aide pas, dit-il au matin.",
}


def _texts(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(SAYS[k]) for _ in range(6)) + " " + MORE[k] + " " + ASKS[k].format(a="Ann", b="Bob"), k + rng.choice(["", "-XX", "_x"])) for i, k in enumerate(list(SAYS) * 40)]
    return spark.createDataFrame([*rows, (900, None, "en"), (901, "x", None), (902, "...", "zz")], "doc_id long, text string, lang string")


def _labelled(n=1200):
    """Pairs of every kind with their defect: sound, refusal, copy, language, empty, truncated."""
    rng, out = random.Random(9), []
    for i in range(n):
        k = rng.choice(list(SAYS))
        a, b = rng.sample(["Ann", "Bob", "Cyd", "Dora", "Emil", "Fritz"], 2)
        q = ASKS[k].format(a=a, b=b)
        kind = rng.choices([None, "refusal", "copy", "language", "empty", "truncated"], [10, 1, 1, 1, 1, 1])[0]
        said = f"{a}: " + " ".join(rng.sample(SAYS[rng.choice([x for x in SAYS if x != k]) if kind == "language" else k], 2))
        answer, lr = b, -8.0
        if kind == "refusal":
            said, answer = rng.choice(REFUSES[k]), rng.choice(["", "none", "N/A"])
        elif kind == "copy":
            said, answer = rng.choice([q, q.lower().rstrip(" ?"), q.upper()]), rng.choice(["", "?"])
        elif kind == "empty":
            said, answer = rng.choice(["", "...", "-"]), rng.choice(["", "-"])
        raw = f'{{"justification": "{said}", "answer": "{answer}"}}'
        if kind == "refusal" and rng.random() < 0.4:
            raw = said
        if kind == "truncated":
            raw, lr = raw[: rng.randrange(30, 60)], 8.0
        out.append((20_000 + i, q, raw, lr, 0.03, kind == "truncated" and rng.random() < 0.5, kind))
    return out


@pytest.fixture(scope="module")
def judged(spark):
    rows = [(i, q, r, -9.0, 0.001, False) for i, (q, r, _) in enumerate(CASES)]
    # Many sound pairs around them, as the label model takes defects to be rare.
    rows += [(1000 + i, *CASES[i % 6][:2], -9.0, 0.001, False) for i in range(400)]
    rows.append((5000, Q, '{"justification": "Ann keeps the la', 9.0, 0.99, True))
    rows += [r[:6] for r in _labelled()]
    return P.judged(spark.createDataFrame(rows, SCHEMA), _texts(spark)).toPandas().set_index("row_id")


@pytest.fixture(scope="module")
def found(spark, judged):
    df = spark.createDataFrame(judged.reset_index())
    return {r["row_id"]: r["defect"] for r in P.worst(P.defects(df)).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_case(found, i):
    assert found.get(i) == CASES[i][2]


def test_truncated_and_sound(found):
    assert found[5000] == "truncated" and not any(1000 <= k < 5000 for k in found)


def post_all(judged, d, labelled):
    return [judged[d][r[0]] for r in labelled]


def test_cutoffs_are_those_of_a_sweep_and_hold_out(judged):
    labelled = _labelled()
    for d in P.DEFECTS:
        post, truth = np.array([judged[d][r[0]] for r in labelled]), np.array([r[6] == d for r in labelled])
        cutoff, f1 = P.best_cutoff(post[::2], truth[::2])
        held = post[1::2] > P.CUTOFFS[d]
        assert cutoff == pytest.approx(P.CUTOFFS[d]) and f1 > 0.95, (d, cutoff, f1, [r for r, p, t in zip(labelled, post_all(judged, d, labelled), [r[6] == d for r in labelled]) if (p > 0.5) != t][:5])
        assert 2 * (held & truth[1::2]).sum() / (held.sum() + truth[1::2].sum()) > 0.95


def test_languages_are_told_apart(spark):
    from palaver.llm import languages as L

    m = L.Languages(_texts(spark), "doc_id")
    assert m.names == ["de", "en", "fr"]
    lang, sure = L.told(m.log_p, L.Trigrams(), [SAYS["fr"][1], "Die Nacht ist vorbei und niemand weiß es.", "", "?!", "Who leaves the game?\nBoth of them."])
    assert [m.names[i] if i >= 0 else None for i in lang] == ["fr", "de", None, None, "en"] and sure[2] == 0
    none = L.Languages(_texts(spark).where("lang like 'de%'"), "doc_id")
    assert L.told(none.log_p, L.Trigrams(), ["Der"])[0].tolist() == [-1]


@pytest.mark.parametrize("raw,want", [('{"a": "b"}', 0), ('{"a": "b', 1), ('{"a": "b", ', 1), ('"a": "b"}', 0), ('Answer: "a": "b', 1), ("plain words", -1), ("", -1), ('{"a": b}', -1), ('```json\n{"a": 1}\n``` Done.', 0)])
def test_parser(raw, want):
    assert P.parses(raw) == want


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert P.defects(P.judged(df, _texts(spark).limit(0))).count() == 0


def test_nulls_and_very_long():
    vote = P.Voter(np.zeros(P.FEATURES, np.float32), 0.0, np.zeros((1 << 16, 0), np.float32))
    got = vote([None, "x " * 50_000, "q"], [None, "y " * 50_000, None], [None, 0.0, None], [None, 0.1, None], [False, True, False])
    assert all(len(g) == sum(P._LFS.values()) for g in got)


def test_label_model_finds_planted_rates():
    rng = np.random.default_rng(0)
    y = rng.random(20_000) < 0.1
    v = np.stack([np.where(y, rng.random(y.size) < s, rng.random(y.size) < f).astype(int) for s, f in ((0.9, 0.02), (0.8, 0.05), (0.7, 0.01))], 1)
    pats, inv, n = np.unique(v, axis=0, return_inverse=True, return_counts=True)
    post = P.label_model([tuple(p) for p in pats], list(n))
    p = np.array([post[tuple(x)] for x in pats])[inv.ravel()]
    assert abs(p.mean() - 0.1) < 0.02 and ((p > 0.5) == y).mean() > 0.97
    assert P.label_model([], []) == {}
