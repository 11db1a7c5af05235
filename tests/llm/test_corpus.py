"""Tokens, containers, mixes and reading levels."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palaver.llm import mixing as M
from palaver.llm import packing as P
from palaver.llm import reading as R
from palaver.llm import tokens as K

here = pytest.mark.skipif(not os.path.exists(K.VOCABULARY), reason="no vocabulary files")


@here
def test_tokens_equal_another_library_and_round_trip(spark):
    from tokenizers import Tokenizer

    texts = ["Hello world, don't!", "Über\n\n  naïve 123 — ♪", "", None, "word " * 20_000]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens_old int")
    got = {r["doc_id"]: r["n_tokens"] for r in K.counted(df, ["doc_id"]).collect()}
    t = Tokenizer.from_file(os.path.join(os.path.dirname(K.VOCABULARY), "byte_bpe_50k.json"))
    assert got == {i: len(t.encode(x, add_special_tokens=False).ids) if x else 0 for i, x in enumerate(texts)}
    e = K.encoder()
    assert e.decode(e.encode_ordinary(texts[1])) == texts[1]


def _sizes(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, n_tokens long")


TIERS = [("s", 64), ("m", 256), ("l", 1024)]


@pytest.mark.parametrize("shard", [50_000, 150])
def test_packing_is_whole_and_within_capacity(spark, shard):
    rng = random.Random(1)
    rows = [(i, rng.choice([0, 1, 7, 40, 64, 100, 256, 300, 1024, 1025, 5000, rng.randrange(1, 900)])) for i in range(1500)] + [(9999, None)]
    got = P.pack(_sizes(spark, rows), TIERS, shard=shard, step_tokens=4096).toPandas()
    assert set(got.doc_id) == {i for i, _ in rows} and (got.groupby("doc_id").n_tokens.sum().to_dict() == {i: n or 0 for i, n in rows})
    cap = dict(TIERS)
    used = got.dropna(subset=["container_id"]).groupby(["container_kind", "container_id"]).n_tokens.sum()
    assert all(u <= cap[k] for (k, _), u in used.items())
    split = got[got.piece_no > 1].doc_id.unique()
    assert all(dict(rows)[i] > 1024 for i in split)
    waste = sum(cap[k] - u for (k, _), u in used.items())
    assert waste / sum(cap[k] for k, _ in used.index) < (0.05 if shard > 1000 else 0.15)
    c = P.containers(P.pack(_sizes(spark, rows), TIERS, shard=shard), TIERS).collect()
    assert all(r["unused_tokens"] >= 0 and r["used_tokens"] + r["unused_tokens"] == r["capacity_tokens"] for r in c)


def test_best_fit_against_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(30):
        s = np.sort(rng.integers(1, 50, 40))[::-1]
        where, room = P.best_fit(s, 50)
        left = []
        for x in s:  # the same rule without the bit set
            fit = [(r - x, i) for i, r in enumerate(left) if r >= x]
            if fit:
                left[min(fit)[1]] -= x
            else:
                left.append(50 - x)
        assert sorted(room) == sorted(left) and len(room) == len(left)
        assert all(s[where == c].sum() + room[c] == 50 for c in range(len(room)))


def test_packing_edges(spark):
    assert P.pack(_sizes(spark, []), TIERS).count() == 0
    with pytest.raises(ValueError):
        P.pack(_sizes(spark, [(1, 1)]), [("x", 0), ("y", None)])
    got = P.pack(_sizes(spark, [(1, 10), (2, 10)]), [("only", 10)]).collect()
    assert len({r["container_id"] for r in got}) == 2


def _pool(spark, n=3000, seed=0):
    rng = random.Random(seed)
    return spark.createDataFrame([(i, ["hot", "mid", "small"][0 if i % 3 == 0 else 1 if i % 50 else 2], rng.randrange(20, 400), rng.choice([1.0, 1.0, 0.5, 0.25])) for i in range(n)], "doc_id long, source string, n_tokens long, weight double")


TARGETS = [("a", "HOT ", 0.5, 1), ("a", "mid", 0.3, 2), ("a", "small", 0.2, 4), ("a", "absent", 1.0, 3), ("b", "small", 3.0, 5), ("b", "hot", 1.0, 1), ("c", "mid", None, 2), (None, "mid", 1.0, None)]


def test_mix_meets_targets_within_caps(spark):
    pool, t = _pool(spark), spark.createDataFrame(TARGETS, "mix_name string, source string, target_weight double, max_repeats int")
    plan = M.plan(pool, t)
    drawn = M.draw(pool, plan)
    got = {(r["mix_name"], r["source"]): r for r in M.shares(drawn, plan).collect()}
    for m, s, want in (("a", "hot", 0.5), ("a", "mid", 0.3), ("a", "small", 0.2), ("b", "small", 0.75), ("b", "hot", 0.25)):
        assert got[(m, s)]["actual_share"] == pytest.approx(want, abs=0.005) and got[(m, s)]["most_repeats"] <= got[(m, s)]["max_repeats"]
    assert got[("a", "absent")]["tokens"] == 0 and got[("a", "absent")]["target_share"] == 0.5
    again = {(r["mix_name"], r["doc_id"], r["repeats"]) for r in M.draw(pool.repartition(5), plan).collect()}
    assert again == {(r["mix_name"], r["doc_id"], r["repeats"]) for r in drawn.collect()}


def test_inclusion_follows_weights(spark):
    pool = spark.createDataFrame([(i, "s", 100, 1.0 if i % 2 else 0.25) for i in range(8000)], "doc_id long, source string, n_tokens long, weight double")
    t = spark.createDataFrame([("m", "s", 1.0, 1)], "mix_name string, source string, target_weight double, max_repeats int")
    got = M.draw(pool, M.plan(pool, t, budget=200_000.0)).groupBy((F.col("doc_id") % 2).alias("k")).count().collect()
    n = {r["k"]: r["count"] for r in got}
    assert sum(n.values()) == 2000 and n[1] / n[0] == pytest.approx(4.0, rel=0.15)


def test_mix_edges(spark):
    t = spark.createDataFrame(TARGETS, "mix_name string, source string, target_weight double, max_repeats int")
    empty = _pool(spark).limit(0)
    assert M.draw(empty, M.plan(empty, t)).count() == 0 and M.plan(_pool(spark), t.limit(0)).count() == 0


EASY = ["The cat sat.", "It was fun.", "We ran home.", "I saw a dog.", "He has a hat."]
MIDDLE = ["After the night ended, the table voted for the player who had lied the most.", "Some of us thought that the answer was only a lucky guess in the end.", "Because nobody wanted to speak first, the host asked everyone in turn."]
HARD = ["Epistemic asymmetry systematically privileges institutionalised scepticism throughout adversarial deliberation.", "The ostensibly disinterested arbitration substantially undermines procedurally dominant participants.", "Premature convergence disproportionately amplifies whatever inferential advantage remained."]


def _docs(seed, n):
    rng, out = random.Random(seed), []
    for i in range(n):
        g = i % 3
        own, other = (EASY, MIDDLE, HARD)[g], (MIDDLE, rng.choice([EASY, HARD]), MIDDLE)[g]
        out.append((i, " ".join(rng.choice(own if rng.random() < 0.8 else other) for _ in range(14)), g))
    return out


def test_levels_on_held_out_documents(spark):
    rows = _docs(0, 600)
    rng = random.Random(1)
    docs = spark.createDataFrame([(i, t, "en") for i, t, _ in rows] + [(9000, "", None), (9001, None, None), (9002, " ... ", None), (9003, "word " * 60_000, "x")], "doc_id long, text string, lang string")
    noisy = [(i, R.LEVELS[g if rng.random() > 0.05 else rng.randrange(3)], "r") for i, _, g in rows[:90]] + [(9000, "easy", "r"), (None, "hard", "r"), (3, None, "r"), (4, "other", "r")]
    labels = spark.createDataFrame(noisy, "doc_id long, reading_level string, rater string")
    got = {r["doc_id"]: r["reading_level"] for r in R.Model(docs, labels).scored(docs).collect()}
    held = [got[i] == R.LEVELS[g] for i, _, g in rows[90:]]
    assert sum(held) / len(held) > 0.95 and 9003 in got and not {9000, 9001, 9002} & set(got)


def test_no_labels_no_levels(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, reading_level string, rater string")
    assert R.Model(docs, none).scored(docs).count() == 0 and R.Model(docs.limit(0), none).scored(docs.limit(0)).count() == 0


def test_isotonic_is_monotone_and_least_squares():
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 30, 200).astype(float), rng.random(200)
    xs, f = R.isotonic(x, y)
    assert (np.diff(f) >= 0).all() and len(xs) == len(np.unique(x)) and f @ np.bincount(np.unique(x, return_inverse=True)[1]) == pytest.approx(y.sum())


def test_own_counts_are_taken_out():
    cutter = R.Ngrams(1 << 16)
    text = "A rare phrase indeed. Another one. A rare phrase indeed."
    keys = cutter([text]).keys
    t = np.zeros((R._TABLES, 1 << 16, 3), dtype=np.int32)
    for k in range(R._TABLES):
        np.add.at(t[k, :, 0], keys[k], 2)
    own = R.summaries(t, cutter, [text, "x"], [[0, 0], [1]])
    none = R.summaries(np.zeros_like(t), cutter, [text, "x"])
    assert own[0].tolist() == [0, 1] and own[1][0] == pytest.approx(none[1][0], abs=1e-6)


def test_tokens_equal_a_plain_reading():
    import re

    texts = ["The Seer Ann spoke. She saw NOTHING at all!\n- one, two; 3 cards…  And Übung\r\nTHE END OF BOB.", "", " ?! ", None, "naïve don't x2y 12:30 \u0130stanbul 𝔸b 😀.", "No stop", "A.b C. d"]

    def plain(text):
        out = []
        for s in re.split(r"(?<=[.!?…])\s+|[\r\n]+", text or ""):
            words = re.findall(r"[^\W\d_]+|\d+|[.,;:!?]", s)
            if any(w[0].isalnum() for w in words):
                out.append(["N" if i and s.upper() != s and w[0].isupper() else "".join(c.lower()[0] for c in w) for i, w in enumerate(words)])
        return out

    cutter = R.Ngrams(1 << 30)
    got, names = [], {}
    for which, part in R.sliced(texts, 30):
        t = cutter(part)
        for d, at, n in zip(t.doc, t.starts, t.lengths):
            got.append((which[d], t.keys[0][at : at + n - 1].tolist()))
    want = [(i, s) for i, t in enumerate(texts) for s in plain(t)]
    assert [(i, len(s)) for i, s in got] == [(i, len(s)) for i, s in want]
    for (_, hashes), (_, words) in zip(got, want):
        for h, w in zip(hashes, words):
            assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)


def test_parts_of_a_text_are_as_the_whole():
    rng = np.random.default_rng(0)
    t = rng.integers(0, 5, (R._TABLES, 1 << 16, 3)).astype(np.int32)
    texts = [d[1] for d in _docs(3, 30)] + ["", None]
    cutter = R.Ngrams(1 << 16)
    whole = R.summaries(t, cutter, texts)
    for x, y in zip(R.sentences(t, cutter(texts[:1])), np.concatenate([R.sentences(t, cutter(p)) for _, p in R.sliced(texts[:1], 50)])):
        assert x == pytest.approx(y)
    assert whole[1].shape == (30, 2)


def test_quantiles_by_group():
    rng = np.random.default_rng(0)
    doc, x = rng.integers(0, 6, 200), rng.random(200)
    doc[doc == 4] = 5
    for q in (0.0, 0.1, 0.5, 0.9, 1.0):
        got = R.quantile_by(doc, x, q, 6)
        assert np.isnan(got[4]) and all(got[g] == pytest.approx(np.quantile(x[doc == g], q)) for g in (0, 1, 2, 3, 5))


def test_all_labelled_documents_train(spark, monkeypatch):
    n = 20_500
    docs = spark.range(n).selectExpr("id as doc_id", "concat('text ', id) as text")
    labels = spark.range(n).selectExpr("id as doc_id", "element_at(array('easy', 'middle', 'hard'), cast(id % 3 as int) + 1) as reading_level", "'r' as rater")
    assert R.labelled(docs, labels).count() == n
    monkeypatch.setattr(R, "BROADCAST", 10)
    assert R.labelled(docs, labels).count() == n


def test_steps_fitted_by_ranges_equal_the_whole(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=3000), 2)
    grade = np.clip(np.round(x + rng.normal(scale=0.8, size=3000) + 1), 0, 2).astype(int)
    fit = spark.createDataFrame([(float(a), int(g)) for a, g in zip(x, grade)], "s1 double, grade int")
    for k in (1, 2):
        got, want = R.steps_fit(fit, "s1", k), R.isotonic(x, (grade >= k).astype(float))
        at = np.linspace(-4, 4, 2001)
        assert np.allclose(np.interp(at, *got), np.interp(at, *want), atol=1e-12) and len(got[0]) < len(want[0]) and (np.diff(got[0]) > 0).all()
