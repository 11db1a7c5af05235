"""Question and response pairs that are useless as pairs, with the kind of their defect.

Noisy labelling functions vote on every defect (1 yes, 0 no, -1 no opinion). They look at different
things: the fields of a response and its bare characters; the sign of its ending, its token cap, its
length limit and a JSON parser; words in order, letter shingles and what is left over; trigrams of
letters trained on texts that name their language; and, for refusals, a classifier of words trained
on weak labels (an explanation whose answer field is hollow against one that answers), the grammar
of declining and what a response shares with its question. For each defect an
expectation-maximization label model weighs the functions over the counts of vote patterns, of which
there are few whatever the number of pairs, and gives each pattern a posterior. A pair keeps every
defect above the defect's cutoff; :func:`worst` takes one of them in a fixed order.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm.languages import Languages, Trigrams, told
from palaver.session import cut

DEFECTS = ("empty", "truncated", "copy", "refusal", "language")
#: Posterior above which a defect is kept, from the sweep over labelled cases in tests/llm/test_pairs.py.
CUTOFFS = {"empty": 0.5, "truncated": 0.5, "copy": 0.5, "refusal": 0.5, "language": 0.5}
_LFS = {"empty": 3, "truncated": 4, "copy": 4, "refusal": 5, "language": 3}

# Answers that hold no content.
_NOTHING = {"", "null", "none", "n/a", "na", "nan", "nil", "see above", "unknown", "undefined", "empty", "i cannot answer", "unable to answer", "no answer", "cannot answer"}

# Function words of a speaker and of denial in four languages.
_SELF = set("i i'm i'd i'll i've me my myself ich mich mir mein meine je j moi mon mes yo mí mi puedo debo quiero".split())
_DENY = set("not no nothing never cannot can't won't don't unable decline refuse refrain nicht nichts kein keine niemanden ne n pas rien no nada nunca".split())
_FRAME = re.compile(r"^\W*(?:(?:the )?question(?: is| was)?|you asked(?: me)?|asked|q\d*|die frage(?: ist| lautet)?|du fragst|frage|la question(?: est)?|vous demandez|question|la pregunta(?: es)?|pregunta|preguntas)\s*:", re.I)
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
#: Hash buckets of the refusal classifier's features.
FEATURES = 1 << 18


def contents(raw: str) -> tuple[str, str | None]:
    """(explanation, answer) inside a response: JSON string values if there are keys, else its text."""
    keys = list(re.finditer(r'"(\w+)"\s*:\s*(?:"((?:[^"\\]|\\.)*)("|$)|([^\s,}\]]*))', raw, re.S))
    if keys:
        said, answer = [], None
        for m in keys:
            text = m[2] if m[2] is not None else m[4].strip()
            text = "" if m[2] is None and text in ("null", "none") else text.replace('\\"', '"').replace("\\n", "\n")
            if "answer" in m[1].lower():
                answer = text
            else:
                said.append(text)
        return " ".join(said), answer
    text = re.sub(r"```\w*|<\|[^|>]*\|>", " ", raw)
    text = re.sub(r"^\s*(?:here is my answer|answer|final output|output|response)\s*:\s*", "", text, flags=re.I)
    return text.strip().strip("{}[]").strip(), None


def covered(answer: list[str], question: list[str]) -> float:
    """The share of the answer's words that lie in two or more consecutive words of the question.

    A word skipped by either side does not break a match (a dropped or changed word).
    """
    two = set(zip(question, question[1:])) | set(zip(question, question[2:])) | set(zip(question, question[3:]))
    hit = [False] * len(answer)
    for i in range(len(answer) - 1):
        for j in (i + 1, i + 2):
            if j < len(answer) and (answer[i], answer[j]) in two:
                hit[i] = hit[j] = True
    if len(answer) == 1:
        return float(answer[0] in question)
    return sum(hit) / max(1, len(answer))


def shingles(text: str, n: int = 5) -> set[str]:
    """Runs of ``n`` letters or digits, spaces and marks left out."""
    t = "".join(c for c in text.lower() if c.isalnum())
    return {t[i : i + n] for i in range(max(1, len(t) - n + 1))} if t else set()


def parses(raw: str) -> int:
    """0 if a JSON object in ``raw`` parses, 1 if it is at fault only by ending, -1 otherwise.

    An object whose opening brace is missing is read as if it were there.
    """
    t = re.sub(r"<\|[^|>]*\|>|```\w*", " ", raw).rstrip()
    at = t.find("{")
    m = re.match(r'[^{"\n]*(?="\w+"\s*:)', t)
    if m and (at < 0 or m.end() < at):
        t, at = "{" + t[m.end() :], 0
    if at < 0:
        return -1
    try:
        json.JSONDecoder(strict=False).raw_decode(t, at)
    except json.JSONDecodeError as e:
        return 1 if e.pos >= len(t) or e.msg.startswith("Unterminated") else -1
    except RecursionError:
        return -1
    return 0


@dataclass
class Pair:
    """A pair taken apart: words asked and said, the body, its sentences and the answer field."""

    raw: str
    asked: list[str]
    body: str
    answer: str | None
    text: str
    words: list[str]
    sentences: list[str]
    hollow: bool

    @classmethod
    def of(cls, question: str | None, raw: str | None) -> Pair:
        raw = (raw or "").replace("\u200b", " ")
        said, answer = contents(raw)
        ans = (answer or "").strip().strip(".").lower()
        hollow = answer is None or not _WORD.search(ans) or ans in _NOTHING
        body = said if _WORD.search(said) and said.strip().lower() not in _NOTHING else ""
        text = body if body or answer is None else (answer or "")
        words = [w.lower() for w in _WORD.findall(_FRAME.sub("", text))]
        asked = [w.lower() for w in _WORD.findall(re.sub(r"^\W*q\d+\s*:", "", question or "", flags=re.I))]
        return cls(raw, asked, body, answer, text, words, [x for x in _SENTENCE.split(text) if _WORD.search(x)], hollow)

    def weak(self) -> int:
        """The weak label that trains the refusal classifier: 1, 0, or -1 for none.

        An explanation in words of its own with a hollow answer field against one whose answer
        field says something that the explanation does not.
        """
        if self.answer is None or not self.body or covered(self.words, self.asked) > 0.6:
            return -1
        return 1 if self.hollow else -1 if self.answer.strip().lower() in self.body.lower() else 0


def features(sentence: str, asked: set[str]) -> list[int]:
    """Hashed single words and pairs of words; words of the question become one."""
    w = ["?" if x in asked else x for x in (y.lower() for y in _WORD.findall(sentence))]
    return [zlib.crc32(x.encode()) & (FEATURES - 1) for x in {*w, *map(" ".join, zip(["^", *w], w))}]


def _weights(counts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
    """(log odds that a feature adds, prior log odds) from feature counts (features x 2) of the two labels."""
    if n.min() <= 0:
        return np.zeros(len(counts), np.float32), 0.0
    p = n[1] / n.sum()
    return np.log((counts[:, 1] + 2 * p) / (counts[:, 0] + 2 * (1 - p)) * (1 - p) / p).astype(np.float32), float(np.log(p / (1 - p)))


def refusal_weights(pairs: DataFrame) -> tuple[np.ndarray, float]:
    """The refusal classifier, trained on all pairs (question, raw) that have a weak label."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = np.zeros((FEATURES + 1, 2), np.int64), np.zeros(2, np.int64)
        for b in batches:
            for q, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                p = Pair.of(q, raw)
                label = p.weak()
                if label >= 0:
                    asked = set(p.asked)
                    counts[list({f for s in p.sentences for f in features(s, asked)}), label] += 1
                    n[label] += 1
        counts[FEATURES] = n
        for label in (0, 1):
            at = np.flatnonzero(counts[:, label])
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(np.full(len(at), label, np.int32)), pa.array(counts[at, label])], names=["f", "label", "n"])

    # At most FEATURES x labels numbers.
    got = pairs.select("question", "raw").mapInArrow(scan, "f int, label int, n long").groupBy("f", "label").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((FEATURES + 1, 2))
    counts[got.column("f").to_numpy(), got.column("label").to_numpy()] = got.column("n").to_numpy()
    return _weights(counts[:FEATURES], counts[FEATURES])


class Voter:
    """All labelling functions over a batch of pairs."""

    def __init__(self, weights: np.ndarray, prior: float, log_p: np.ndarray) -> None:
        self.weights, self.prior, self.log_p, self.cutter = weights, prior, log_p, Trigrams()

    def __call__(self, questions: list, raws: list, cut_lr: list, cut_prior: list, at_cap: list) -> list[list[int]]:
        pairs = [Pair.of(q, r) for q, r in zip(questions, raws)]
        texts: list[str] = []
        for q, p in zip(questions, pairs):
            texts += [q or "", p.text, p.answer or "", *p.sentences]
        lang, sure = told(self.log_p, self.cutter, texts)
        out, at = [], 0
        for p, lr, prior, cap in zip(pairs, cut_lr, cut_prior, at_cap):
            end = at + 3 + len(p.sentences)
            out.append([*self._form(p, lr, prior, cap), *self._copy(p), *self._refusal(p), *self._language(p, lang[at:end], sure[at:end])])
            at = end
        return out

    def _form(self, p: Pair, lr: float | None, prior: float | None, cap: bool) -> list[int]:
        """Votes on empty and truncated."""
        open_ = lr is not None and lr > 0
        none = not p.body and p.hollow
        bare = re.sub(r'"\w+"\s*:|```\w*|<\|[^|>]*\|>|\b(?:null|none|n/a)\b', " ", p.raw, flags=re.I)
        empty = [int(none and not open_), int(not _WORD.search(bare)), int(not p.body) if p.answer is None or not p.hollow else int(none)]
        return [*empty, int(open_) if lr is not None else -1, 1 if cap else -1, 1 if prior is not None and prior > 0.5 else -1, parses(p.raw)]

    def _copy(self, p: Pair) -> list[int]:
        if not p.words or not p.asked:
            return [0, 0, -1, 0]
        share = covered(p.words, p.asked)
        left = round((1 - share) * len(p.words))
        few = len(p.words) <= 1.3 * len(p.asked) + 4 or len(set(p.words)) <= len(set(p.asked)) + 3
        mine = shingles(" ".join(p.words))
        said = [w.lower() for w in _WORD.findall(p.answer or "")]
        answered = int(p.hollow or (len(said) > 4 and covered(said, p.asked) > 0.8)) if p.answer is not None else -1
        return [int(share >= 0.8 and len(p.words) >= 4), int(left <= max(3, 0.12 * len(p.words)) and few and len(p.words) >= 4), answered, int(len(mine & shingles(" ".join(p.asked))) >= 0.75 * len(mine))]

    def _refusal(self, p: Pair) -> list[int]:
        if not p.words or not (p.body or not p.hollow):
            return [0, 0, -1, 0, 0]
        asked = set(p.asked)
        own = [self.weights[features(s, asked)] for s in p.sentences]
        # A feature that no labelled pair has weighs exactly nothing; words that are mostly so tell nothing.
        known = sum(int((w != 0).sum()) for w in own) >= 0.5 * sum(map(len, own))
        per = [float(w.sum()) for w in own]
        score = self.prior + sum(per)
        bad = sum(x + self.prior > 0 for x in per)
        said = [{y for w in map(str.lower, _WORD.findall(s)) for y in (w, *re.split("['’]", w))} for s in p.sentences]
        declines = sum(bool(w & _SELF and w & _DENY) for w in said)
        shared = sum(w in asked for w in p.words if len(w) > 4)
        return [
            int(score > 0) if known and abs(score) > 1 else -1, -1 if not known else 1 if bad == len(per) else 0 if not bad else -1,
            int(p.hollow and covered(p.words, p.asked) <= 0.6) if p.answer is not None and p.body else -1,
            1 if 2 * declines >= len(said) else -1, 0 if shared > 2 else -1,
        ]

    def _language(self, p: Pair, lang: np.ndarray, sure: np.ndarray) -> list[int]:
        q = lang[0]
        if q < 0 or sure[0] < 6 or not p.words:
            return [-1, -1, -1]
        known = sure[3:] >= 4
        foreign, native = int((known & (lang[3:] != q)).sum()), int((known & (lang[3:] == q)).sum())
        answer = int(lang[2] != q) if len(_WORD.findall(p.answer or "")) > 1 and sure[2] >= 4 else -1
        return [int(lang[1] != q) if sure[1] >= 6 else -1, int(foreign > native) if foreign + native else -1, answer]


def label_model(patterns: list[tuple[int, ...]], counts: list[int], rounds: int = 60) -> dict[tuple[int, ...], float]:
    """Posteriors of two-class conditionally independent voters by expectation-maximization.

    ``-1`` is no opinion and carries no weight. Starts at a rare defect with good voters; Beta priors
    keep rates inside (0, 1), so a voter that always or never fires stays harmless.
    """
    v, n = np.array(patterns, dtype=float), np.array(counts, dtype=float)
    if not len(v):
        return {}
    yes, no = (v == 1).astype(float), (v == 0).astype(float)
    k = v.shape[1]
    prior, sens, fall = 0.05, np.full(k, 0.9), np.full(k, 0.02)
    post = np.zeros(len(v))
    for _ in range(rounds):
        l1 = np.log(prior) + yes @ np.log(sens) + no @ np.log(1 - sens)
        l0 = np.log(1 - prior) + yes @ np.log(fall) + no @ np.log(1 - fall)
        new = 1 / (1 + np.exp(np.clip(l0 - l1, -500, 500)))
        done = np.abs(new - post).max() < 1e-10
        post = new
        if done:
            break
        w1, w0 = n * post, n * (1 - post)
        prior = (w1.sum() + 1) / (n.sum() + 20)
        sens = np.clip((yes.T @ w1 + 9) / ((yes + no).T @ w1 + 10), 0.5, 0.999)
        fall = np.clip((yes.T @ w0 + 0.2) / ((yes + no).T @ w0 + 10), 0.0005, 0.45)
    return {tuple(int(x) for x in p): float(q) for p, q in zip(patterns, post)}


def voted(pairs: DataFrame, weights: tuple[np.ndarray, float], languages: Languages) -> DataFrame:
    """``row_id`` and the votes on each defect as text (``v_<defect>``), one scan of the pairs."""
    sc = pairs.sparkSession.sparkContext
    model = sc.broadcast((*weights, languages.log_p))
    schema = f"row_id {dict(pairs.dtypes)['row_id']}, {', '.join(f'v_{d} string' for d in DEFECTS)}"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vote = Voter(*model.value)
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                got = vote(*(part.column(k).to_pylist() for k in range(1, 6)))
                arrays, at = [part.column(0)], 0
                for d in DEFECTS:
                    arrays.append(pa.array([",".join(map(str, g[at : at + _LFS[d]])) for g in got], type=pa.string()))
                    at += _LFS[d]
                yield pa.RecordBatch.from_arrays(arrays, names=["row_id", *[f"v_{d}" for d in DEFECTS]])

    return pairs.select("row_id", "question", "raw", F.col("cut_lr").cast("double"), F.col("cut_prior").cast("double"), F.coalesce("at_cap", F.lit(False))).mapInArrow(scan, schema)


def judged(pairs: DataFrame, texts: DataFrame, text_id: str = "doc_id", train: DataFrame | None = None) -> DataFrame:
    """``pairs`` (row_id, question, raw, cut_lr, cut_prior, at_cap) with a posterior for each defect.

    ``cut_lr`` is the evidence of an ending, ``cut_prior`` that of a length limit; ``texts`` (text,
    lang) teach languages and ``train`` (question, raw; ``pairs`` if not given) refusals. Nulls anywhere are allowed: without a question nothing is copied or
    foreign, without an ending's evidence nothing is cut. An empty table gives an empty result.
    """
    votes = cut(voted(pairs, refusal_weights(pairs if train is None else train), Languages(texts, text_id)))
    # At most 3 ** 5 patterns of one defect, whatever the number of pairs.
    pattern = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.col(f"v_{d}").alias("v")) for d in DEFECTS]))
    seen: dict[str, dict[str, int]] = {d: {} for d in DEFECTS}
    for r in votes.select(pattern.alias("p")).groupBy("p.d", "p.v").count().collect():
        seen[r[0]][r[1]] = r[2]
    out = votes
    for d in DEFECTS:
        post = label_model([tuple(map(int, v.split(","))) for v in seen[d]], list(seen[d].values()))
        look = pairs.sparkSession.createDataFrame([(",".join(map(str, p)), q) for p, q in post.items()] or [("", 0.0)], f"v_{d} string, {d} double")
        out = out.join(F.broadcast(look), f"v_{d}", "left")
    return out.select("row_id", *[F.coalesce(F.col(d), F.lit(0.0)).alias(d) for d in DEFECTS])


def best_cutoff(posterior: np.ndarray, truth: np.ndarray, grid: np.ndarray = np.arange(0.05, 1.0, 0.05)) -> tuple[float, float]:
    """(cutoff, F1) of the cutoff with the greatest F1 over labelled cases, the one nearest 0.5 at ties."""
    def f1(c: float) -> float:
        hit = posterior > c
        return 2 * float((hit & truth).sum()) / max(1, int(hit.sum() + truth.sum()))

    got = [(round(float(c), 4), f1(c)) for c in grid]
    top = max(f for _, f in got)
    return min((x for x in got if x[1] == top), key=lambda x: abs(x[0] - 0.5))


def defects(judgement: DataFrame) -> DataFrame:
    """One row for each pair and kept defect: row_id, defect, posterior."""
    kept = F.filter(F.array(*[F.struct(F.lit(d).alias("defect"), F.col(d).alias("posterior"), F.lit(CUTOFFS[d]).alias("c"), F.lit(i).alias("order")) for i, d in enumerate(DEFECTS)]), lambda s: s["posterior"] > s["c"])
    return judgement.select("row_id", F.explode(kept).alias("k")).select("row_id", "k.defect", "k.posterior", "k.order")


def worst(kept: DataFrame) -> DataFrame:
    """One defect for each defective pair, in a fixed order: no content before cut before copied before refused before another language."""
    return kept.groupBy("row_id").agg(F.min_by("defect", "order").alias("defect"))
