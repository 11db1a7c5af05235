"""Reading levels of documents from the surprisal of their text.

An interpolated trigram model is trained for each graded level on all labelled documents. Every sentence of a document gets its mean surprisal under each model, so a document has
a distribution of surprisal differences for each step of the scale: under the models below the step
less under those above it. The median of that distribution is mapped to the chance that the document
lies above the step by isotonic regression over the labelled documents, each scored without its own
counts; the chances of all steps add up to the grade, which rises with difficulty at every step.
Models are count tables of a bounded number of hash buckets, so what is broadcast is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.session import cut

LEVELS = ("easy", "middle", "hard")
#: Labelled documents up to which they are sent to all executors; more are joined by a shuffle.
BROADCAST = 500_000
#: Buckets of a count table are the power of two above a quarter of the training tokens, within these.
MIN_BUCKETS, MAX_BUCKETS = 1 << 16, 1 << 20
#: Characters that are handled at a time; a longer text is handled in parts that end with a sentence.
CHARS = 1_000_000
_VOCABULARY = 20_000
_TABLES = 5  # unigrams, bigrams, trigrams, one-word contexts, two-word contexts
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass
class Tokens:
    """The tokens of a batch: ``keys`` (tables x tokens buckets), ``starts`` of sentences, ``doc`` of each sentence."""

    keys: np.ndarray
    starts: np.ndarray
    doc: np.ndarray

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(np.append(self.starts, self.keys.shape[1]))


class Ngrams:
    """Cuts a batch of texts into sentences and tokens and hashes their n-grams, all in array operations.

    Tokens are runs of letters, runs of digits and marks; a sentence ends with its line or with a
    stop before a space. Case is folded, and words that are capitalised inside a sentence become one
    name. A sentence without letter or digit is left out.
    """

    def __init__(self, buckets: int) -> None:
        self.buckets = buckets
        n = 0x110000
        self.kind, self.flags, self.lower = np.zeros(n, np.uint8), np.zeros(n, np.uint8), np.arange(n, dtype=np.uint32)
        self.known = np.zeros(n, bool)
        self._learn(np.arange(0x3000))
        rng = np.random.default_rng(0)
        self.powers = rng.integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def _learn(self, codes: np.ndarray) -> None:
        for i in codes.tolist():
            c = chr(i)
            self.kind[i] = 2 if c.isdecimal() else 1 if c.isalnum() else 3 if c in ".,;:!?" else 0
            self.flags[i] = c.isspace() | (c in ".!?…") << 1 | c.isupper() << 2 | (c.upper() != c) << 3 | (c in "\r\n") << 4
            self.lower[i] = ord(c.lower()[0])
        self.known[codes] = True

    def __call__(self, texts: list[str]) -> Tokens:
        x = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        if not self.known[x].all():
            self._learn(np.unique(x[~self.known[x]]))
        kind, flags = self.kind[x], self.flags[x]
        before = np.concatenate([[0], kind[:-1]]) if len(x) else kind
        first = np.flatnonzero((kind > 0) & ((kind != before) | (kind == 3)))
        none = Tokens(np.zeros((_TABLES, 0), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        if not len(first):
            return none
        stop = np.concatenate([[0], flags[:-1] & 2])
        part = np.cumsum(((flags & 16) > 0) | (((flags & 1) > 0) & (stop > 0)))
        quiet, real = np.zeros(part[-1] + 1, bool), np.zeros(part[-1] + 1, bool)
        quiet[part[(flags & 8) > 0]] = True
        real[part[(kind == 1) | (kind == 2)]] = True
        tail = slice(first[0], None)
        place = np.arange(first[0], len(x)) - np.repeat(first, np.diff(np.append(first, len(x))))
        value = (self.lower[x[tail]].astype(np.uint64) + _M1) * self.powers[place & 63]
        value[kind[tail] == 0] = 0
        ids = np.add.reduceat(value, first - first[0])
        ids ^= ids >> np.uint64(31)
        keep = real[part[first]]
        first, ids = first[keep], ids[keep]
        if not len(first):
            return none
        at = part[first]
        head = np.concatenate([[True], at[1:] != at[:-1]])
        ids[~head & quiet[at] & ((flags[first] & 4) > 0)] = np.uint64(11)
        # Two edge tokens before each sentence, one after it.
        sentence = np.cumsum(head) - 1
        n = sentence[-1] + 1
        h = np.full(len(ids) + 3 * n, np.uint64(5))
        spot = np.arange(len(ids)) + 3 * sentence + 2
        h[spot] = ids
        begin = np.flatnonzero(head)
        end = np.append(begin[1:], len(ids)) + 3 * np.arange(n) + 2
        h[end] = np.uint64(7)
        k = np.sort(np.concatenate([spot, end]))
        a, b, c = h[k - 2], h[k - 1], h[k]
        bc, ab = b * _M1 + c, a * _M2 + b * _M1
        keys = np.stack([c * _M1, bc, a * _M2 + bc, b * _M2, ab])
        keys = (keys ^ (keys >> np.uint64(29))) * _M2
        docs = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        return Tokens(((keys >> np.uint64(40)) % np.uint64(self.buckets)).astype(np.int64), begin + np.arange(n), np.searchsorted(docs, first[begin], "right") - 1)


def sliced(texts: list[str | None], most: int = CHARS) -> Iterator[tuple[list[int], list[str]]]:
    """The texts in groups of about ``most`` characters, longer ones in parts that end with a line or sentence.

    No n-gram crosses a sentence, so the parts of a text have the tokens of the whole. A sentence
    that is longer than ``most`` stays whole.
    """
    which: list[int] = []
    held: list[str] = []
    size = 0
    for i, t in enumerate(texts):
        at, t = 0, t or ""
        while at < len(t):
            end = at + most
            if end < len(t):
                ends = [j for m in ("\n", ". ", "! ", "? ") if (j := t.rfind(m, at, end)) >= 0]
                end = max(ends) + 1 if ends else min((j for m in ("\n", ". ", "! ", "? ") if (j := t.find(m, end)) >= 0), default=len(t) - 1) + 1
            which.append(i)
            held.append(t[at:end])
            size += min(end, len(t)) - at
            at = end
            if size >= most:
                yield which, held
                which, held, size = [], [], 0
    if held:
        yield which, held


def _count(buckets: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Ngrams(buckets)
        totals = np.zeros((len(LEVELS), _TABLES * buckets), dtype=np.int64)
        for b in batches:
            grades = b.column(1).to_pylist()
            for which, texts in sliced(b.column(0).to_pylist()):
                t = cutter(texts)
                of = np.array(which)[np.repeat(t.doc, t.lengths)]
                flat = t.keys + np.arange(_TABLES)[:, None] * buckets
                for g in range(len(LEVELS)):
                    times = np.array([gs.count(g) for gs in grades])[of]
                    for k in range(_TABLES):
                        np.add.at(totals[g], flat[k][times > 0], times[times > 0])
        for g, table in enumerate(totals):
            at = np.flatnonzero(table)
            for i in range(0, len(at), 65_536):
                part = at[i : i + 65_536]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), g, dtype=np.int32)), pa.array(part.astype(np.int32)), pa.array(table[part])], names=["grade", "bucket", "n"])

    return scan


def surprisal(tables: np.ndarray, keys: np.ndarray, own: np.ndarray | None = None, tokens: np.ndarray | None = None) -> np.ndarray:
    """Surprisal (tokens x levels) under every level's model (tables x buckets x levels).

    ``own`` (tables x tokens x levels) and ``tokens`` (tokens x levels) are the counts that a
    training document gave itself, which are left out.
    """
    c = [tables[t][keys[t]].astype(np.float32) for t in range(_TABLES)]
    total = tables[0].sum(axis=0).astype(np.float32)[None, :]
    if own is not None:
        c = [np.maximum(x - own[t], 0) for t, x in enumerate(c)]
        total = np.maximum(total - tokens, 0)
    p1 = (c[0] + 0.5) / (total + 0.5 * _VOCABULARY)
    p2 = (np.minimum(c[1], c[3]) + 2 * p1) / (c[3] + 2)
    p3 = (np.minimum(c[2], c[4]) + 2 * p2) / (c[4] + 2)
    return -np.log(p3)


def _own(t: Tokens, of: np.ndarray, times: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """What each document counted itself: its own occurrences of each key times its ratings of each level."""
    own = np.empty((_TABLES, len(of), times.shape[1]), np.float32)
    for k in range(_TABLES):
        _, at, n = np.unique(of.astype(np.int64) * buckets + t.keys[k], return_inverse=True, return_counts=True)
        own[k] = n[at][:, None] * times[of]
    return own, np.bincount(of, minlength=len(times))[of][:, None] * times[of]


def sentences(tables: np.ndarray, t: Tokens, own: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Mean surprisal of each sentence's tokens under each level (sentences x levels)."""
    s = surprisal(tables, t.keys, *(own or ()))
    return np.add.reduceat(s, t.starts, axis=0) / t.lengths[:, None] if len(t.starts) else np.zeros((0, tables.shape[2]), np.float32)


def quantile_by(doc: np.ndarray, x: np.ndarray, q: float, n: int) -> np.ndarray:
    """The ``q`` quantile (linear between neighbours) of ``x`` in each of ``n`` groups; nan for an empty one."""
    order = np.lexsort((x, doc))
    count = np.bincount(doc, minlength=n)
    begin = np.cumsum(count) - count
    at = q * np.maximum(count - 1, 0)
    lo = np.floor(at).astype(np.int64)
    x = np.append(x[order], np.nan)
    safe = lambda i: np.where(count > 0, begin + np.minimum(i, np.maximum(count - 1, 0)), len(x) - 1)
    a, b = x[safe(lo)], x[safe(lo + 1)]
    return a + (b - a) * (at - lo)


def steps(per: np.ndarray) -> np.ndarray:
    """Surprisal differences (sentences x steps): least under the levels below a step less least above."""
    return np.stack([per[:, :k].min(axis=1) - per[:, k:].min(axis=1) for k in range(1, per.shape[1])], axis=1)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: increasing (x, fitted y) for each distinct x."""
    xs, where = np.unique(x, return_inverse=True)
    w = np.bincount(where).astype(float)
    v = np.bincount(where, weights=y) / w
    stack: list[list[float]] = []
    for value, weight in zip(v, w):
        stack.append([value, weight, 1])
        while len(stack) > 1 and stack[-2][0] >= stack[-1][0]:
            b, a = stack.pop(), stack.pop()
            stack.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return xs, np.repeat([s[0] for s in stack], [int(s[2]) for s in stack])


def pooled(xs: np.ndarray, total: np.ndarray, weight: np.ndarray, last: np.ndarray | None = None) -> list[list[float]]:
    """Pool-adjacent-violators: (first x, last x, sum, weight) of each block of rows that are ordered by x."""
    stack: list[list[float]] = []
    for row in zip(xs.tolist(), (xs if last is None else last).tolist(), total.tolist(), weight.tolist()):
        stack.append(list(row))
        while len(stack) > 1 and stack[-2][2] * stack[-1][3] >= stack[-1][2] * stack[-2][3]:
            b, a = stack.pop(), stack.pop()
            stack.append([a[0], b[1], a[2] + b[2], a[3] + b[3]])
    return stack


def steps_fit(fit: DataFrame, x: str, step: int) -> tuple[np.ndarray, np.ndarray]:
    """The isotonic fit of ``grade >= step`` on ``x``, as the ends of its blocks.

    Each range of ``x`` is pooled by itself and the blocks of all ranges are pooled again, which gives
    the blocks of the whole; only blocks come to the driver.
    """

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[float]] = []
        for b in batches:
            cols = [np.asarray(c, float) for c in zip(*held)] or [np.zeros(0)] * 4
            new = [b.column(i).to_numpy().astype(float) for i in range(3)]
            held = pooled(np.append(cols[0], new[0]), np.append(cols[2], new[1]), np.append(cols[3], new[2]), np.append(cols[1], new[0]))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], pa.float64()) for i in range(4)], names=["x", "last", "total", "weight"])

    rows = fit.groupBy(F.col(x).alias("x")).agg(F.count_if(F.col("grade") >= step).alias("total"), F.count("*").alias("weight"))
    got = rows.repartitionByRange("x").sortWithinPartitions("x").mapInArrow(pool, "x double, last double, total double, weight double").toArrow().sort_by("x")
    blocks = pooled(*[got.column(c).to_numpy() for c in ("x", "total", "weight", "last")])
    ends = [(x, b[2] / b[3]) for b in blocks for x in sorted({b[0], b[1]})]
    return np.array([e[0] for e in ends]), np.array([e[1] for e in ends])


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, grades) of all labelled documents."""
    grade = F.when(F.lower("reading_level") == LEVELS[0], 0).when(F.lower("reading_level") == LEVELS[1], 1).when(F.lower("reading_level") == LEVELS[2], 2)
    rated = labels.select("doc_id", "rater", grade.alias("g")).where("g is not null and doc_id is not null").distinct().groupBy("doc_id").agg(F.sort_array(F.collect_list("g")).alias("grades"))
    rated = cut(rated)
    return docs.select("doc_id", "text").join(F.broadcast(rated) if rated.count() <= BROADCAST else rated, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("grades").alias("grades"))


def summaries(tables: np.ndarray, cutter: Ngrams, texts: list[str | None], grades: list[list[int]] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(texts with a token, median of each step's differences, quantiles of sentence surprisal) of a batch.

    The quantiles (10 %, 50 %, 90 %) are of the surprisal under the level that a sentence fits best.
    With ``grades``, each text is scored without what it gave to the models itself.
    """
    times = None if grades is None else np.array([[gs.count(g) for g in range(len(LEVELS))] for gs in grades], np.float32).reshape(-1, len(LEVELS))
    docs, per = [], []
    for which, part in sliced(texts):
        t = cutter(part)
        if len(t.starts):
            of = np.array(which)[t.doc]
            docs.append(of)
            per.append(sentences(tables, t, None if times is None else _own(t, np.repeat(of, t.lengths), times, cutter.buckets)))
    if not docs:
        return np.zeros(0, np.int64), np.zeros((0, len(LEVELS) - 1)), np.zeros((0, 3))
    of, s = np.concatenate(docs), np.concatenate(per)
    kept, of = np.unique(of, return_inverse=True)
    d, best = steps(s), s.min(axis=1)
    return kept, np.stack([quantile_by(of, d[:, k], 0.5, len(kept)) for k in range(d.shape[1])], axis=1), np.stack([quantile_by(of, best, q, len(kept)) for q in (0.1, 0.5, 0.9)], axis=1)


class Model:
    """The count tables of the levels and the monotone maps of the steps between them."""

    def __init__(self, docs: DataFrame, labels: DataFrame) -> None:
        spark = docs.sparkSession
        rows = cut(labelled(docs, labels).where(F.col("text").rlike(r"[\p{L}\p{N}]")).select("text", "grades").repartition(max(8, spark.sparkContext.defaultParallelism)))
        tokens = (rows.agg(F.sum(F.length("text") * F.size("grades"))).first()[0] or 0) // 5
        self.buckets = buckets = min(MAX_BUCKETS, max(MIN_BUCKETS, 1 << int(tokens // 4).bit_length()))
        counted = rows.mapInArrow(_count(buckets), "grade int, bucket int, n long").groupBy("grade", "bucket").agg(F.least(F.sum("n"), F.lit(2**31 - 1)).cast("int").alias("n"))
        # At most levels x tables x MAX_BUCKETS numbers.
        got = counted.toArrow()
        flat = np.zeros((_TABLES * buckets, len(LEVELS)), dtype=np.int32)
        flat[got.column("bucket").to_numpy(), got.column("grade").to_numpy()] = got.column("n").to_numpy()
        self.shared = shared = spark.sparkContext.broadcast(flat.reshape(_TABLES, buckets, len(LEVELS)))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cutter = Ngrams(buckets)
            for b in batches:
                grades = b.column(1).to_pylist()
                kept, med, _ = summaries(shared.value, cutter, b.column(0).to_pylist(), grades)
                rated = [(*m, g) for i, m in zip(kept, med.tolist()) for g in grades[i]]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rated], pa.float64()), pa.array([r[1] for r in rated], pa.float64()), pa.array([r[2] for r in rated], pa.int32())], names=["s1", "s2", "grade"])

        fit = cut(rows.mapInArrow(score, "s1 double, s2 double, grade int"))
        some = fit.limit(1).count() > 0
        self.maps = [steps_fit(fit, f"s{k}", k) for k in range(1, len(LEVELS))] if some else []

    def scored(self, docs: DataFrame) -> DataFrame:
        """doc_id, grade, reading_level and the 10 %, 50 % and 90 % quantiles of sentence surprisal.

        One row for each row of ``docs`` with a letter or digit in its text; other rows are left out.
        Without any label there is no model and the result is empty.
        """
        shared, maps, buckets = self.shared, self.maps, self.buckets
        quantiles = ("p10", "p50", "p90")
        schema = f"doc_id {dict(docs.dtypes)['doc_id']}, grade double, reading_level string, {', '.join(f'surprisal_{q} double' for q in quantiles)}"

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cutter = Ngrams(buckets)
            for b in batches:
                kept, med, q = summaries(shared.value, cutter, b.column(1).to_pylist() if maps else [])
                g = sum((np.interp(med[:, k], *m) for k, m in enumerate(maps)), np.zeros(len(kept)))
                level = pa.array(np.array(LEVELS)[np.clip(np.floor(g + 0.5), 0, len(LEVELS) - 1).astype(int)].tolist(), pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(kept)), pa.array(g), level, *[pa.array(q[:, i].astype(float)) for i in range(3)]], names=["doc_id", "grade", "reading_level", *[f"surprisal_{x}" for x in quantiles]])

        return docs.select("doc_id", "text").mapInArrow(score, schema)
