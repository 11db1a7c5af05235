"""Conditional and binary logit models of votes.

A choice set is one row with its features, counts and a key. Every pass over the sets yields the
likelihood, gradient and Hessian of many problems at once (folds, penalties, replicates), each a
weighting of the sets; the solver takes Newton or proximal Newton steps on the driver, where all
matrices are as large as the number of features. No set is ever collected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.functions.keys import hash_rank
from palaver.functions.mathx import chi2_sf, normal_sf
from palaver.operators.bootstrap import POISSON
from palaver.session import cut


def choice_sets(ballot: DataFrame, keys: list[str], alternative: str, count: str, features: list[str], group: str | None = None) -> DataFrame:
    """One row for each key with a vote: ``key``, ``group``, ``h`` (a hash), ``x``, ``n``, ``alts``.

    A set is one key's alternatives (a ballot) for one voter (``group``). Sets without any count are
    left out; null features are 0. ``h`` is of the key alone, so all groups have the same folds.
    The sets are spread over all cores, as passes over them take long however few bytes they are.
    """
    voter = F.coalesce(F.col(group).cast("string"), F.lit("")) if group else F.lit("")
    key = F.concat_ws(" | ", *[F.col(k).cast("string") for k in keys])
    rows = F.array_sort(F.collect_list(F.struct(F.col(alternative).cast("string").alias("a"), F.coalesce(F.col(count), F.lit(0)).cast("double").alias("n"), F.array(*[F.coalesce(F.col(f), F.lit(0)).cast("double") for f in features]).alias("x"))))
    conf = ballot.sparkSession.conf.get("spark.sql.shuffle.partitions")
    spread = ballot.withColumns({"__key": key, "__voter": voter}).repartition(max(int(conf), ballot.sparkSession.sparkContext.defaultParallelism), "__key", "__voter")
    g = spread.groupBy(F.col("__key").alias("key"), F.col("__voter").alias("group")).agg(rows.alias("r"))
    g = g.select("key", "group", hash_rank(F.col("key")).alias("h"), F.flatten(F.col("r.x")).alias("x"), F.col("r.n").alias("n"), F.col("r.a").alias("alts"))
    return g.where(F.aggregate("n", F.lit(0.0), lambda a, b: a + b) > 0)


def sets_by_key(alternatives: DataFrame, votes: DataFrame, key: str, alternative: str, count: str, features: list[str], group: str, fixed: dict[str, list[float]] = {}) -> DataFrame:
    """As :func:`choice_sets`, where all voters (``group``) of a key have the same alternatives.

    ``votes`` has one row for each key, voter and alternative. ``fixed`` are further alternatives of
    every key, with their features. Both sides are gathered by key before they meet, so no
    alternative's row is repeated for each voter.
    """
    session = votes.sparkSession
    parts = max(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism)
    one = lambda a, x: F.struct(a.cast("string").alias("a"), F.array(*x).alias("x"))
    more = [one(F.lit(a), [F.lit(float(v)) for v in x]) for a, x in fixed.items()]
    rows = F.collect_list(one(F.col(alternative), [F.coalesce(F.col(f), F.lit(0)).cast("double") for f in features]))
    a = alternatives.repartition(parts, key).groupBy(key).agg(rows.alias("r")).select(key, F.array_sort(F.concat("r", F.array(*more)) if more else F.col("r")).alias("r"))
    voter = F.coalesce(F.col(group).cast("string"), F.lit(""))
    v = votes.select(key, voter.alias("group"), F.struct(F.col(alternative).cast("string").alias("a"), F.coalesce(F.col(count), F.lit(0)).cast("double").alias("n")).alias("v"))
    v = v.repartition(parts, key).groupBy(key, "group").agg(F.map_from_entries(F.collect_list("v")).alias("v"))
    n = F.transform("r.a", lambda x: F.coalesce(F.try_element_at("v", x), F.lit(0.0)))
    g = v.join(a, key).select(F.col(key).cast("string").alias("key"), "group", F.flatten("r.x").alias("x"), n.alias("n"), F.col("r.a").alias("alts"))
    return g.select("key", "group", hash_rank(F.col("key")).alias("h"), "x", "n", "alts").where(F.aggregate("n", F.lit(0.0), lambda a, b: a + b) > 0)


def with_features(sets: DataFrame, features: list[str], kept: list[str]) -> DataFrame:
    """The sets with some of their features."""
    at = [features.index(f) for f in kept]
    return sets.withColumn("x", F.flatten(F.transform(F.sequence(F.lit(0), F.size("n") - 1), lambda i: F.array(*[F.get("x", i * len(features) + a) for a in at]))))


def _blocks(b: pa.RecordBatch, k: int, cells: int = 1) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(group, places in the batch, hashes, features, counts) of sets that have one group and one number of alternatives.

    Places of :func:`packed` sets are those in their row.
    Features are sets x alternatives x ``k``. A block has as many sets as make some 200,000 numbers for
    each alternative in ``cells`` columns, so its arrays stay in the processor's cache.
    """
    if not b.num_rows:
        return
    if "j" in b.schema.names:
        for group, j, *parts in zip(*[b.column(c).to_pylist() for c in ("group", "j")], *[_buffers(b.column(c)) for c in ("h", "x", "n")]):
            h, x, c = np.frombuffer(parts[0], np.int64), np.frombuffer(parts[1]).reshape(-1, j, k), np.frombuffer(parts[2]).reshape(-1, j)
            most = max(1, 200_000 // (j * cells))
            for i in range(0, len(h), most):
                yield group, np.arange(i, min(i + most, len(h))), h[i : i + most], x[i : i + most], c[i : i + most]
        return
    of = b.column("group").dictionary_encode()
    code, names, h = of.indices.to_numpy(), of.dictionary.to_pylist(), b.column("h").to_numpy()
    x, c = b.column("x").flatten().to_numpy().reshape(-1, k), b.column("n").flatten().to_numpy()
    size = pc.list_value_length(b.column("n")).to_numpy()
    begin = np.cumsum(size) - size
    order = np.lexsort((size, code))
    edge = np.flatnonzero(np.diff(code[order]) | np.diff(size[order])) + 1
    for at in np.split(order, edge):
        j = int(size[at[0]])
        most = max(1, 200_000 // (j * cells))
        for i in range(0, len(at), most):
            part = at[i : i + most]
            rows = begin[part][:, None] + np.arange(j)
            yield names[code[part[0]]], part, h[part], x[rows], c[rows]


def _buffers(column: pa.Array) -> Iterator[pa.Buffer]:
    return (v.as_buffer() for v in column)


def packed(sets: DataFrame, k: int) -> DataFrame:
    """The sets of one group and one number of alternatives as arrays, many to a row, for passes without keys.

    A pass over them decodes no rows and sorts nothing. There are a few partitions for each core,
    so a pass over little is no pass over many tasks.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(g, x.shape[1], h.tobytes(), x.tobytes(), c.tobytes()) for g, _, h, x, c in _blocks(b, k)]
            kinds = (pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["group", "j", "h", "x", "n"])

    few = max(12, 2 * sets.sparkSession.sparkContext.defaultParallelism)
    return sets.select("h", "group", "x", "n").coalesce(few).mapInArrow(scan, "group string, j int, h binary, x binary, n binary")


def _rows(sets: DataFrame, scan: Callable, schema: str) -> pa.Table:
    """The rows of a pass over the sets, which all tasks make at once.

    A task yields a row or one for each group; as many tasks as cores, but 48 at least, bound what comes back.
    """
    most = max(48, sets.sparkSession.sparkContext.defaultParallelism)
    return sets.select("h", "group", "x", "n", *[c for c in sets.columns if c == "j"]).coalesce(most).mapInArrow(scan, schema).toArrow()


def _added(sets: DataFrame, scan: Callable) -> np.ndarray | None:
    """The sum of the vectors that the tasks yield as bytes, None without a task."""
    rows = _rows(sets, scan, "v binary").column("v")
    return sum((np.frombuffer(v.as_buffer()) for v in rows), 0.0) if len(rows) else None


def moments_by(sets: DataFrame, k: int) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """:func:`moments` of each group."""
    found = {g: _spread(v, k) for g, v in _moment_sums(sets, k).items()}
    return {g: v[0] for g, v in found.items()}, {g: v[1] for g, v in found.items()}


def moments(sets: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation (1 if 0) of each feature over all alternatives."""
    return _spread(sum(_moment_sums(sets, k).values(), np.zeros(1 + 2 * k)), k)


def _moment_sums(sets: DataFrame, k: int) -> dict[str, np.ndarray]:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for g, _, _, x, _ in _blocks(b, k):
                total[g] = total.get(g, 0) + np.concatenate([[x.shape[0] * x.shape[1]], x.sum((0, 1)), (x * x).sum((0, 1))])
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], names=["group", "v"])

    out: dict[str, np.ndarray] = {}
    for g, v in zip(*[c.to_pylist() for c in _rows(sets, scan, "group string, v array<double>").columns]):
        out[g] = out.get(g, 0) + np.array(v)
    return out


def _spread(r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    m = max(r[0], 1.0)
    mean = r[1 : k + 1] / m
    sd = np.sqrt(np.maximum(r[k + 1 :] / m - mean**2, 0))
    return mean, np.where(sd < 1e-12, 1.0, sd)


def _uniform(h: np.ndarray, seed: int | np.ndarray) -> np.ndarray:
    """A hash of ``h`` and the seed (an integer or an array of uint64) in [0, 1)."""
    shift = seed * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019) if isinstance(seed, np.ndarray) else np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
    z = h.astype(np.uint64) + shift
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / float(1 << 53)


@dataclass(frozen=True)
class Problem:
    """A weighting of choice sets and a penalty: sets of ``group`` (all if None), with fold == / != ``fold`` of ``seed``, and of these the same with the inner folds."""

    l2: float = 0.0
    l1: float = 0.0
    seed: int = 0
    folds: int = 0
    fold: int = -1
    inside: bool = False
    half: bool = False
    group: str | None = None
    inner: int = 0
    inner_fold: int = -1
    inner_inside: bool = False

    def weights(self, h: np.ndarray, group: np.ndarray) -> np.ndarray:
        on = np.ones(len(h), dtype=bool) if self.group is None else group == self.group
        if self.half:
            on = on & (_uniform(h, self.seed) < 0.5)
        if self.folds:
            at = np.floor(_uniform(h, self.seed) * self.folds).astype(int)
            on = on & ((at == self.fold) == self.inside)
        if self.inner:
            at = np.floor(_uniform(h, self.seed + 1000) * self.inner).astype(int)
            on = on & ((at == self.inner_fold) == self.inner_inside)
        return on.astype(float)

    @property
    def share(self) -> float:
        """The expected share of the group's sets that have a weight."""
        part = lambda n, inside: 1.0 if not n else 1 / n if inside else 1 - 1 / n
        return (0.5 if self.half else 1.0) * part(self.folds, self.inside) * part(self.inner, self.inner_inside)


#: A half sample of all groups, whatever its seed.
_HALF = Problem(half=True)


class _Weightings:
    """The problems of each group and their distinct weightings of sets."""

    def __init__(self, problems: list[Problem]) -> None:
        self.problems, self.found = problems, {}

    def __call__(self, group: str) -> tuple[np.ndarray, list[Problem], np.ndarray]:
        """(problems of the group, distinct weightings, the one of each problem)"""
        if group not in self.found:
            at = [i for i, q in enumerate(self.problems) if q.group in (None, group)]
            cells: dict[Problem, int] = {}
            of = [cells.setdefault(replace(self.problems[i], l1=0.0, l2=0.0, group=None), len(cells)) for i in at]
            self.found[group] = np.array(at, int), list(cells), np.array(of, int)
        return self.found[group]


def _weights(cells: list[Problem], h: np.ndarray) -> np.ndarray:
    if all(replace(q, seed=0) == _HALF for q in cells):
        return (_uniform(h[None, :], np.array([[q.seed] for q in cells], np.uint64)) < 0.5).astype(float)
    return np.stack([q.weights(h, h) for q in cells])


@dataclass
class Sums:
    """What a pass yields for each problem; without slopes no gradient and Hessian."""

    ll: np.ndarray
    grad: np.ndarray | None
    hess: np.ndarray | None
    n: np.ndarray
    hits: np.ndarray
    null: np.ndarray
    meat: np.ndarray = field(default=None)

    def only(self, i: int) -> Sums:
        """The sums of one problem."""
        return Sums(*[None if v is None else v[[i]] for v in (self.ll, self.grad, self.hess, self.n, self.hits, self.null, self.meat)])


#: Means or deviations of the features: of all sets, or of each group.
Scale = np.ndarray | dict[str, np.ndarray]


def _of(scale: Scale, group: str) -> np.ndarray:
    return scale[group] if isinstance(scale, dict) else scale


def evaluate(sets: DataFrame, k: int, problems: list[Problem], beta: np.ndarray, mean: Scale, sd: Scale, meat: bool = False, slopes: bool = True) -> Sums:
    """Log-likelihood, gradient, Hessian, counts, hits and null log-likelihood of all problems."""
    return _evaluated(sets, k, problems, beta, mean, sd, meat, slopes)[0]


_LEAST = float(np.log(1e-12))


def _evaluated(sets: DataFrame, k: int, problems: list[Problem], beta: np.ndarray, mean: Scale, sd: Scale, meat: bool = False, slopes: bool = True, permute: tuple[int | None, ...] = (None,)) -> list[Sums]:
    """:func:`evaluate` with each of the features ``permute`` permuted within sets, in one pass."""
    p, (up, down) = len(problems), np.triu_indices(k)
    # Columns: log-likelihood, choices, hits, null log-likelihood, gradient, upper half of the Hessian, that of the meat.
    width = 4 + (k + len(up) * (2 if meat else 1) if slopes else 0)

    def shared(X, c, w, b):
        """The columns of each weighting and coefficient vector: sums by set, then over the sets of each weighting."""
        m = c.sum(1)
        v = X @ b.T
        v -= v.max(axis=1, keepdims=True)
        q = np.exp(v)
        s = q.sum(axis=1, keepdims=True)
        q /= s
        ll = np.einsum("sj,sju->su", c, np.maximum(v - np.log(s), _LEAST))
        one = np.ones_like(ll)
        y = [ll, m[:, None] * one, np.take_along_axis(c, v.argmax(axis=1), axis=1), (-m * np.log(c.shape[1]))[:, None] * one]
        y = [a[:, :, None] for a in y]
        if slopes:
            q = q.transpose(0, 2, 1)
            bar = q @ X
            g = np.einsum("sj,sjk->sk", c, X)[:, None, :] - m[:, None, None] * bar
            y += [g, m[:, None, None] * (q @ (X[:, :, up] * X[:, :, down]) - bar[:, :, up] * bar[:, :, down])]
            y += [g[:, :, up] * g[:, :, down]] if meat else []
        y = np.concatenate(y, axis=2)
        return (w @ y.reshape(len(y), -1)).reshape(len(w), len(b), -1)

    def each(X, c, w, b):
        """The columns of problems with a weighting and coefficients of their own, by products of matrices."""
        n, j, _ = X.shape
        out, m, flat = np.zeros((len(b), width)), c.sum(1), X.reshape(n * j, k)
        v = (flat @ b.T).reshape(n, j, -1)
        v -= v.max(axis=1, keepdims=True)
        top = None if slopes else v.argmax(axis=1)
        said = np.einsum("sj,sjp->sp", c, v)
        q = np.exp(v)
        s = q.sum(axis=1)
        if q.min() <= 1e-12 * j:
            ll = np.einsum("sj,sjp->sp", c, np.maximum(v - np.log(s)[:, None, :], _LEAST))
        else:
            ll = said - m[:, None] * np.log(s)
        out[:, 0] = np.einsum("sp,ps->p", ll, w)
        out[:, 1] = w @ m
        out[:, 3] = w @ (-m * np.log(j))
        if not slopes:
            out[:, 2] = np.einsum("sp,ps->p", np.take_along_axis(c, top, axis=1), w)
            return out
        q *= (1 / s)[:, None, :]
        bar = np.ascontiguousarray((X.transpose(0, 2, 1) @ q).transpose(2, 0, 1))
        wm = w * m
        q *= wm.T[:, None, :]
        rows = q.reshape(n * j, -1).T @ np.concatenate([flat, flat[:, up] * flat[:, down]], axis=1)
        out[:, 4 : 4 + k] = w @ np.einsum("sj,sjk->sk", c, X) - rows[:, :k]
        out[:, 4 + k :] = rows[:, k:] - ((bar * wm[:, :, None]).transpose(0, 2, 1) @ bar)[:, up, down]
        return out

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, of, betas = np.zeros((len(permute), p, width)), _Weightings(problems), {}
        for b in batches:
            for group, _, h, X, c in _blocks(b, k, max(1, min(p, 256))):
                on, cells, cell = of(group)
                if not len(on):
                    continue
                if group not in betas:
                    one, at = np.unique(beta[on], axis=0, return_inverse=True)
                    betas[group] = one, at.ravel()
                one, at = betas[group]
                w = _weights(cells, h)
                X = (X - _of(mean, group)) / _of(sd, group)
                for i, f in enumerate(permute):
                    Z = X
                    if f is not None:
                        Z = X.copy()
                        to = np.argsort(_uniform(np.arange(c.shape[1], dtype=np.uint64) + h.astype(np.uint64)[:, None], 11), axis=1)
                        Z[:, :, f] = np.take_along_axis(X[:, :, f], to, axis=1)
                    total[i, on] += shared(Z, c, w, one)[cell, at] if meat or (slopes and 4 * len(one) <= len(on)) else each(Z, c, w[cell], beta[on])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

    total = _added(sets, scan)
    total = np.zeros((len(permute), p, width)) if total is None else total.reshape(len(permute), p, width)

    def full(half: np.ndarray) -> np.ndarray:
        out = np.empty((p, k, k))
        out[:, up, down] = out[:, down, up] = half
        return out

    cut_at = 4 + k + len(up)
    return [Sums(t[:, 0], t[:, 4 : 4 + k] if slopes else None, full(t[:, 4 + k : cut_at]) if slopes else None, t[:, 1], t[:, 2], t[:, 3], full(t[:, cut_at:]) if meat else None) for t in total]


def training_spread(sets: DataFrame, k: int, problems: list[Problem]) -> np.ndarray:
    """The population deviation (1 if 0) of each feature over the alternatives that each problem trains on."""
    p = len(problems)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, of = np.zeros((p, 1 + 2 * k)), _Weightings(problems)
        for b in batches:
            for group, _, h, x, _ in _blocks(b, k):
                on, cells, cell = of(group)
                if len(on):
                    total[on] += (_weights(cells, h) @ np.concatenate([np.full((len(x), 1), float(x.shape[1])), x.sum(1), (x * x).sum(1)], axis=1))[cell]
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

    total = _added(sets, scan)
    total = np.zeros((p, 1 + 2 * k)) if total is None else total.reshape(p, -1)
    m = np.maximum(total[:, :1], 1.0)
    sd = np.sqrt(np.maximum(total[:, k + 1 :] / m - (total[:, 1 : k + 1] / m) ** 2, 0))
    return np.where(sd < 1e-12, 1.0, sd)


def _lasso_steps(b: np.ndarray, g: np.ndarray, h: np.ndarray, l1: np.ndarray, rounds: int = 200) -> np.ndarray:
    """The minimisers of local quadratic models plus l1 penalties, by coordinate descent, a row for each problem."""
    x = b.copy()
    grad = -g + np.einsum("pij,pj->pi", h, x - b)
    for _ in range(rounds):
        worst = 0.0
        for i in range(b.shape[1]):
            d2 = np.maximum(h[:, i, i], 1e-12)
            z = x[:, i] - grad[:, i] / d2
            new = np.where(h[:, i, i] <= 1e-12, x[:, i], np.sign(z) * np.maximum(np.abs(z) - l1[:, i] / d2, 0.0))
            d = new - x[:, i]
            grad += h[:, :, i] * d[:, None]
            x[:, i] = new
            worst = max(worst, float(np.abs(d).max(initial=0.0)))
        if worst < 1e-10:
            break
    return x


def _starts(sets: DataFrame, k: int, problems: list[Problem], mean: Scale, sd: Scale, free: tuple[int, ...]) -> np.ndarray:
    """Where :func:`solve` begins: at zero, or for a penalised problem on part of the sets at the fit of all of them.

    The whole has its penalty raised to be as large beside the likelihood as the part's is.
    """
    whole: dict[Problem, int] = {}
    of = [whole.setdefault(Problem(l2=q.l2 / q.share, l1=q.l1 / q.share, group=q.group), len(whole)) if q.share < 1 and (q.l1 or q.l2) else -1 for q in problems]
    beta = np.zeros((len(problems), k))
    if whole and sum(i >= 0 for i in of) > 2 * len(whole):
        fit, _ = solve(sets, k, list(whole), mean, sd, free)
        for i, at in enumerate(of):
            if at >= 0:
                beta[i] = fit[at]
    return beta


def solve(sets: DataFrame, k: int, problems: list[Problem], mean: Scale, sd: Scale, free: tuple[int, ...] = (), rounds: int = 30, spread: np.ndarray | None = None, start: np.ndarray | None = None) -> tuple[np.ndarray, Sums]:
    """Coefficients of all problems by (proximal) Newton steps with halving; ``free`` ones unpenalised.

    They begin at ``start``, or else where :func:`_starts` says.

    ``spread`` (problems x features) are deviations to standardise by in place of ``sd``, such as
    those of each problem's training sets. Means cancel within a set, and another deviation is the
    same as another weight of the penalty, so the features themselves need not be scaled anew; the
    coefficients stay on the scale of ``sd``. Only problems that are not solved yet are evaluated;
    a step that promises less than a hundred-millionth of the objective is the last one and is taken
    unseen, so the sums (without hits) are those before it.
    """
    p = len(problems)
    ratio = np.ones((p, k)) if spread is None else np.stack([spread[i] / _of(sd, q.group) for i, q in enumerate(problems)])
    ratio[:, list(free)] = 0
    pen, pen1 = ratio * ratio, ratio
    l2, l1 = np.array([q.l2 for q in problems]), np.array([q.l1 for q in problems])

    def objective(ll: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
        return -ll + 0.5 * l2[at] * (pen[at] * b * b).sum(1) + l1[at] * (pen1[at] * np.abs(b)).sum(1)

    beta = _starts(sets, k, problems, mean, sd, free) if start is None else start.copy()
    s = evaluate(sets, k, problems, beta, mean, sd)

    def put(at: np.ndarray, t: Sums, of: np.ndarray) -> None:
        for name in ("ll", "grad", "hess", "n", "hits", "null"):
            getattr(s, name)[at] = getattr(t, name)[of]

    # What the sets of a problem leave open would keep the value of other sets: such a problem begins at zero.
    moved = np.flatnonzero((beta != 0).any(axis=1))
    if len(moved):
        h = s.hess[moved] + np.einsum("pi,ij->pij", l2[moved, None] * pen[moved], np.eye(k))
        d = np.sqrt(np.maximum(np.einsum("pii->pi", h), 1e-300))
        again = moved[np.linalg.eigvalsh(h / d[:, :, None] / d[:, None, :])[:, 0] < 1e-8]
        if len(again):
            beta[again] = 0.0
            put(again, evaluate(sets, k, [problems[i] for i in again], beta[again], mean, sd), np.arange(len(again)))
    left = np.arange(p)
    best = objective(s.ll, beta, left)
    scale = np.ones(p)
    for _ in range(rounds):
        b, lasso = beta[left], np.flatnonzero(l1[left])
        g = s.grad[left] - l2[left, None] * pen[left] * b
        h = s.hess[left] + np.einsum("pi,ij->pij", l2[left, None] * pen[left], np.eye(k))
        # Directions that the sets leave open are not moved along; rounding would be all that moves them.
        step = np.einsum("pij,pj->pi", np.linalg.pinv(h, rcond=1e-12, hermitian=True), g)
        h = h + 1e-9 * np.eye(k)
        step[lasso] = _lasso_steps(b[lasso], g[lasso], h[lasso], l1[left][lasso, None] * pen1[left][lasso]) - b[lasso]
        step = scale[left, None] * np.clip(step, -5, 5)
        gain = (g * step).sum(1) - 0.5 * np.einsum("pi,pij,pj->p", step, h, step) - l1[left] * (pen1[left] * (np.abs(b + step) - np.abs(b))).sum(1)
        done = (gain < 1e-8 * (1 + np.abs(best[left]))) | (np.abs(step).max(axis=1) < 1e-8)
        beta[left[done]] += step[done]
        left, new = left[~done], (b + step)[~done]
        if not len(left):
            break
        t = evaluate(sets, k, [problems[i] for i in left], new, mean, sd)
        now = objective(t.ll, new, left)
        ok = now <= best[left] + 1e-12 * (1 + np.abs(best[left]))
        beta[left[ok]], best[left[ok]] = new[ok], now[ok]
        put(left[ok], t, ok)
        scale[left] = np.where(ok, np.minimum(1.0, scale[left] * 2), scale[left] / 2)
    beta[np.abs(beta) < 1e-7] = 0.0
    return beta, s


def fitted(sets: DataFrame, features: list[str], free: tuple[int, ...] = (), l2: float = 0.0) -> dict:
    """The fit with its covariance clustered by set."""
    k = len(features)
    sets = cut(sets)
    mean, sd = moments(sets, k)
    beta, _ = solve(sets, k, [Problem(l2=l2)], mean, sd, free)
    s = evaluate(sets, k, [Problem()], beta, mean, sd, meat=True)
    inv = np.linalg.pinv(s.hess[0])
    return {"beta": beta[0], "vcov": inv @ s.meat[0] @ inv, "model_vcov": inv, "sums": s, "mean": mean, "sd": sd, "sets": sets, "features": features}


def fitted_by(sets: DataFrame, features: list[str], free: tuple[int, ...] = (), l2: float = 0.0) -> dict[str, dict]:
    """The fit of each group, as from :func:`fitted`, all solved in the same passes."""
    k = len(features)
    sets = cut(sets)
    mean, sd = moments_by(sets, k)
    groups = sorted(mean)
    if not groups:
        return {}
    beta, _ = solve(sets, k, [Problem(l2=l2, group=g) for g in groups], mean, sd, free)
    s = evaluate(sets, k, [Problem(group=g) for g in groups], beta, mean, sd, meat=True)
    out = {}
    for i, g in enumerate(groups):
        inv = np.linalg.pinv(s.hess[i])
        out[g] = {"beta": beta[i], "vcov": inv @ s.meat[i] @ inv, "model_vcov": inv, "sums": s.only(i), "mean": mean[g], "sd": sd[g], "sets": sets.where(F.col("group") == g), "features": features}
    return out


def odds_table(fit: dict) -> list[tuple]:
    """(feature, odds ratio, lower, upper, z, p, Bonferroni p) of each feature."""
    b, se = fit["beta"], np.sqrt(np.maximum(np.diag(fit["vcov"]), 0))
    out = []
    for f, x, e in zip(fit["features"], b, se):
        z = x / e if e > 0 else 0.0
        p = 2 * normal_sf(abs(z))
        out.append((f, float(np.exp(x)), float(np.exp(x - 1.96 * e)), float(np.exp(x + 1.96 * e)), float(z), p, min(1.0, p * len(b))))
    return out


def wald(fit: dict, added: list[str]) -> tuple[float, int, float]:
    """The robust test that the coefficients of ``added`` are jointly zero."""
    at = [fit["features"].index(a) for a in added]
    b, v = fit["beta"][at], fit["vcov"][np.ix_(at, at)]
    w = float(b @ np.linalg.pinv(v) @ b)
    return w, len(at), chi2_sf(w, len(at))


def cross_validated(sets: DataFrame, features: list[str], penalties: list[float], free: tuple[int, ...] = (), folds: int = 5, seeds: tuple[int, ...] = (0, 1, 2), l1: bool = False, ready: bool = False) -> list[tuple]:
    """(group, penalty, mean held-out log-likelihood, its deviation, hit rate, pseudo R squared).

    All groups, folds, seeds and penalties are solved together, so the sets are read once for each step.
    Folds come from a hash of the set's key; features are standardised by the training sets alone.
    ``ready`` sets are read from a checkpoint already.
    """
    k = len(features)
    sets = sets if ready else cut(sets)
    mean, sd = moments_by(sets, k)
    if not mean:
        return []
    cells = [(g, p) for g in sorted(mean) for p in penalties]
    train = [Problem(l2=0 if l1 else p, l1=p if l1 else 0, seed=s, folds=folds, fold=f, group=g) for g, p in cells for s in seeds for f in range(folds)]
    beta, _ = solve(sets, k, train, mean, sd, free, spread=training_spread(sets, k, train))
    held = evaluate(sets, k, [Problem(seed=q.seed, folds=folds, fold=q.fold, inside=True, group=q.group) for q in train], beta, mean, sd, slopes=False)
    out, per = [], len(seeds) * folds
    for i, (g, p) in enumerate(cells):
        at = [j for j in range(i * per, (i + 1) * per) if held.n[j] > 0]
        ll, hit, r2 = held.ll[at] / held.n[at], held.hits[at] / held.n[at], 1 - held.ll[at] / held.null[at]
        out.append((g, float(p), float(ll.mean()), float(ll.std()), float(hit.mean()), float(r2.mean())))
    return out


#: The penalties that inner folds choose from.
PENALTIES = (0.01, 0.1, 1.0, 10.0, 100.0)


def tuned(sets: DataFrame, features: list[str], free: tuple[int, ...] = (), learner: str = "l2", penalties: tuple[float, ...] = PENALTIES, folds: int = 5, inner: int = 3, seeds: tuple[int, ...] = (0, 1, 2), ready: bool = False) -> dict:
    """The fits of each group, seed and fold without that fold's sets, as held-out ``problems`` and ``beta``.

    ``learner`` is clogit (no penalty), l2 or l1. A penalty is the one with the best mean
    log-likelihood over inner folds of the training sets. All are solved together. Features are
    standardised by the sets that a fit trains on. ``ready`` sets are read from a checkpoint already.
    """
    k = len(features)
    sets = sets if ready else cut(sets)
    mean, sd = moments_by(sets, k)
    train = [Problem(seed=s, folds=folds, fold=f, group=g) for g in sorted(mean) for s in seeds for f in range(folds)]
    out = {"sets": sets, "mean": mean, "sd": sd, "features": features, "problems": [], "beta": np.zeros((0, k))}
    if not train:
        return out
    if learner != "clogit":
        tries = [replace(q, **{learner: p}, inner=inner, inner_fold=i) for q in train for p in penalties for i in range(inner)]
        beta, _ = solve(sets, k, tries, mean, sd, free, spread=training_spread(sets, k, tries))
        held = evaluate(sets, k, [replace(q, inner_inside=True) for q in tries], beta, mean, sd, slopes=False)
        ll = np.where(held.n > 0, held.ll / np.maximum(held.n, 1), np.nan).reshape(len(train), len(penalties), inner)
        n = (~np.isnan(ll)).sum(2)
        score = np.where(n > 0, np.nansum(ll, 2) / np.maximum(n, 1), -np.inf)
        train = [replace(q, **{learner: penalties[int(np.argmax(v))]}) for q, v in zip(train, score)]
    beta, _ = solve(sets, k, train, mean, sd, free, spread=training_spread(sets, k, train))
    return out | {"problems": [replace(q, inside=True) for q in train], "beta": beta}


def held_out(fit: dict) -> Sums:
    """The sums of each held-out problem of :func:`tuned`."""
    return permuted(fit, (None,))[0]


def permuted(fit: dict, features: tuple[int | None, ...]) -> list[Sums]:
    """:func:`held_out` with each of some features (None: none) permuted within sets, in one pass."""
    return _evaluated(fit["sets"], len(fit["features"]), fit["problems"], fit["beta"], fit["mean"], fit["sd"], slopes=False, permute=features)


def tuned_metrics(fit: dict) -> list[tuple]:
    """(group, mean held-out log-likelihood, its deviation, hit rate, its deviation, pseudo R squared) over folds and seeds of :func:`tuned`."""
    if not fit["problems"]:
        return []
    s, out = held_out(fit), []
    for g in sorted(fit["mean"]):
        at = [j for j, q in enumerate(fit["problems"]) if q.group == g and s.n[j] > 0]
        ll, hit, r2 = s.ll[at] / s.n[at], s.hits[at] / s.n[at], 1 - s.ll[at] / s.null[at]
        out.append((g, float(ll.mean()), float(ll.std()), float(hit.mean()), float(hit.std()), float(r2.mean())))
    return out


def held_out_scores(fit: dict) -> DataFrame:
    """group, key and mean held-out log-likelihood for each choice of every set, averaged over seeds."""
    k, problems, beta, mean, sd = len(fit["features"]), fit["problems"], fit["beta"], fit["mean"], fit["sd"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _Weightings(problems)
        for b in batches:
            out = np.zeros(b.num_rows)
            for g, at, h, X, c in _blocks(b, k, len(problems)):
                on, cells, cell = of(g)
                w = _weights(cells, h)[cell]
                v = ((X - mean[g]) / sd[g]) @ beta[on].T
                v -= v.max(axis=1, keepdims=True)
                v -= np.log(np.exp(v).sum(axis=1, keepdims=True))
                ll = np.einsum("sj,sjp->ps", c, np.maximum(v, _LEAST)) / c.sum(1)
                out[at] = (ll * w).sum(0) / w.sum(0)
            yield pa.RecordBatch.from_arrays([b.column("group"), b.column("key"), pa.array(out)], names=["group", "key", "ll"])

    if not problems:
        return fit["sets"].select("group", "key", F.lit(0.0).alias("ll"))
    return fit["sets"].select("group", "key", "h", "x", "n").mapInArrow(scan, "group string, key string, ll double")


def score_bootstrap(scores: DataFrame, pairs: list[tuple[str, str]], reps: int) -> DataFrame:
    """Mean of the second less the first score of each pair by group, with its 95 % interval over resampled keys.

    A replicate gives each key a Poisson(1) weight from a hash of both, the same in all groups and pairs, so
    comparisons are over common replicates. The weights of a batch are one matrix; what comes
    back of a task is a row for each group and replicate.
    """
    m = len(pairs)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            of = b.column("group").dictionary_encode()
            code, h = of.indices.to_numpy(), b.column("h").to_numpy()
            v = np.stack([np.ones(b.num_rows), *[b.column(y).to_numpy() - b.column(x).to_numpy() for x, y in pairs]], axis=1)
            for c, g in enumerate(of.dictionary.to_pylist()):
                t = total.setdefault(g, np.zeros((reps + 1, m + 1)))
                mine = np.flatnonzero(code == c)
                t[0] += v[mine].sum(0)
                for i in range(0, len(mine), 256):
                    part = mine[i : i + 256]
                    u = _uniform(h[part][None, :], np.arange(reps, dtype=np.uint64)[:, None])
                    w = np.zeros(u.shape)
                    for bound in POISSON:
                        w += u >= bound
                    t[1:] += w @ v[part]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([t.tobytes() for t in total.values()], pa.binary())], names=["group", "v"])

    rows = scores.select("group", F.xxhash64("key").alias("h"), *sorted({x for p in pairs for x in p})).coalesce(max(48, scores.sparkSession.sparkContext.defaultParallelism)).mapInArrow(scan, "group string, v binary").toArrow()
    total: dict[str, np.ndarray] = {}
    for g, v in zip(*[c.to_pylist() for c in rows.columns]):
        total[g] = total.get(g, 0) + np.frombuffer(v).reshape(reps + 1, m + 1)
    out = []
    for g, t in sorted(total.items()):
        drawn = t[1:][t[1:, 0] > 0]
        for i, (x, y) in enumerate(pairs, 1):
            lo, hi = np.percentile(drawn[:, i] / drawn[:, 0], [2.5, 97.5]).tolist() if len(drawn) >= 0.5 * reps else (None, None)
            out.append((g, f"{y} - {x}", float(t[0, i] / t[0, 0]), int(t[0, 0]), len(drawn), lo, hi))
    return scores.sparkSession.createDataFrame(out, "model_name string, comparison string, difference double, n long, n_draws long, lo double, hi double")


def stability(sets: DataFrame, features: list[str], target: int, free: tuple[int, ...] = (), samples: int = 50, tries: int = 12) -> list[tuple]:
    """(group, feature, how often a lasso on half of the sets keeps it, lambda).

    A group's penalty keeps about ``target`` features on all of its sets, bisected on a log scale;
    then all half samples of all groups are solved together at that penalty. Fits begin between those
    of the penalties next to theirs, half samples at the fit of all sets at twice the penalty.
    """
    k = len(features)
    sets = cut(packed(sets, k))
    mean, sd = moments_by(sets, k)
    if not mean:
        return []
    ends = {g: (1e-4, 1e4) for g in sorted(mean)}
    known: dict[str, dict[float, np.ndarray]] = {g: {} for g in ends}

    def near(grid: list[tuple[str, float]]) -> np.ndarray:
        """Coefficients between those of the next penalties that are solved, on a log scale; at zero without any."""
        out = np.zeros((len(grid), k))
        for i, (g, x) in enumerate(grid):
            at = sorted(known[g])
            for f in range(k if at else 0):
                out[i, f] = np.interp(np.log(x), np.log(at), [known[g][y][f] for y in at])
        return out

    def fit(grid: list[tuple[str, float]]) -> np.ndarray:
        beta, _ = solve(sets, k, [Problem(l1=x, group=g) for g, x in grid], mean, sd, free, start=near(grid))
        for (g, x), b in zip(grid, beta):
            known[g][x] = b
        return beta

    for _ in range(tries):
        grid = [(g, float(x)) for g, (lo, hi) in ends.items() for x in np.exp(np.linspace(np.log(lo), np.log(hi), 6))[1:-1]]
        beta = fit(grid)
        kept = [(b != 0).sum() - sum(b[i] != 0 for i in free) for b in beta]
        for g, (lo, hi) in ends.items():
            over = [x for (q, x), n in zip(grid, kept) if q == g and n > target]
            under = [x for (q, x), n in zip(grid, kept) if q == g and n <= target]
            ends[g] = (max(over) if over else lo), (min(under) if under else hi)
        if all(hi / lo < 1.05 for lo, hi in ends.values()):
            break
    lam = {g: float(np.sqrt(lo * hi)) for g, (lo, hi) in ends.items()}
    whole = fit([(g, 2 * v) for g, v in lam.items()])
    beta, _ = solve(sets, k, [Problem(l1=v, seed=100 + i, half=True, group=g) for g, v in lam.items() for i in range(samples)], mean, sd, free, start=np.repeat(whole, samples, axis=0))
    return [(g, f, float((beta[j * samples : (j + 1) * samples, i] != 0).mean()), lam[g]) for j, g in enumerate(lam) for i, f in enumerate(features)]


def permutation_importance(fit: dict) -> list[tuple]:
    """(group, feature, loss of held-out mean log-likelihood when it is permuted within sets, share of folds with a loss).

    ``fit`` is from :func:`tuned`; losses are means over folds and seeds.
    """
    if not fit["problems"]:
        return []
    (base, *sums), out = permuted(fit, (None, *range(len(fit["features"])))), []
    for f, s in zip(fit["features"], sums):
        for g in sorted(fit["mean"]):
            at = [j for j, q in enumerate(fit["problems"]) if q.group == g and base.n[j] > 0]
            loss = (base.ll[at] - s.ll[at]) / base.n[at]
            out.append((g, f, float(loss.mean()), float((loss > 0).mean())))
    return out


def iia(full: dict, restricted: dict) -> tuple[float, int, float | None, str]:
    """Hausman and McFadden's test that dropping an alternative leaves coefficients alone."""
    shared = [f for f in full["features"] if f in restricted["features"]]
    a, b = [full["features"].index(f) for f in shared], [restricted["features"].index(f) for f in shared]
    # Each fit standardises by its own data: compare on the raw scale.
    raw = lambda x, at: x["beta"][at] / x["sd"][at]
    cov = lambda x, at: x["model_vcov"][np.ix_(at, at)] / np.outer(x["sd"][at], x["sd"][at])
    d = raw(restricted, b) - raw(full, a)
    stat = float(d @ np.linalg.pinv(cov(restricted, b) - cov(full, a)) @ d)
    if stat <= 0:
        return stat, len(shared), None, "inconclusive"
    p = chi2_sf(stat, len(shared))
    return stat, len(shared), p, "rejected" if p < 0.05 else "no evidence against"


def binary_logit(rows: DataFrame, features: list[str], label: str, c: float = 1.0, positive_weight: float = 1.0):
    """A ridge logit by MLlib with regParam 1 / (C sum of weights), unstandardised."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    x = VectorAssembler(inputCols=features, outputCol="x", handleInvalid="error").transform(rows.fillna(0, features).withColumn("w", F.when(F.col(label) == 1, positive_weight).otherwise(1.0)))
    total = x.agg(F.sum("w")).first()[0] or 1.0
    return LogisticRegression(featuresCol="x", labelCol=label, weightCol="w", regParam=1.0 / (c * total), standardization=False, maxIter=50).fit(x), x


def grid_search(train: DataFrame, valid: DataFrame, features: list[str], label: str, cs: list[float], weights: list[float]) -> list[tuple]:
    """(C, weight, threshold, F1, AUC) of every setting, best by (F1, AUC) first."""
    from pyspark.ml.functions import vector_to_array

    from palaver.operators.stats import auc, best_threshold

    out = []
    for c in cs:
        for w in weights:
            model, _ = binary_logit(train, features, label, c, w)
            x = binary_logit_input(valid, features)
            p = cut(model.transform(x).select(F.col(label).cast("int").alias(label), vector_to_array("probability")[1].alias("p")))
            t, a = best_threshold(p, label, "p").first(), auc(p, label, "p").first()
            out.append((float(c), float(w), float(t["threshold"]), float(t["f1"]), None if a["auc"] is None else float(a["auc"])))
    return sorted(out, key=lambda r: (-r[3], -(r[4] or 0), r[0], r[1]))


def binary_logit_input(rows: DataFrame, features: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=features, outputCol="x", handleInvalid="error").transform(rows.fillna(0, features))


def boosted_ranker(rows: DataFrame, features: list[str], label: str, weight: str, trees: int = 20):
    """A pointwise gradient-boosted ranker, scored on hit rate only."""
    from pyspark.ml.classification import GBTClassifier

    x = binary_logit_input(rows, features)
    return GBTClassifier(featuresCol="x", labelCol=label, weightCol=weight, maxIter=trees, maxDepth=2, seed=0).fit(x), x
