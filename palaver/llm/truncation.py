"""Texts that stop before their content does.

Each value gets a *sign* from its ending: whether its JSON is closed, whether a cut mark follows,
whether its last words end a text elsewhere. Per group (source or model) one model with a hidden
state, cut or whole, is fitted by expectation-maximization: a log-normal length distribution by
maximum likelihood in which cut values are right-censored, the rate of every sign among cut and
among whole values, and the prior of a cut. Lengths at which cut values pile up are candidate
limits; there the prior is the censoring posterior, one less the share of the values at that length
that the fitted distribution lets end there by itself; elsewhere it is the group's base rate of cuts
in transfer, and at the token cap the rate of cuts among values at their cap. Prior odds and the
rates of the sign make each value's posterior.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.operators.runs import sorted_groups
from palaver.session import cut

# Marks that stand for missing text at an end.
_CUT_MARK = r"(?:…|\.\.\.|�+|\\u?[0-9a-fA-F]{0,3}|(?i:[\[(<{]\s*(?:truncated|more|cut|continued|cont\.|snip|\.\.\.)\s*[\])>}]))\s*$"
_STOP = r"[.!?。؟][\"'”’»)\]*_`\s]*$"
BINS = 4096

# The signs of an ending by kind of text, with the log of how much likelier each is
# taken to be for a cut than for a whole text before a group's own values are seen.
SIGNS = (
    ("closed", "json", -9.0),    # every brace, bracket and quote is closed
    ("open", "json", 9.0),
    ("hollow", "prose", -9.0),   # a wrapper or placeholder without content
    ("echo", "prose", -9.0),     # ends as another whole text does (a question that is repeated)
    ("marked", "prose", 7.0),    # a mark for missing text
    ("stop", "prose", -5.0),     # a final stop
    ("torn_word", "prose", 6.0), # the last word occurs nowhere else
    ("torn", "prose", 5.0),      # a known word that nowhere else follows its well-known words
    ("new", "prose", 2.0),       # words that are too rare to tell
    ("never", "prose", 4.5),     # the last three words end at most 2 % of their uses
    ("seldom", "prose", 2.0),    # … at most 20 %
    ("even", "prose", 0.5),      # … at most 50 %
    ("often", "prose", -0.7),    # … at most 80 %
    ("usual", "prose", -6.0),    # … more: what lacks is the stop alone
)
_AT = {name: i for i, (name, _, _) in enumerate(SIGNS)}
_ANCHOR = np.array([a for _, _, a in SIGNS])
_KIND = np.array([k == "json" for _, k, _ in SIGNS])
#: How far a group's own rates move the log ratios above: 0 not at all, 1 all the way. A cut that
#: leaves no trace in lengths cannot be told from its sign alone, so the ratios stay anchored.
TRUST = 0.5


def length_bin(n: Column) -> Column:
    """Lengths as they are up to 4,096, above in steps of 1/64 of an octave: a bounded histogram."""
    step = F.floor(F.log2(n / BINS) * 64)
    return F.when(n <= BINS, n).otherwise((BINS * F.pow(F.lit(2.0), step / 64)).cast("long")).cast("long")


def _jsonish(text: Column) -> Column:
    return text.rlike(r'[{\[]\s*(?:"|$|[}\]])') | text.rlike(r'^\s*(?:[^{"\n]*[:>]\s*)?"\w+"\s*:') | text.rlike(r"^\s*(?:```\w*\s*)?[{\[]")


def json_state(text: Column) -> Column:
    """``closed``, ``open``, or null for a text without JSON; a missing first brace counts as there."""
    bare = F.regexp_replace(F.regexp_replace(text, r"\\.", "_"), r'"[^"]*"', "S")
    opens, closes = F.length(F.regexp_replace(bare, r"[^{\[]", "")), F.length(F.regexp_replace(bare, r"[^}\]]", ""))
    headless = text.rlike(r'^\s*(?:[^{"\n]*[:>]\s*)?"\w+"\s*:').cast("int")
    done = ~bare.contains('"') & (closes > 0) & (closes >= opens + headless)
    return F.when(_jsonish(text), F.when(done, "closed").otherwise("open"))


_WORDS = r"[\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*"


def _masked(text: Column) -> Column:
    """Words with capitalised ones masked, for contexts that do not hang on names."""
    return F.regexp_extract_all(F.lower(F.regexp_replace(text, r"(?<![\p{L}\p{N}'’-])\p{Lu}[\p{L}\p{N}]*(?:['’-][\p{L}\p{N}]+)*", "Nnn")), F.lit(_WORDS), F.lit(0))


def _context(words: Column, i: Column) -> Column:
    return F.xxhash64(F.get(words, i - 2), F.get(words, i - 1), F.get(words, i))


def _text(c: str) -> Column:
    return F.regexp_replace(F.col(c), r"<\|[^|<>]{1,20}\|>", "")


def signed(values: DataFrame) -> DataFrame:
    """``values`` (table_name, row_id, grp, text, at_cap, other) with the signs that a text shows by itself.

    One scan that keeps no text. ``sign`` is null where the words of other texts must tell; then
    ``ctx``, ``up`` and ``word`` are hashes of the last three words, the three before the last, and
    the last word. Null, empty and blank texts are left out.
    """
    v = values.where(F.col("text").rlike(r"(?U)[^\s​]")).withColumn("n_chars", F.length("text").cast("long")).withColumn("text", _text("text"))
    text, state = F.col("text"), json_state(F.col("text"))
    letters = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]", "")
    other = letters(F.col("other"))
    echo = (F.length(other) >= 12) & letters(text).endswith(F.substring(other, -12, 12))
    inside = F.trim(F.regexp_replace(F.lower(text), r"```\w*|[^\p{L}\p{N}/]+", " "))
    hollow = inside.isin("", "null", "none", "n/a", "na", "nan", "nil")
    sign = F.when(state == "closed", _AT["closed"]).when(state == "open", _AT["open"]).when(hollow, _AT["hollow"]).when(echo, _AT["echo"]).when(text.rlike(_CUT_MARK), _AT["marked"]).when(text.rlike(_STOP), _AT["stop"])
    v = v.select("table_name", "row_id", F.coalesce("grp", F.lit("")).alias("grp"), "n_chars", F.coalesce("at_cap", F.lit(False)).alias("at_cap"), sign.alias("sign"), "text")
    tok, plain = F.when(F.col("sign").isNull(), _masked(F.col("text"))), F.when(F.col("sign").isNull(), F.regexp_extract_all(F.col("text"), F.lit(_WORDS), F.lit(0)))
    v = v.select("*", tok.alias("tok"), F.element_at(F.when(F.size(plain) > 0, plain), -1).alias("last")).drop("text")
    n = F.size("tok")
    loose = F.col("sign").isNull()
    return v.select("table_name", "row_id", "grp", "n_chars", "at_cap", "sign", F.when(loose, _context(F.col("tok"), n - 1)).alias("ctx"), F.when(loose, _context(F.col("tok"), n - 2)).alias("up"), F.when(loose, F.xxhash64(F.lit("w"), "last")).alias("word"))


def endings(values: DataFrame, most_keys: int = 500_000) -> DataFrame:
    """``values`` (table_name, row_id, grp, text, at_cap, other) with the sign of each ending.

    For prose without a final stop the sign tells at what rate its last three words (names masked)
    end a finished text, counted over all values, and whether its last word occurs elsewhere at all.
    Only the contexts and words that end such a text are counted; they are broadcast if there are no
    more than ``most_keys`` of them, else joined. ``other`` is a text whose end is a whole ending too.
    """
    v = cut(signed(values))
    loose = v.where("sign is null")
    asked = cut(loose.select(F.explode(F.array("ctx", "up", "word")).alias("key")).distinct())
    few = asked.limit(most_keys + 1).count() <= most_keys
    t = _text("text")
    prose = values.where(F.col("text").rlike(r"(?U)[^\s​]") & ~_jsonish(t) & ~t.rlike(_CUT_MARK))
    w = prose.select(t.rlike(_STOP).alias("stop"), _masked(t).alias("tok"), F.regexp_extract_all(t, F.lit(_WORDS), F.lit(0)).alias("plain")).where(F.size("tok") > 0)
    n = F.size("tok")
    keys = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.array(_context(F.col("tok"), i), F.xxhash64(F.lit("w"), F.get(F.col("plain"), i))).alias("keys"), (i == n - 1).alias("last")))
    at = w.select("stop", F.explode(keys).alias("k")).where(~F.col("k.last") | F.col("stop")).select(F.explode("k.keys").alias("key"), F.col("k.last").cast("long").alias("e"))
    seen = cut(at.join(F.broadcast(asked) if few else asked, "key", "left_semi").groupBy("key").agg(F.count("*").alias("n"), F.sum("e").alias("e")))
    hint = F.broadcast if few else (lambda d: d)
    look = lambda k: hint(seen.select(F.col("key").alias(k), F.col("n").alias(f"n_{k}"), F.col("e").alias(f"e_{k}")))
    x = loose.join(look("ctx"), "ctx", "left").join(look("up"), "up", "left").join(look("word"), "word", "left")
    p_end = (F.coalesce("e_ctx", F.lit(0)) + 0.05) / (F.coalesce("n_ctx", F.lit(0)) + 1.0)
    sign = (
        F.when(F.col("n_word").isNull(), _AT["torn_word"]).when(F.col("n_ctx").isNull(), F.when(F.col("n_up") >= 20, _AT["torn"]).otherwise(_AT["new"]))
        .when(p_end <= 0.02, _AT["never"]).when(p_end <= 0.2, _AT["seldom"]).when(p_end <= 0.5, _AT["even"]).when(p_end <= 0.8, _AT["often"]).otherwise(_AT["usual"])
    )
    cols = ["table_name", "row_id", "grp", "n_chars", "at_cap"]
    return v.where("sign is not null").select(*cols, "sign").unionByName(x.select(*cols, sign.alias("sign")))


def _erfc(x: np.ndarray) -> np.ndarray:
    """Complementary error function by Chebyshev fit, relative error below 1.2e-7 everywhere."""
    z = np.abs(x)
    t = 1 / (1 + 0.5 * z)
    poly = np.polyval([0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223], t)
    r = t * np.exp(-z * z + poly)
    return np.where(x >= 0, r, 2 - r)


def fit_censored(lengths: np.ndarray, whole: np.ndarray, cut: np.ndarray, steps: int = 60, start: tuple[float, float] | None = None) -> tuple[float, float]:
    """Log-normal mean and deviation by maximum likelihood (EM), ``cut`` counts being right-censored."""
    y = np.log(np.maximum(lengths, 1.0))
    n = whole + cut
    if n.sum() <= 0:
        return 0.0, 1.0
    mu = float(np.average(y, weights=n))
    sd = max(0.05, float(np.sqrt(np.average((y - mu) ** 2, weights=n))))
    if start:
        mu, sd = start
    for _ in range(steps):
        z = (y - mu) / sd
        surv = np.maximum(0.5 * _erfc(z / math.sqrt(2)), 1e-12)
        hazard = np.where(z > 6, z + 1 / np.maximum(z, 1), np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi) / surv)
        m1 = mu + sd * hazard
        m2 = mu * mu + sd * sd + sd * (y + mu) * hazard
        new = float((whole * y + cut * m1).sum() / n.sum())
        var = float((whole * y * y + cut * m2).sum() / n.sum()) - new * new
        if abs(new - mu) < 1e-9 and abs(var - sd * sd) < 1e-9:
            break
        mu, sd = new, max(0.05, math.sqrt(max(var, 0.0)))
    return mu, sd


def fit_group(x: np.ndarray, width: np.ndarray, capped: np.ndarray, n: np.ndarray, rounds: int = 12) -> dict:
    """The fit of one group's cells: length, bin width, at the token cap, counts by sign (cells x signs).

    Gives ``mu``, ``sigma``, ``base``, ``cap`` (priors), ``limits`` {length: prior} and ``log_lr`` by sign.
    """
    lr = _ANCHOR.copy()
    total, per = n.sum(), n.sum(axis=1)
    base, cap, limits, fit = 0.03, 0.5, {}, None
    exact = width <= 1.0
    for _ in range(rounds):
        prior = np.where(capped, max(base, cap), base)
        for v, p in limits.items():
            prior = np.where(exact & (x == v), np.maximum(prior, p), prior)
        odds = (prior / (1 - prior))[:, None] * np.exp(lr)[None, :]
        r = n * odds / (1 + odds)
        c = r.sum(axis=1)
        fit = fit_censored(x, per - c, c, 60 if fit is None else 15, fit)
        at, where = np.unique(np.where(exact, x, -x), return_inverse=True)
        n_at, c_at = np.bincount(where, weights=per), np.bincount(where, weights=c)
        here = at > 0
        spread = float(np.median(c_at[c_at > 0.5])) if (c_at > 0.5).sum() >= 5 else 1.0
        # Cut values within 25 characters: those at their own lengths and those of coarser bins.
        sums = np.concatenate([[0.0], np.cumsum(c_at[here])])
        lens = at[here]
        near = (sums[np.searchsorted(lens, lens + 25, "right")] - sums[np.searchsorted(lens, lens - 25, "left")] - c_at[here]) / 50
        if (~here).any():
            near += np.interp(lens, -at[~here][::-1], (c_at[~here] / np.maximum(1.0, -at[~here] / 64 * math.log(2)))[::-1], left=0.0, right=0.0)
        pile = (c_at[here] >= 4) & (c_at[here] >= 5 * np.maximum(near, 0.1)) & (c_at[here] >= 2 * spread)
        mu, sd = fit
        density = np.exp(-0.5 * ((np.log(lens) - mu) / sd) ** 2) / (lens * sd * math.sqrt(2 * math.pi))
        limits = {float(v): float(np.clip(1 - total * d / m, 0.01, 0.99)) for v, d, m in zip(lens[pile], density[pile], n_at[here][pile])}
        off = ~capped & ~(exact & np.isin(x, list(limits)))
        base = float(np.clip((c[off].sum() + 0.5) / (per[off].sum() + 1.0), 0.002, 0.5))
        cap = float(np.clip((c[capped].sum() + 0.5) / (per[capped].sum() + 1.0), 0.01, 0.99))
        told, new = [r.sum(axis=0), (n - r).sum(axis=0)], lr.copy()
        for kind in (True, False):
            q = kind == _KIND
            share_cut, share_whole = ((t[q] + 0.5) / (t[q].sum() + 0.5 * q.sum()) for t in told)
            # A sign that is too rare here to have a rate of its own stays at its anchor.
            own = n.sum(axis=0)[q] / (n.sum(axis=0)[q] + 20.0)
            new[q] = _ANCHOR[q] + TRUST * own * (np.log(share_cut / share_whole) - _ANCHOR[q])
        still = np.abs(new - lr).max() < 1e-4
        lr = new
        if still:
            break
    return {"mu": fit[0], "sigma": fit[1], "base": base, "cap": cap, "limits": limits, "log_lr": lr, "n": float(total), "n_cut": float(c.sum()), "at": {v: (float(n_at[here][lens == v][0]), float(c_at[here][lens == v][0])) for v in limits}}


def _fit(key: tuple, rows: list[dict]) -> Iterator[tuple]:
    x = np.array([r["bin"] for r in rows], dtype=float)
    exact = np.array([r["exact"] for r in rows])
    n = np.array([[r[f"n{i}"] for i in range(len(SIGNS))] for r in rows], dtype=float)
    f = fit_group(x, np.where(exact, 1.0, x / 64 * math.log(2)), np.array([r["at_cap"] for r in rows]), n)
    yield (*key, None, f["n"], f["n_cut"], f["mu"], f["sigma"], f["base"], f["cap"], f["log_lr"].tolist())
    for v, p in f["limits"].items():
        yield (*key, int(v), *f["at"][v], f["mu"], f["sigma"], p, None, None)


def fits(ends: DataFrame) -> DataFrame:
    """The fit of each group (``bin`` null) and its limits (``bin`` the length in characters).

    A group is fitted on its histogram: lengths over 4,096 are binned, but for those that carry
    three values or more that look cut, so a limit is found exactly whatever its length.
    """
    seen = ends.groupBy("table_name", "grp", "n_chars", "at_cap").agg(*[F.count_if(F.col("sign") == i).alias(f"n{i}") for i in range(len(SIGNS))])
    at = ends.where((F.col("n_chars") > BINS) & F.col("sign").isin(*[i for i, a in enumerate(_ANCHOR) if a > 0])).groupBy("table_name", "grp", "n_chars").agg(F.count("*").alias("k")).where("k >= 3").select("table_name", "grp", "n_chars", F.lit(True).alias("told"))
    x = seen.join(at, ["table_name", "grp", "n_chars"], "left").withColumn("exact", (F.col("n_chars") <= BINS) | F.coalesce("told", F.lit(False)))
    hist = x.groupBy("table_name", "grp", F.when(F.col("exact"), F.col("n_chars")).otherwise(length_bin(F.col("n_chars"))).alias("bin"), "exact", "at_cap").agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(len(SIGNS))])
    return sorted_groups(hist, ["table_name", "grp"], ["bin"], _fit, "table_name string, grp string, bin long, n double, n_cut double, mu double, sigma double, prior double, cap double, log_lr array<double>")


def posteriors(ends: DataFrame, most_groups: int = 20_000) -> DataFrame:
    """``ends`` with ``log_lr``, ``prior`` and ``posterior``: the chance that the value was cut.

    The fits are broadcast if there are no more than ``most_groups`` rows of them, else joined.
    """
    f = cut(fits(ends))
    hint = F.broadcast if f.limit(most_groups + 1).count() <= most_groups else (lambda d: d)
    base = f.where("bin is null").select("table_name", F.col("grp").alias("g"), F.col("prior").alias("base"), "cap", F.col("log_lr").alias("rates"))
    at = f.where("bin is not null").select("table_name", F.col("grp").alias("g"), F.col("bin").alias("n_chars"), F.col("prior").alias("at_limit"))
    x = ends.withColumn("g", F.col("grp")).join(hint(base), ["table_name", "g"], "left").join(hint(at), ["table_name", "g", "n_chars"], "left")
    prior = F.greatest("base", F.coalesce("at_limit", F.lit(0.0)), F.when(F.col("at_cap"), F.col("cap")).otherwise(0.0))
    x = x.withColumn("prior", prior).withColumn("log_lr", F.get("rates", F.col("sign")))
    odds = F.log(F.col("prior") / (1 - F.col("prior"))) + F.col("log_lr")
    return x.select("table_name", "row_id", "grp", "n_chars", "sign", "log_lr", "prior", "base", (1 / (1 + F.exp(-odds))).alias("posterior"))


def values(*parts: tuple[str, DataFrame, str, str, str, Column | None, Column | None]) -> DataFrame:
    """Values of several tables: (table name, frame, id, group, text, at-cap test, other whole text)."""
    made = [
        df.select(F.lit(name).alias("table_name"), F.col(i).cast("long").alias("row_id"), F.coalesce(F.col(g).cast("string"), F.lit("")).alias("grp"), F.col(t).alias("text"),
                  F.coalesce(cap if cap is not None else F.lit(False), F.lit(False)).alias("at_cap"), (other if other is not None else F.lit(None)).cast("string").alias("other"))
        for name, df, i, g, t, cap, other in parts
    ]
    return reduce(DataFrame.unionByName, made)
