"""Mathematics: column expressions and plain numerics that no library here offers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def entropy_term(p: Column) -> Column:
    """``-p ln p``, 0 at 0: summed over a distribution, its entropy in nats."""
    return F.when(p > 0, -p * F.ln(p)).otherwise(0.0)


def hypergeometric_two_or_more(n: Column, k: Column, m: Column) -> Column:
    """P(X >= 2) for m draws without replacement from n items of which k count."""

    def log_choose(a: Column, b: Column) -> Column:
        terms = F.when((b > 0) & (b <= a), F.aggregate(F.sequence(F.lit(1), F.greatest(b, F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + F.ln((a - b + i) / i)))
        return F.when((b < 0) | (b > a), F.lit(None)).when(b == 0, 0.0).otherwise(terms)

    total = log_choose(n, m)
    none, one = F.exp(log_choose(n - k, m) - total), k * F.exp(log_choose(n - k, m - 1) - total)
    return F.greatest(F.lit(0.0), 1 - F.coalesce(none, F.lit(0.0)) - F.coalesce(one, F.lit(0.0)))


def clipped(x: Column, low: float, high: float) -> Column:
    """``x`` within bounds; nulls stay null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def normal_sf(x: float) -> float:
    """P(Z > x) (F63)."""
    return 0.5 * math.erfc(x / math.sqrt(2))


def chi2_sf(x: float, df: int) -> float:
    """P(chi-square > x): the upper regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    a, z = df / 2, x / 2
    scale = math.exp(a * math.log(z) - z - math.lgamma(a))
    if z < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= z / n
            total += term
        return max(0.0, 1 - total * scale)
    b, c = z + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return min(1.0, scale * h)


def binomial_two_sided(k: int, n: int) -> float:
    """The exact two-sided test of k of n at one half."""
    if n == 0:
        return 1.0
    low = min(k, n - k)
    if n <= 1_000:
        return min(1.0, 2 * sum(math.comb(n, i) for i in range(low + 1)) / 2**n)
    # From the largest term down, until what is left adds nothing: some sqrt(n) terms.
    term = total = math.exp(math.lgamma(n + 1) - math.lgamma(low + 1) - math.lgamma(n - low + 1) - n * math.log(2))
    for i in range(low, 0, -1):
        term *= i / (n - i + 1)
        total += term
        if term < 1e-17 * total:
            break
    return min(1.0, 2 * total)


def student_sf(t: float, df: float) -> float:
    """P(T > t) by the incomplete beta function's continued fraction."""
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) if 0 < x < 1 else 0.0

    def fraction(a: float, b: float, x: float) -> float:
        c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
        h = d
        for m in range(1, 1000):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / (1 + num * d or 1e-300)
                c = 1 + num / c or 1e-300
                h *= c * d
            if abs(c * d - 1) < 1e-15:
                break
        return h

    beta = front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b
    return beta / 2 if t >= 0 else 1 - beta / 2
