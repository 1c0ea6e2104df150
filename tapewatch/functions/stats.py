"""Statistical Column functions; all stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def exact_sum(x: Column) -> Column:
    """Aggregate: the exact sum of doubles of at most 1 in size, rounded once, so that it is the same in any order of rows.

    Each is cut into whole numbers of 24 bits, which add up without rounding; bits below 2^-72 are left out.
    """
    total, rest = None, x
    for _ in range(3):
        rest = rest * 2.0**24
        whole = F.floor(rest)
        part = F.sum(whole).cast("decimal(38,0)")
        total, rest = part if total is None else total * F.lit(2**24).cast("decimal(8,0)") + part, rest - whole
    return total.cast("double") / 2.0**72


def exact_mean(x: Column) -> Column:
    """Aggregate: the mean by :func:`exact_sum`."""
    return F.try_divide(exact_sum(x), F.count(x))


def logit(p: Column, low: float = 0.001, high: float = 0.999) -> Column:
    q = clip(p, low, high)
    return F.ln(q / (1 - q))


#: Coefficients of the normal tail's rational approximation (error under 1.5e-7).
TAIL_SCALE = 0.3275911
TAIL_TERMS = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def upper_tail(z: Column) -> Column:
    """P(Z >= z) of a standard normal, for z >= 0."""
    x = z / F.sqrt(F.lit(2.0))
    t = 1 / (1 + TAIL_SCALE * x)
    poly = F.lit(0.0)
    for term in reversed(TAIL_TERMS):
        poly = (poly + term) * t
    return poly * F.exp(-x * x) / 2


def normal_cdf(z: Column) -> Column:
    return F.when(z >= 0, 1 - upper_tail(z)).otherwise(upper_tail(-z))


def binomial_tail(n: Column, k: Column, p: Column) -> Column:
    """P(X >= k) for X ~ Bin(n, p), summed from the exact first term by ratios of neighbours."""
    q = clip(p, 1e-12, 1 - 1e-12)
    odds = F.ln(q) - F.ln(1 - q)
    choose = F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1)).cast("int")), F.lit(0.0), lambda s, j: s + F.ln((n - k + j) / F.greatest(j, F.lit(1))))
    first = choose + k * F.ln(q) + (n - k) * F.ln(1 - q)
    zero = F.struct(first.alias("term"), F.lit(0.0).alias("total"))
    steps = F.sequence(k.cast("int"), F.greatest(n, k).cast("int"))
    summed = F.aggregate(
        steps, zero, lambda s, i: F.struct((s["term"] + F.ln((n - i) / (i + 1.0)) + odds).alias("term"), (s["total"] + F.exp(s["term"])).alias("total"))
    )
    return F.when(k <= 0, F.lit(1.0)).when(k > n, F.lit(0.0)).otherwise(F.least(F.lit(1.0), summed["total"]))


def upper_median(values: Column) -> Column:
    """The element at floor(n/2) of a sorted array."""
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))


def log10_at_least(x: Column, least: float) -> Column:
    return F.log10(F.greatest(x, F.lit(least)))
