"""Tail probabilities as column expressions: incomplete beta and gamma functions by continued fractions and series.

Everything stays in the row; the number of terms follows the square root of the larger parameter, as convergence does.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lanczos coefficients for g = 7.
_LANCZOS = [0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
            12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7]
_TINY = 1e-300


def log_gamma(z: Column) -> Column:
    """Logarithm of the gamma function for z of 0.5 or more."""
    x = z - 1
    total = F.lit(_LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:], 1):
        total = total + F.lit(c) / (x + i)
    t = x + 7.5
    return F.lit(0.5 * math.log(2 * math.pi)) + (x + 0.5) * F.ln(t) - t + F.ln(total)


def _terms(*sizes: Column) -> Column:
    largest = F.greatest(*sizes) if len(sizes) > 1 else sizes[0]
    return F.sequence(F.lit(1), (F.lit(100) + 6 * F.sqrt(largest)).cast("int"))


def _safe(v: Column) -> Column:
    return F.when(F.abs(v) < _TINY, F.lit(_TINY)).otherwise(v)


def _fraction(terms: Column, c: float, d: Column, step) -> Column:
    """A continued fraction by the modified Lentz rule from the first ``c`` and 1 / ``d``; ``step(k)`` gives the (numerator,
    denominator) pairs of round k."""
    def advance(s: Column, k: Column) -> Column:
        c, d, h = s["c"], s["d"], s["h"]
        for top, bottom in step(k.cast("double")):
            d, c = 1.0 / _safe(bottom + top * d), _safe(bottom + top / c)
            h = h * d * c
        return F.struct(c.alias("c"), d.alias("d"), h.alias("h"))

    first = 1.0 / _safe(d)
    return F.aggregate(terms, F.struct(F.lit(c).alias("c"), first.alias("d"), first.alias("h")), advance, lambda s: s["h"])


def beta_share(x: Column, a: Column, b: Column) -> Column:
    """Regularised incomplete beta function I_x(a, b) for a and b of 0.5 or more."""
    def one(x: Column, a: Column, b: Column) -> Column:
        front = F.exp(a * F.ln(x) + b * F.ln(1 - x) + log_gamma(a + b) - log_gamma(a) - log_gamma(b)) / a

        def step(m: Column) -> list:
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            return [(even, F.lit(1.0)), (odd, F.lit(1.0))]

        return front * _fraction(_terms(a, b), 1.0, 1 - (a + b) * x / (a + 1), step)

    a, b, x = a.cast("double"), b.cast("double"), x.cast("double")
    inner = F.least(F.greatest(x, F.lit(1e-300)), F.lit(1 - 2.0 ** -53))
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(inner < (a + 1) / (a + b + 2), one(inner, a, b)).otherwise(1 - one(1 - inner, b, a))


def gamma_tail(a: Column, x: Column) -> Column:
    """Regularised upper incomplete gamma function Q(a, x) for a of 0.5 or more."""
    a, x = a.cast("double"), x.cast("double")
    at = F.greatest(x, F.lit(1e-300))
    front = F.exp(a * F.ln(at) - at - log_gamma(a))
    added = F.aggregate(_terms(a, at), F.struct((1.0 / a).alias("t"), (1.0 / a).alias("s")), lambda s, k: F.struct(
        (s["t"] * at / (a + k)).alias("t"), (s["s"] + s["t"] * at / (a + k)).alias("s")), lambda s: s["s"])
    far = _fraction(_terms(a, at), 1 / _TINY, at + 1 - a, lambda k: [(-k * (k - a), at + 2 * k + 1 - a)])
    return F.when(x <= 0, 1.0).when(x < a + 1, 1 - front * added).otherwise(front * far)


def binomial_at_least(hits: Column, trials: Column) -> Column:
    """P(X >= hits) for fair trials; 1 for no hits."""
    return F.when(hits <= 0, 1.0).otherwise(beta_share(F.lit(0.5), F.greatest(hits, F.lit(1)), F.greatest(trials - hits + 1, F.lit(1))))


def t_above(t: Column, degrees: Column) -> Column:
    """P(T > t) of Student's distribution."""
    both = beta_share(degrees / (degrees + t * t), degrees / 2, F.lit(0.5))
    return F.when(t >= 0, both / 2).otherwise(1 - both / 2)


def chi_square_above(x: Column, degrees: Column) -> Column:
    return gamma_tail(degrees / 2, x / 2)
