"""Special functions as Column expressions (Spark SQL has no lgamma)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Lanczos approximation, g = 7, nine coefficients.
LANCZOS_G = 7.0
LANCZOS_COEF = (
    0.99999999999980993,
    676.5203681218851,
    -1259.1392167224028,
    771.32342877765313,
    -176.61502916214059,
    12.507343278686905,
    -0.13857109526572012,
    9.9843695780195716e-6,
    1.5056327351493116e-7,
)
HALF_LOG_2PI = 0.5 * math.log(2.0 * math.pi)


def _lanczos(z: Column) -> Column:
    zm = z - F.lit(1.0)
    series = F.lit(LANCZOS_COEF[0])
    for i, c in enumerate(LANCZOS_COEF[1:], start=1):
        series = series + F.lit(c) / (zm + F.lit(float(i)))
    t = zm + F.lit(LANCZOS_G + 0.5)
    return F.lit(HALF_LOG_2PI) + (zm + F.lit(0.5)) * F.log(t) - t + F.log(series)


def lgamma(z: Column) -> Column:
    """log Gamma(z) for z > 0."""
    return F.when(z < F.lit(0.5), _lanczos(z + F.lit(1.0)) - F.log(z)).otherwise(_lanczos(z))


# Terms of the series of the digamma function for large arguments, with
# even powers below them, and how far smaller arguments are shifted to use it.
DIGAMMA_SERIES = (1 / 12, -1 / 120, 1 / 252, -1 / 240)
DIGAMMA_SHIFT = 6


def digamma(z: Column) -> Column:
    """Derivative of log Gamma(z) for z > 0."""
    t = z + F.lit(float(DIGAMMA_SHIFT))
    square = F.lit(1.0) / (t * t)
    series = F.lit(0.0)
    for c in reversed(DIGAMMA_SERIES):
        series = (series + F.lit(c)) * square
    shift = F.lit(0.0)
    for k in range(DIGAMMA_SHIFT):
        shift = shift + F.lit(1.0) / (z + F.lit(float(k)))
    return F.log(t) - F.lit(0.5) / t - series - shift


def softplus(z: Column) -> Column:
    """log(1 + exp(z)), stable for large |z|."""
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))


def log_sum_exp2(a: Column, b: Column) -> Column:
    m = F.greatest(a, b)
    return m + F.log(F.exp(a - m) + F.exp(b - m))


#: Nodes of the integral, how many spreads or decay lengths it reaches to the side, and
#: the reach from which on the rest is a plain power.
BETA_NODES, BETA_WIDTHS, BETA_DECAY, BETA_REACH = 64, 8.0, 40.0, 12.0


def _log_beta_tail(a: Column, b: Column, v: Column) -> Column:
    """log of the integral of exp(a log t + b log(1 - t)), t = 1 / (1 + exp(-u)), over u up
    to ``v``, for v at or below the integrand's peak.

    The integrand is log-concave in u, so a fixed number of Gauss-Legendre nodes on
    the reach where it matters does for all a and b; left of a long reach it is
    exp(a u) up to a small first-order term."""
    slope = a * F.exp(-softplus(v)) - b * F.exp(-softplus(-v))  # of the log integrand at v; further left it is steeper
    reach = F.least(F.lit(BETA_REACH), F.lit(BETA_DECAY) / a + F.lit(BETA_WIDTHS) * F.sqrt((a + b) / (a * b)),
                    F.when(slope > 0, F.lit(BETA_DECAY) / slope))
    x, w = np.polynomial.legendre.leggauss(BETA_NODES)
    nodes = F.expr("array(" + ", ".join(f"named_struct('x', {float(p)!r}D, 'w', {float(q)!r}D)" for p, q in zip(x, w)) + ")")

    def height(u: Column) -> Column:
        return -a * softplus(-u) - b * softplus(u)
    top = height(v)
    inside = F.aggregate(nodes, F.lit(0.0), lambda found, n: found + n["w"] * F.exp(height(v + reach * (n["x"] - 1) / 2) - top))
    left = v - reach
    t = F.exp(-softplus(-left))
    rest = F.when(reach >= F.lit(BETA_REACH), F.exp(-a * softplus(-left) - top) / a * (F.lit(1.0) - (b - 1) * t * a / (a + 1))).otherwise(0.0)
    return top + F.log(inside * reach / 2 + rest)


def beta_below(a: Column, b: Column, v: Column) -> Column:
    """The regularised incomplete beta function I_x(a, b) at x = 1 / (1 + exp(-v)).

    Integrated from the side on which the peak doesn't lie; cost and accuracy
    don't depend on the size of a and b."""
    whole = lgamma(a) + lgamma(b) - lgamma(a + b)
    share = F.exp(F.when(v <= F.log(a) - F.log(b), _log_beta_tail(a, b, v)).otherwise(_log_beta_tail(b, a, -v)) - whole)
    share = F.least(share, F.lit(1.0))
    return F.when(v <= F.log(a) - F.log(b), share).otherwise(F.lit(1.0) - share)
