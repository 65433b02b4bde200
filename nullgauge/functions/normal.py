"""Tails of the normal, Student and skew-normal laws, and the log-gamma function, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Chebyshev coefficients of the complementary error function (relative error under 1.2e-7).
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def normal_sf(z: Column) -> Column:
    """Upper tail of the standard normal distribution."""
    x = F.abs(z) / F.lit(2.0**0.5)
    t = 1 / (1 + x / 2)
    poly = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        poly = c + t * poly
    tail = t * F.exp(-x * x + poly) / 2
    return F.when(z >= 0, tail).otherwise(1 - tail)


def normal_sf_sql(z: str) -> str:
    """The same expression as SQL text."""
    x = f"(abs({z}) / sqrt(2.0))"
    t = f"(1.0 / (1.0 + {x} / 2.0))"
    poly = f"({ERFC[-1]})"
    for c in reversed(ERFC[:-1]):
        poly = f"({c} + {t} * {poly})"
    tail = f"({t} * exp(-{x} * {x} + {poly}) / 2.0)"
    return f"(CASE WHEN {z} >= 0 THEN {tail} ELSE 1.0 - {tail} END)"


def erfc_step(z: Column) -> Column:
    """The variable of the tail's polynomial, for a column of its own where many rows are tried."""
    return 1 / (1 + F.abs(z) / F.lit(8.0**0.5))


def log_normal_cdf(z: Column, step: Column | None = None) -> Column:
    """Logarithm of the lower tail of the standard normal distribution; it doesn't underflow far below zero."""
    t = erfc_step(z) if step is None else step
    poly = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        poly = c + t * poly
    far = F.ln(t / 2) - z * z / 2 + poly
    return F.when(z < 0, far).otherwise(F.ln(1 - F.exp(far)))


def log_normal_cdf_sql(z: str) -> str:
    """The same expression as SQL text."""
    x = f"(abs({z}) / sqrt(2.0))"
    t = f"(1.0 / (1.0 + {x} / 2.0))"
    poly = f"({ERFC[-1]})"
    for c in reversed(ERFC[:-1]):
        poly = f"({c} + {t} * {poly})"
    far = f"(ln({t} / 2.0) - {x} * {x} + {poly})"
    return f"(CASE WHEN {z} < 0 THEN {far} ELSE ln(1.0 - exp({far})) END)"


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function of x > 0: Stirling's series seven places up, error under 1e-12."""
    y = x + 7
    steps = x
    for k in range(1, 7):
        steps = steps * (x + k)
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) + 1 / (1188 * y**9)
    return (y - 0.5) * F.ln(y) - y + F.ln(2 * F.pi()) / 2 + series - F.ln(steps)


def student_sf(t: Column, df: Column, terms: int = 400) -> Column:
    """Upper tail of Student's distribution, df from 0.5 to 400: the incomplete beta function as a series of positive
    terms, from whichever end converges."""
    x = df / (df + t * t)
    near = x <= 0.9
    p, q = F.when(near, df / 2).otherwise(0.5), F.when(near, F.lit(0.5)).otherwise(df / 2)
    y = F.when(near, x).otherwise(t * t / (df + t * t))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def add(state: Column, k: Column) -> Column:
        term = state["term"] * (p + q + k) / (p + 1 + k) * y
        return F.struct(term.alias("term"), (state["total"] + term).alias("total"))

    total = F.aggregate(F.sequence(F.lit(0), F.lit(terms - 1)), start, add, lambda state: state["total"])
    beta = log_gamma(df / 2) + F.lit(math.lgamma(0.5)) - log_gamma(df / 2 + 0.5)
    part = F.exp(df / 2 * F.ln(x) - beta) * F.sqrt(t * t / (df + t * t)) / p * total
    half = F.when(near, part).otherwise(1 - part) / 2
    return F.when(t >= 0, half).otherwise(1 - half)


def skew_normal_sf(z: Column, shape: Column, panels: int = 200) -> Column:
    """Upper tail of the standard skew-normal distribution: exp(-z**2 / (2 cos(phi)**2)) / pi over the angles that the
    shape leaves, by Simpson's rule; the integrand is positive, so small tails keep their digits."""
    low = F.when(z >= 0, -F.atan(shape)).otherwise(F.atan(shape))
    step = (F.pi() / 2 - low) / panels

    def add(total: Column, k: Column) -> Column:
        at = F.greatest(F.pow(F.cos(low + k * step), F.lit(2.0)), F.lit(1e-30))
        weight = F.when((k == 0) | (k == panels), 1.0).when(k % 2 == 1, 4.0).otherwise(2.0)
        return total + weight * F.exp(-z * z / (2 * at))

    area = F.aggregate(F.sequence(F.lit(0), F.lit(panels)), F.lit(0.0), add) * step / (3 * F.pi())
    return F.when(z >= 0, area).otherwise(1 - area)
