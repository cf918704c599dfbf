"""Gamma-family functions, as numpy functions and as Column expressions of equal accuracy.

Spark has no lgamma or digamma. Both forms shift the argument up by eight and use the
asymptotic series there; for x > 0 they agree with exact values to about 1e-12.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SHIFT = 8
LOG_2PI = math.log(2 * math.pi)
#: Coefficients of the asymptotic series (Bernoulli numbers over their factors).
LGAMMA_SERIES = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)
DIGAMMA_SERIES = (1 / 12, -1 / 120, 1 / 252, -1 / 240, 1 / 132)
TRIGAMMA_SERIES = (1 / 6, -1 / 30, 1 / 42, -1 / 30, 5 / 66)


def gammaln(x):
    x = np.asarray(x, dtype=float)
    y = x + SHIFT
    down = sum(np.log(x + i) for i in range(SHIFT))
    tail = sum(c / y ** (2 * i + 1) for i, c in enumerate(LGAMMA_SERIES))
    return (y - 0.5) * np.log(y) - y + 0.5 * LOG_2PI + tail - down


def digamma(x):
    x = np.asarray(x, dtype=float)
    y = x + SHIFT
    down = sum(1 / (x + i) for i in range(SHIFT))
    return np.log(y) - 0.5 / y - sum(c / y ** (2 * i + 2) for i, c in enumerate(DIGAMMA_SERIES)) - down


def trigamma(x):
    x = np.asarray(x, dtype=float)
    y = x + SHIFT
    down = sum(1 / (x + i) ** 2 for i in range(SHIFT))
    return 1 / y + 0.5 / y**2 + sum(c / y ** (2 * i + 3) for i, c in enumerate(TRIGAMMA_SERIES)) + down


def multigammaln(x, d: int):
    """Log of the d-dimensional gamma function."""
    x = np.asarray(x, dtype=float)
    return d * (d - 1) / 4 * math.log(math.pi) + sum(gammaln(x - j / 2) for j in range(d))


def lgamma_col(x: Column) -> Column:
    """Column twin of ``gammaln`` for x > 0; null and NaN pass through."""
    x = x.cast("double")
    y = x + F.lit(float(SHIFT))
    product = x
    for i in range(1, SHIFT):
        product = product * (x + F.lit(float(i)))
    tail = F.lit(0.0)
    for i, c in enumerate(LGAMMA_SERIES):
        tail = tail + F.lit(c) / F.pow(y, F.lit(float(2 * i + 1)))
    return (y - 0.5) * F.ln(y) - y + F.lit(0.5 * LOG_2PI) + tail - F.ln(product)


def digamma_col(x: Column) -> Column:
    """Column twin of ``digamma`` for x > 0."""
    x = x.cast("double")
    y = x + F.lit(float(SHIFT))
    out = F.ln(y) - F.lit(0.5) / y
    for i, c in enumerate(DIGAMMA_SERIES):
        out = out - F.lit(c) / F.pow(y, F.lit(float(2 * i + 2)))
    for i in range(SHIFT):
        out = out - F.lit(1.0) / (x + F.lit(float(i)))
    return out


def digamma_sql(x: str) -> str:
    """The same series as SQL text, for engines without digamma."""
    y = f"(({x}) + {float(SHIFT)})"
    series = " ".join(f"- ({c!r}) / power({y}, {2 * i + 2})" for i, c in enumerate(DIGAMMA_SERIES))
    down = " ".join(f"- 1.0 / (({x}) + {float(i)})" for i in range(SHIFT))
    return f"(ln({y}) - 0.5 / {y} {series} {down})"
