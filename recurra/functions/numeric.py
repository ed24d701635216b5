"""Scalar column expressions shared by the operators."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def r6(col, digits: int = 6) -> Column:
    """Round for reporting; adding zero turns -0.0 into 0.0."""
    col = F.col(col) if isinstance(col, str) else col
    return F.round(col.cast("double"), digits) + F.lit(0.0)


def safe_div(num, den, default=None) -> Column:
    """num/den, or ``default`` where the denominator is zero."""
    out = F.when(den != 0, num / den)
    return out if default is None else out.otherwise(F.lit(default))


def entropy_term(p, base: str = "2") -> Column:
    """-p*log(p), zero where p is zero."""
    log = F.log(p) if base == "e" else F.log2(p)
    return F.when(p > 0, -p * log).otherwise(F.lit(0.0))


def half_open_bin(value, low, high, bins: int) -> Column:
    """Equal-width bin index with the last bin closed; everything in bin 0 when low == high."""
    raw = F.floor((value - low) / (high - low) * F.lit(float(bins)))
    return F.when(high > low, F.least(raw, F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")


def lerp(low, high, weight) -> Column:
    return low + (high - low) * weight


def digamma(n) -> Column:
    """psi(n) for positive counts: shift by ten, then the asymptotic series."""
    x = n.cast("double")
    shift = sum((F.lit(1.0) / (x + k) for k in range(1, 10)), F.lit(1.0) / x)
    z = x + 10
    tail = F.lit(1 / 12) / (z * z) - F.lit(1 / 120) / F.pow(z, 4) + F.lit(1 / 252) / F.pow(z, 6)
    return F.log(z) - F.lit(0.5) / z - tail - shift


def _beta_fraction(a, b, x, steps: int = 300):
    """Continued fraction of the incomplete beta function (modified Lentz), vectorised."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    out = d.copy()
    for m in range(1, steps + 1):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for coef in (even, odd):
            d = 1.0 + coef * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + coef / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            out = out * d * c
    return out


@F.pandas_udf(T.DoubleType())
def f_survival(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    """Upper tail of the F distribution; NULL for an undefined statistic."""
    f, d1, d2 = (s.to_numpy(dtype="float64") for s in (f, d1, d2))
    with np.errstate(all="ignore"):
        x = d2 / (d2 + d1 * f)
        a, b = d2 / 2.0, d1 / 2.0
        swap = x >= (a + 1) / (a + b + 2)
        p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
        lgamma = np.vectorize(math.lgamma, otypes=[float])
        usable = np.isfinite(f) & (d2 > 0) & (d1 > 0)
        p, q, z = np.where(usable, p, 1.0), np.where(usable, q, 1.0), np.where(usable, z, 0.5)
        front = np.exp(lgamma(p + q) - lgamma(p) - lgamma(q) + p * np.log(z) + q * np.log1p(-z))
        value = front * _beta_fraction(p, q, z) / p
        value = np.where(z <= 0, 0.0, value)
        value = np.where(swap, 1 - value, value)
        value = np.where(np.isposinf(f), 0.0, value)
    return pd.Series(np.where(usable | np.isposinf(f), value, np.nan)).replace({np.nan: None}).astype("float64")
