"""Tail probabilities for the F and studentized-range distributions.

Used through Arrow-batched pandas UDFs on result tables that have one row per
(model, variable) or per pair of groups, never per input row. numpy only.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _betacf(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = tiny if abs(d) < tiny else d
    d = 1.0 / d
    h = d
    for m in range(1, 1000):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = tiny if abs(d) < tiny else d
        c = 1.0 + aa / c
        c = tiny if abs(c) < tiny else c
        d = 1.0 / d
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = tiny if abs(d) < tiny else d
        c = 1.0 + aa / c
        c = tiny if abs(c) < tiny else c
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < 1e-16:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    lbeta = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    front = math.exp(lbeta + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _betacf(a, b, x) / a
    return 1.0 - front * _betacf(b, a, 1.0 - x) / b


def f_sf(f: float, d1: float, d2: float) -> float:
    """P(F > f) for F(d1, d2)."""
    if f is None or d1 is None or d2 is None or any(map(math.isnan, (f, d1, d2))):
        return float("nan")
    if d1 <= 0 or d2 <= 0:
        return float("nan")
    if f <= 0:
        return 1.0
    return betainc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


# Gauss-Legendre nodes for the double integral of the studentized range.
_GL_X, _GL_W = np.polynomial.legendre.leggauss(200)


def _norm_cdf(z):
    return 0.5 * (1.0 + np.vectorize(math.erf)(z / math.sqrt(2.0)))


def studentized_range_sf(q: float, k: float, df: float) -> float:
    """P(Q > q) for the studentized range with k groups and df degrees of freedom.

    P(Q <= q) = int_0^inf f_S(s) * k * int phi(z) [Phi(z) - Phi(z - q s)]^(k-1) dz ds
    with S = chi_df / sqrt(df); both integrals by Gauss-Legendre quadrature on
    truncated ranges.
    """
    if q is None or any(map(math.isnan, (q, k, df))) or k < 2 or df <= 0:
        return float("nan")
    if q <= 0:
        return 1.0
    # inner: range of k standard normals scaled by s
    z_lo, z_hi = -8.5, 8.5
    z = 0.5 * (z_hi - z_lo) * _GL_X + 0.5 * (z_hi + z_lo)
    wz = 0.5 * (z_hi - z_lo) * _GL_W
    phi = np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)
    cz = _norm_cdf(z)

    def inner(s):
        return k * np.sum(wz * phi * np.clip(cz - _norm_cdf(z - q * s), 0.0, 1.0) ** (k - 1))

    # outer: density of S = sqrt(chi2_df / df)
    sd = 1.0 / math.sqrt(2.0 * df)
    s_lo, s_hi = max(1e-9, 1.0 - 12.0 * sd), 1.0 + 12.0 * sd
    if df < 50:
        s_lo, s_hi = 1e-9, 1.0 + 12.0 * max(sd, 0.15) + (8.0 if df < 10 else 2.0)
    s = 0.5 * (s_hi - s_lo) * _GL_X + 0.5 * (s_hi + s_lo)
    ws = 0.5 * (s_hi - s_lo) * _GL_W
    log_norm = (df / 2.0) * math.log(df / 2.0) - math.lgamma(df / 2.0) + math.log(2.0)
    dens = np.exp(log_norm + (df - 1) * np.log(s) - df * s * s / 2.0)
    cdf = float(np.sum(ws * dens * np.array([inner(si) for si in s])))
    return float(min(1.0, max(0.0, 1.0 - cdf)))


@F.pandas_udf(DoubleType())
def _f_sf_udf(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series([f_sf(*map(lambda v: float("nan") if pd.isna(v) else float(v), t))
                      for t in zip(f, d1, d2)], dtype="float64")


@F.pandas_udf(DoubleType())
def _srange_udf(q: pd.Series, k: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([studentized_range_sf(*map(lambda v: float("nan") if pd.isna(v)
                                                else float(v), t))
                      for t in zip(q, k, df)], dtype="float64")


def f_pvalue(f: Column, d1: Column, d2: Column) -> Column:
    p = _f_sf_udf(f.cast("double"), d1.cast("double"), d2.cast("double"))
    return F.when(f.isNotNull() & ~F.isnan(p), p)


def tukey_pvalue(t: Column, k: Column, df: Column) -> Column:
    q = F.abs(t) * math.sqrt(2.0)
    p = _srange_udf(q.cast("double"), k.cast("double"), df.cast("double"))
    return F.when(t.isNotNull() & ~F.isnan(p), p)
