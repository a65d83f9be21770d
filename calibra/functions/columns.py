"""Column expressions shared by all operators.

Everything here is a built-in Spark expression (no Python UDF), so it stays
inside whole-stage codegen.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_32 = 4294967296.0


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def missing(c: str | Column) -> Column:
    """NULL or NaN: the reference treats NaN as its only null."""
    c = col_(c)
    return c.isNull() | F.isnan(c)


def u01(salt: str, key: str | Column) -> Column:
    """Deterministic uniform [0,1) from ``md5(salt || ':' || key)``.

    First 8 hex digits as an unsigned integer / 2^32.  The same value is
    reproducible in any SQL engine that has md5, so routing and splits are
    sticky across runs, partitionings and engines.
    """
    s = F.concat(F.lit(f"{salt}:"), col_(key).cast("string"))
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("double") / F.lit(TWO_POW_32)


def safe_div(num: Column, den: Column, default: float | None = 0.0) -> Column:
    """``num/den`` with ``default`` when the denominator is 0 (sklearn zero_division)."""
    q = F.try_divide(num.cast("double"), den.cast("double"))
    return q if default is None else F.coalesce(q, F.lit(float(default)))


# Abramowitz & Stegun 7.1.26 coefficients for erf(x), x >= 0.
ERF_P = 0.3275911
ERF_A1 = 0.254829592
ERF_A2 = -0.284496736
ERF_A3 = 1.421413741
ERF_A4 = -1.453152027
ERF_A5 = 1.061405429


def erfc_pos(x: Column) -> Column:
    """erfc(x) for x >= 0 (max abs error 1.5e-7)."""
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * x)
    poly = t * (F.lit(ERF_A1) + t * (F.lit(ERF_A2) + t * (F.lit(ERF_A3) + t * (F.lit(ERF_A4) + t * F.lit(ERF_A5)))))
    return poly * F.exp(-(x * x))


def erfc_pos_float(x: float) -> float:
    """The same approximation on one Python float (driver-side state updates)."""
    t = 1.0 / (1.0 + ERF_P * x)
    poly = t * (ERF_A1 + t * (ERF_A2 + t * (ERF_A3 + t * (ERF_A4 + t * ERF_A5))))
    return poly * math.exp(-(x * x))


def norm_two_sided_p(z: Column) -> Column:
    """2 * (1 - Phi(|z|)) = erfc(|z| / sqrt 2)."""
    return erfc_pos(F.abs(z) / F.lit(math.sqrt(2.0)))


def chi2_1_sf(stat: Column) -> Column:
    """Upper tail of chi-square with one degree of freedom = erfc(sqrt(s/2))."""
    return erfc_pos(F.sqrt(stat / F.lit(2.0)))


def kolmogorov_sf(lam: Column) -> Column:
    """P(K > lam) for the Kolmogorov distribution (asymptotic KS p-value).

    Large lam: 2 * sum_{k=1..100} (-1)^(k-1) exp(-2 k^2 lam^2).
    Small lam (< 1): 1 - sqrt(2 pi)/lam * sum_{k=1..8} exp(-(2k-1)^2 pi^2 / (8 lam^2)),
    where the alternating series converges too slowly.
    """
    alt = F.lit(2.0) * F.aggregate(
        F.sequence(F.lit(1), F.lit(100)), F.lit(0.0),
        lambda acc, k: acc + F.pow(F.lit(-1.0), k - 1) * F.exp(F.lit(-2.0) * k * k * lam * lam))
    small = F.lit(1.0) - F.lit(math.sqrt(2.0 * math.pi)) / lam * F.aggregate(
        F.sequence(F.lit(1), F.lit(8)), F.lit(0.0),
        lambda acc, k: acc + F.exp(-((F.lit(2) * k - 1) * (F.lit(2) * k - 1)) * F.lit(math.pi * math.pi)
                                   / (F.lit(8.0) * lam * lam)))
    p = F.when(lam <= 0, F.lit(1.0)).when(lam < 1.0, small).otherwise(alt)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))


def r6(c: Column) -> Column:
    """Round a float result to 6 decimals (stable comparison across engines)."""
    return F.round(c.cast("double"), 6)
