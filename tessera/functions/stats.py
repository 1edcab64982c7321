"""Statistical expressions with no Spark built-in (chi-square tail via erf).

Neither Spark nor most SQL engines ship ``erf``/``erfc``. The chi-square(1)
survival function is ``erfc(sqrt(x / 2))``; here ``erf`` is evaluated with
the everywhere-convergent positive series

    erf(z) = 2/sqrt(pi) * exp(-z^2) * sum_{n>=0} 2^n z^(2n+1) / (1*3*...*(2n+1))

in Horner form with a fixed number of terms, as one Catalyst expression
(no Python at run time). For z > 6 the tail is below 1e-16 and 0 is
returned. The same formula can be emitted as SQL text (``chi2_1_sf_sql``)
so another engine evaluates identical floating-point steps.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ERF_TERMS = 120
Z2_MAX = 36.0  # z = 6
TWO_OVER_SQRT_PI = 2.0 / math.sqrt(math.pi)


def _erf_series_col(z2: Column, z: Column) -> Column:
    acc = F.lit(1.0)
    for k in range(ERF_TERMS, 0, -1):
        acc = F.lit(1.0) + acc * (F.lit(2.0) * z2 / F.lit(float(2 * k + 1)))
    return F.lit(TWO_OVER_SQRT_PI) * F.exp(-z2) * z * acc


def chi2_1_sf(x: Column) -> Column:
    """P(X > x) for X ~ chi-square with 1 degree of freedom."""
    z2 = x / F.lit(2.0)
    z = F.sqrt(z2)
    return (F.when(x.isNull(), F.lit(None).cast("double"))
            .when(z2 > Z2_MAX, F.lit(0.0))
            .when(z2 <= 0, F.lit(1.0))
            .otherwise(F.lit(1.0) - _erf_series_col(z2, z)))


def chi2_1_sf_sql(x: str) -> str:
    """The same computation as SQL text over the expression ``x``."""
    z2 = f"(({x}) / 2.0)"
    acc = "1.0"
    for k in range(ERF_TERMS, 0, -1):
        acc = f"(1.0 + {acc} * (2.0 * {z2} / {float(2 * k + 1)!r}))"
    series = f"({TWO_OVER_SQRT_PI!r} * exp(-{z2}) * sqrt({z2}) * {acc})"
    return (f"(CASE WHEN ({x}) IS NULL THEN NULL WHEN {z2} > {Z2_MAX!r} THEN 0.0 "
            f"WHEN {z2} <= 0 THEN 1.0 ELSE 1.0 - {series} END)")
