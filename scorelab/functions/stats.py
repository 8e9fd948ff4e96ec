"""Closed-form statistics as Column expressions (pass@k, Student-t p-value)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Nodes and weights of the quadrature of the t-distribution's tail, for every n.
_NODES = [(float(x + 1) / 2, float(w) / 2) for x, w in zip(*np.polynomial.legendre.leggauss(64))]
_SHIFT = 32


def pass_at_k_expr(n: Column, c: Column, k: Column) -> Column:
    """Unbiased pass@k for one task: 1 - C(n-c, k) / C(n, k) = 1 - prod_{i=0..k-1} (n-c-i) / (n-i).

    k factors, whatever n and c are; n - c < k -> 1.
    """
    n_d, c_d = n.cast("double"), c.cast("double")
    prod = F.aggregate(
        F.sequence(F.lit(0).cast("bigint"), F.greatest(k.cast("bigint") - 1, F.lit(0))),
        F.lit(1.0),
        lambda a, i: a * (n_d - c_d - i) / (n_d - i),
    )
    return F.when((n - c) < k, F.lit(1.0)).otherwise(F.lit(1.0) - prod)


def _gamma_ratio(a: Column) -> Column:
    """Gamma(a + 1/2) / Gamma(a): the recurrence raises a by a fixed number, then its asymptotic series."""
    x = a + F.lit(float(_SHIFT))
    series = F.lit(1.0)
    # Coefficients of the expansion of the ratio over sqrt(x) in 1/x.
    for power, num, den in [(1, -1, 8), (2, 1, 128), (3, 5, 1024), (4, -21, 32768), (5, -399, 262144), (6, 869, 4194304)]:
        series = series + F.lit(num / den) / F.pow(x, F.lit(float(power)))
    lowered = F.aggregate(F.sequence(F.lit(0), F.lit(_SHIFT - 1)), F.lit(1.0), lambda acc, i: acc * (a + i) / (a + i + F.lit(0.5)))
    return F.sqrt(x) * series * lowered


def t_test_pvalue(rho: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation with n pairs: the chance of |r| >= |rho| under independence.

    p = 2 / B(1/2, v/2) * integral of cos^(v-1) from asin|rho| to pi/2, v = n - 2. The
    integral is taken over the range in which the integrand falls by 45 powers of e, with
    64 Gauss nodes for every n, relative to its value at the lower end; so tails down to
    the smallest doubles keep their digits and the cost does not depend on n.
    |rho| = 1 -> 0; n <= 2 or rho NULL -> NULL.
    """
    r = F.least(F.abs(rho.cast("double")), F.lit(1.0))
    v = (n - F.lit(2)).cast("double")
    m = v - F.lit(1.0)
    below = F.nullif(F.lit(1.0) - r * r, F.lit(0.0))
    tan = r / F.sqrt(below)
    reach = F.lit(90.0) / F.nullif(m, F.lit(0.0))
    width = F.least(F.acos(r), F.coalesce(reach / (tan + F.sqrt(tan * tan + reach)), F.lit(math.pi)))

    def term(st, node):
        d = st["width"] * node["x"]
        s = F.sin(d / F.lit(2.0))
        return F.exp(st["m"] * F.log1p(F.greatest(F.lit(-2.0) * s * s - st["tan"] * F.sin(d), F.lit(-1.0)))) * node["w"]

    nodes = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(w).alias("w")) for x, w in _NODES])
    bound = F.struct(width.alias("width"), tan.alias("tan"), m.alias("m"))
    integral = F.element_at(F.transform(F.array(bound), lambda st: st["width"] * F.aggregate(
        nodes, F.lit(0.0), lambda acc, node: acc + term(st, node))), 1)
    p = (F.lit(2.0 / math.sqrt(math.pi)) * _gamma_ratio(v / F.lit(2.0))
         * F.exp(m / F.lit(2.0) * F.log1p(-r * r)) * integral)
    return (
        F.when(rho.isNull() | F.isnan(rho.cast("double")) | (n <= F.lit(2)), F.lit(None).cast("double"))
        .when(r >= F.lit(1.0), F.lit(0.0))
        .otherwise(F.least(p, F.lit(1.0)))
    )
