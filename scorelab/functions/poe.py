"""Product-of-experts scoring."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scorelab.functions.scale import _col, _number


def poe_quality(*experts, zero_policy: str = "drop") -> Column:
    """Geometric mean of the experts.

    zero_policy="drop" (default): NULL and NaN count as 0, experts <= 0 are left out and
    the root is 1/n over the experts kept; none kept -> 0.
    zero_policy="zero": NULL and negative count as 0, so any such expert makes the
    product 0 (root over all experts).

    The expert list is known when the plan is built, so the product and the count
    are unrolled into plain arithmetic (whole-stage codegen, no arrays). Skipped
    experts multiply by exactly 1.0, so the result equals a left-to-right fold over
    the kept experts.
    """
    xs = [F.coalesce(_number(e), F.lit(0.0)) for e in experts]
    if zero_policy == "drop":
        kept = [F.when(x > F.lit(0.0), x).otherwise(F.lit(1.0)) for x in xs]
        flags = [F.when(x > F.lit(0.0), F.lit(1)).otherwise(F.lit(0)) for x in xs]
    elif zero_policy == "zero":
        kept = [F.greatest(x, F.lit(0.0)) for x in xs]
        flags = [F.lit(1) for _ in xs]
    else:
        raise ValueError(f"unknown zero_policy {zero_policy!r}")
    prod = F.lit(1.0)
    for k in kept:
        prod = prod * k
    n = F.lit(0)
    for f in flags:
        n = n + f
    root = F.pow(prod, F.lit(1.0) / F.nullif(n, F.lit(0)).cast("double"))
    return F.coalesce(root, F.lit(0.0))


def weighted_poe(experts, weights, zero_policy: str = "drop") -> Column:
    """(prod x_i^w_i)^(1/sum w_i) over the kept experts; weights default to 1."""
    xs = [F.coalesce(_number(e), F.lit(0.0)) for e in experts]
    ws = [F.lit(float(w)) if not isinstance(w, Column) else w.cast("double") for w in weights]
    if zero_policy not in ("drop", "zero"):
        raise ValueError(f"unknown zero_policy {zero_policy!r}")
    prod, wsum = F.lit(1.0), F.lit(0.0)
    for x, w in zip(xs, ws):
        if zero_policy == "drop":
            keep = x > F.lit(0.0)
            prod = prod * F.when(keep, F.pow(x, w)).otherwise(F.lit(1.0))
            wsum = wsum + F.when(keep, w).otherwise(F.lit(0.0))
        else:
            prod = prod * F.pow(F.greatest(x, F.lit(0.0)), w)
            wsum = wsum + w
    return F.coalesce(F.pow(prod, F.lit(1.0) / F.nullif(wsum, F.lit(0.0))), F.lit(0.0))


def overall_score(passed_gate, *experts, zero_policy: str = "drop") -> Column:
    """Gate x quality: a failed sample scores 0."""
    return _col(passed_gate) * poe_quality(*experts, zero_policy=zero_policy)
