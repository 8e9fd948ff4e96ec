"""Metric scaling to [0, 1] and other row-local column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scorelab.schemas import LABELS, LOC_REF, MAX_CC, MAX_EXEC_TIME, MAX_LINT_SCORE


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` (Column -> Column).

    Each use of a higher-order-function expression gets fresh lambda variables, so
    Catalyst cannot share repeated copies of it; binding through a one-element
    ``transform`` computes it once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def nan_to_null(c) -> Column:
    """NaN -> NULL (Spark's avg/max/comparisons treat NaN as a value), as a double.

    ``nanvl`` holds its argument once; ``nullif`` and ``when`` would hold it twice, which doubles
    an expression with each layer of it."""
    return F.nanvl(_col(c).cast("double"), F.lit(None).cast("double"))


def _number(c) -> Column:
    """As double, NaN as NULL: a missing measurement either way."""
    return nan_to_null(_col(c).cast("double"))


def scale_cc(value, max_cc: float = MAX_CC) -> Column:
    """Cyclomatic complexity -> 1 - min(v/max, 1); NULL stays NULL (least() would skip it)."""
    v = _number(value)
    return F.when(v.isNull(), F.lit(None).cast("double")).otherwise(
        F.lit(1.0) - F.least(v / F.lit(float(max_cc)), F.lit(1.0))
    )


def scale_lint(value, max_score: float = MAX_LINT_SCORE) -> Column:
    """Lint score 0..10 -> min(v/max, 1); no lower clamp; NULL stays NULL."""
    v = _number(value)
    return F.when(v.isNull(), F.lit(None).cast("double")).otherwise(
        F.least(v / F.lit(float(max_score)), F.lit(1.0))
    )


def scale_efficiency(seconds, max_time: float = MAX_EXEC_TIME) -> Column:
    """Mean run time -> 1 - min(t/max, 1); NULL stays NULL."""
    return scale_cc(seconds, max_time)


def scale_loc(loc, ref: float = LOC_REF) -> Column:
    """Logical lines -> max(0, 1 - min(loc/ref, 1))."""
    v = _number(loc)
    return F.when(v.isNotNull(), F.greatest(F.lit(0.0), F.lit(1.0) - F.least(v / F.lit(float(ref)), F.lit(1.0))))


def gate(passed) -> Column:
    """Functional-correctness gate: passed as 0/1 double, missing -> 0."""
    return F.coalesce(_col(passed).cast("double"), F.lit(0.0))


#: What counts as a number in text: no type suffixes ('1d', '2f'), which a cast would take.
NUMBER = r"^[ \t\r\n]*[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:inf(?:inity)?))[ \t\r\n]*$"


def coerce_numeric(s) -> Column:
    """Text -> double, unparsable -> NULL, NaN -> NULL (ANSI-safe)."""
    c = _col(s).cast("string")
    return F.when(F.regexp_like(c, F.lit(NUMBER)), nan_to_null(c.try_cast("double")))


# Grade bands (lower bound inclusive) and their names.
GRADE_BANDS = [(0.90, "excellent"), (0.75, "good"), (0.60, "regular"), (0.40, "poor")]
GRADE_FLOOR = "critical"


def grade_band(score) -> Column:
    s = _number(score)
    expr = None
    for lower, name in GRADE_BANDS:
        expr = F.when(s >= F.lit(lower), F.lit(name)) if expr is None else expr.when(s >= F.lit(lower), F.lit(name))
    return expr.when(s.isNotNull(), F.lit(GRADE_FLOOR))


def title_case(s) -> Column:
    """Python ``str.title``: a cased letter is upper-cased after an uncased char, else lower-cased."""
    chars = F.split(_col(s), "")

    def cased(c):
        return F.upper(c) != F.lower(c)

    out = F.transform(
        chars,
        lambda c, i: F.when(
            (i > 0) & cased(F.element_at(chars, i)), F.lower(c)
        ).otherwise(F.upper(c)),
    )
    return F.array_join(out, "")


def display_label(name, mapping: dict | None = None) -> Column:
    """Mapped display name, else ``_`` -> space and title case."""
    mapping = LABELS if mapping is None else mapping
    n = _col(name)
    lookup = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]) if mapping else None
    fallback = title_case(F.replace(n, F.lit("_"), F.lit(" ")))
    return F.coalesce(F.element_at(lookup, n), fallback) if lookup is not None else fallback


def safe_name(name) -> Column:
    """Model name -> file-safe name: ``/`` and ``:`` become ``_``."""
    return F.translate(_col(name), "/:", "__")


def delta_sign(delta) -> Column:
    d = _col(delta)
    return F.when(d > 0, F.lit("positive")).otherwise(F.lit("negative"))
