"""Reusable ``Column`` expressions behind the operators.

Everything here is a built-in Catalyst expression, so a chain of these collapses into one
``Project`` inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = str | Column

DAYS_PER_YEAR = 365.25


def as_column(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


def in_every(*predicates: Column) -> Column:
    """All predicates hold (AND)."""
    return reduce(and_, predicates)


def threshold_flag(col: ColumnLike, gt) -> Column:
    """1 where the value is strictly above ``gt``, else 0. NULL counts as 0."""
    return F.when(as_column(col) > gt, 1).otherwise(0)


def null_flag(col: ColumnLike) -> Column:
    """1 where the value is missing, else 0."""
    return as_column(col).isNull().cast("int")


def value_flag(col: ColumnLike, value) -> Column:
    """1 where the value equals a magic value, else 0. NULL counts as 0."""
    return F.when(as_column(col) == value, 1).otherwise(0)


def outcome_flag(actual: ColumnLike, promised: ColumnLike) -> Column:
    """1 late, 0 in time, NULL while there is no outcome.

    Compares full timestamps. A NULL promise with a known outcome is 0, as in a CASE whose ELSE
    catches everything that is not late.
    """
    actual, promised = as_column(actual), as_column(promised)
    return F.when(actual > promised, 1).when(actual.isNull(), F.lit(None).cast("int")).otherwise(0)


def day_variance(actual: ColumnLike, promised: ColumnLike) -> Column:
    """Whole calendar days from promise to outcome; the time of day is ignored."""
    return F.datediff(as_column(actual), as_column(promised))


def days_to_years(col: ColumnLike, null_when: Column | None = None, scale: int = 1) -> Column:
    """Years from a signed day offset, rounded. Exact: days / 365.25 is computed in decimal."""
    days = F.abs(as_column(col)).cast("decimal(12,0)")
    years = F.round(days / F.lit(str(DAYS_PER_YEAR)).cast("decimal(5,2)"), scale)
    years = years.cast(f"decimal({4 + scale},{scale})")
    return years if null_when is None else F.when(~F.coalesce(null_when, F.lit(False)), years)


def fitting_cast(col: ColumnLike, to, exact: bool = False) -> Column:
    """A cast that fails on a value the type cannot hold; with ``exact``, also on one that it would change."""
    col = as_column(col)
    cast = col.try_cast(to)
    lost = col.isNotNull() & cast.isNull()
    if exact:
        lost = lost | (cast != col)
    wrong = F.concat(F.lit(f"does not fit {to if isinstance(to, str) else to.simpleString()}: "), col.cast("string"))
    return F.when(lost, F.raise_error(wrong).cast(to)).otherwise(cast)


def guarded_ratio(
    num: ColumnLike,
    den: ColumnLike,
    scale: int | None = 4,
    precision: int = 38,
    null_when: Column | None = None,
) -> Column:
    """Ratio that is NULL for a zero denominator or where ``null_when`` holds, and nowhere else.

    With a ``scale`` the result is rounded half-up to ``decimal(precision, scale)``. The default precision
    holds the quotient of any two amounts; a ratio that does not fit a smaller one fails the job.
    ``scale=None`` keeps the raw quotient.
    """
    ratio = F.try_divide(as_column(num), as_column(den))
    if scale is not None:
        ratio = fitting_cast(F.round(ratio, scale), f"decimal({precision},{scale})")
    return ratio if null_when is None else F.when(~F.coalesce(null_when, F.lit(False)), ratio)


def code_to_label(col: ColumnLike, labels: Mapping, default: str) -> Column:
    """Label for each listed code; every other value, NULL included, gets ``default``."""
    col = as_column(col)
    (code, label), *rest = labels.items()
    out = F.when(col == code, label)
    for code, label in rest:
        out = out.when(col == code, label)
    return out.otherwise(default)


def band(col: ColumnLike, edges: Sequence, labels: Sequence[str]) -> Column:
    """Half-open bands ``[lo, hi)`` from ascending ``edges``.

    ``labels`` has one entry more than ``edges``. The last label is the ELSE branch: it takes
    everything from the last edge up **and NULL**.
    """
    if len(labels) != len(edges) + 1:
        raise ValueError("labels must have exactly one entry more than edges")
    if list(edges) != sorted(edges):
        raise ValueError("edges must ascend")
    col = as_column(col)
    out = F.when(col < edges[0], labels[0])
    for edge, label in zip(edges[1:], labels[1:-1]):
        out = out.when(col < edge, label)
    return out.otherwise(labels[-1])


def band_closed(col: ColumnLike, ranges: Sequence[tuple]) -> Column:
    """Closed ranges ``(lo, hi, label)``; ``None`` leaves an end open. Anything else is NULL."""
    col = as_column(col)

    def inside(lo, hi) -> Column:
        if lo is None and hi is None:
            raise ValueError("a range needs at least one bound")
        if lo is None:
            return col <= hi
        if hi is None:
            return col >= lo
        return col.between(lo, hi)

    (lo, hi, label), *rest = ranges
    out = F.when(inside(lo, hi), label)
    for lo, hi, label in rest:
        out = out.when(inside(lo, hi), label)
    return out


def classify(rules: Sequence[tuple[Column, str]], default: str | None) -> Column:
    """First rule whose predicate holds gives the label; ``default`` otherwise."""
    (predicate, label), *rest = rules
    out = F.when(predicate, label)
    for predicate, label in rest:
        out = out.when(predicate, label)
    return out if default is None else out.otherwise(default)


def percent(part: Column, whole: Column, scale: int | None = 2) -> Column:
    """``100 * part / whole`` as a double, NULL when ``whole`` is 0; rounded when ``scale`` is given."""
    rate = F.try_divide(part.cast("double") * F.lit(100.0), whole.cast("double"))
    return rate if scale is None else F.round(rate, scale)


def mean(total: Column, count: Column, scale: int | None = 2) -> Column:
    """``total / count`` as a double, NULL when ``count`` is 0; rounded when ``scale`` is given."""
    value = F.try_divide(total.cast("double"), count.cast("double"))
    return value if scale is None else F.round(value, scale)


def exact_mean(total: Column, count: Column, scale: int) -> Column:
    """``total / count`` of a whole or decimal total, divided in decimal and rounded half-up.

    For stored metrics that are compared with cut-offs later, where the last digit decides.
    """
    quotient = F.try_divide(total.cast("decimal(24,4)"), count.cast("decimal(13,0)"))
    return F.round(quotient, scale)
