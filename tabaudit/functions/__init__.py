"""Column builders: pure ``Column`` expressions, no data access, no Python UDFs."""

from tabaudit.functions.columns import (
    band,
    band_closed,
    classify,
    code_to_label,
    day_variance,
    days_to_years,
    guarded_ratio,
    in_every,
    null_flag,
    outcome_flag,
    percent,
    threshold_flag,
    value_flag,
)

__all__ = [
    "band",
    "band_closed",
    "classify",
    "code_to_label",
    "day_variance",
    "days_to_years",
    "guarded_ratio",
    "in_every",
    "null_flag",
    "outcome_flag",
    "percent",
    "threshold_flag",
    "value_flag",
]
