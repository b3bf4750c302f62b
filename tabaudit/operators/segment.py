"""Segment, rank and compare: the queries that answer the business question.

``scale`` rounds rates and means; ``None`` leaves them unrounded. Rates are percentages of a 0/1 target;
NULL targets do not count. Grouping combines on the map side, so hot groups cost one row per task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabaudit.functions.columns import band as band_column
from tabaudit.functions.columns import classify as classify_column
from tabaudit.functions.columns import percent
from tabaudit.operators.star import (
    Link,
    joined_aggregate,
    mean_of,
    rate_of,
    rows_of,
    total_of,
)
from tabaudit.session import cut_lineage


def _dims(dims: str | Sequence[str]) -> list[str]:
    return [dims] if isinstance(dims, str) else list(dims)


def _where(df: DataFrame, where: Column | None) -> DataFrame:
    return df if where is None else df.filter(where)


def rate_expr(target: str, scale: int | None = 2) -> Column:
    return percent(F.sum(target), F.count(target), scale)


def mean_expr(value: str | Column, scale: int | None = 2) -> Column:
    """Mean as a double. Decimals are summed exactly before the one division."""
    col = F.col(value) if isinstance(value, str) else value
    average = F.try_divide(F.sum(col).cast("double"), F.count(col).cast("double"))
    return average if scale is None else F.round(average, scale)


def rate_by(
    df: DataFrame,
    dims: str | Sequence[str],
    target: str,
    where: Column | None = None,
    scale: int | None = 2,
    rate: str = "rate",
    volume: str = "volume",
) -> DataFrame:
    """Rate and volume per group, highest rate first."""
    dims = _dims(dims)
    out = _where(df, where).groupBy(*dims).agg(
        rate_expr(target, scale).alias(rate), F.count("*").alias(volume)
    )
    return out.orderBy(F.desc(rate), *dims)


def rate_by_band(
    df: DataFrame,
    bands: Mapping[str, Column],
    target: str,
    where: Column | None = None,
    scale: int | None = 2,
    rate: str = "rate",
    volume: str = "volume",
) -> DataFrame:
    """``rate_by`` over one or more computed bands."""
    banded = _where(df, where).select(F.col(target), *[c.alias(name) for name, c in bands.items()])
    return rate_by(banded, list(bands), target, None, scale, rate, volume)


def range_by(
    df: DataFrame, dims: str | Sequence[str], col: str, where: Column | None = None, scale: int | None = 4
) -> DataFrame:
    """min, max and mean of a measure per group, highest mean first."""
    dims = _dims(dims)
    low, high = F.min(col), F.max(col)
    if scale is not None:
        low, high = F.round(low, scale), F.round(high, scale)
    names = [f"min_{col}", f"max_{col}", f"avg_{col}"]
    aggs = [e.alias(n) for e, n in zip((low, high, mean_expr(col, scale)), names)]
    return _where(df, where).groupBy(*dims).agg(*aggs).orderBy(F.desc(names[2]), *dims)


def mean_by(
    df: DataFrame,
    dims: str | Sequence[str],
    value: str,
    where: Column | None = None,
    scale: int | None = 2,
    volume: str = "volume",
) -> DataFrame:
    """Mean of a measure and volume per group. NULL is a group of its own."""
    dims = _dims(dims)
    return (
        _where(df, where)
        .groupBy(*dims)
        .agg(mean_expr(value, scale).alias(f"avg_{value}"), F.count("*").alias(volume))
        .orderBy(*dims)
    )


def profile_metrics(
    df: DataFrame, predicates: Sequence[Column], metrics: Mapping[str, Column]
) -> DataFrame:
    """Metrics of the one segment in which every predicate holds."""
    for predicate in predicates:
        df = df.filter(predicate)
    return df.agg(*[e.alias(name) for name, e in metrics.items()])


def compare_profiles(
    df: DataFrame,
    rules: Sequence[tuple[Column, str]],
    default: str | None,
    metrics: Mapping[str, Column],
    name: str = "profile",
    where: Column | None = None,
) -> DataFrame:
    """Metrics of every rule-defined profile side by side."""
    classed = _where(df, where).withColumn(name, classify_column(rules, default))
    return classed.groupBy(name).agg(*[e.alias(n) for n, e in metrics.items()]).orderBy(name)


def top_k_min_volume(
    df: DataFrame, dim: str, target: str, min_n: int, k: int, scale: int | None = 2
) -> DataFrame:
    """The ``k`` groups of highest rate among those with more than ``min_n`` rows that name the group."""
    groups = df.groupBy(dim).agg(
        rate_expr(target, scale).alias("rate"), F.count("*").alias("volume"), F.count(dim).alias("_named")
    )
    ranked = groups.filter(F.col("_named") > min_n).orderBy(F.desc("rate"), F.asc(dim))
    return ranked.limit(k).drop("_named")


def joined_rate(
    fact: DataFrame,
    links: Sequence[Link],
    dim: str | Sequence[str],
    target: str,
    min_n: int | None = None,
    inclusive: bool = False,
    where: Column | None = None,
    scale: int | None = 2,
    means: Mapping[str, int | None] | None = None,
) -> DataFrame:
    """``rate_by`` after joins, with a volume floor. ``means`` adds ``avg_<measure>`` columns."""
    means = means or {}
    outputs = {"volume": rows_of(), "rate": rate_of(target, scale)}
    outputs |= {f"avg_{m}": mean_of(m, digits) for m, digits in means.items()}
    return joined_aggregate(
        fact, links, _dims(dim), [target, *means], outputs, min_n, inclusive, where, [F.desc("rate")]
    )


def joined_mean(
    fact: DataFrame,
    links: Sequence[Link],
    dim: str | Sequence[str],
    value: str,
    min_n: int | None = None,
    inclusive: bool = False,
    where: Column | None = None,
    scale: int | None = 2,
) -> DataFrame:
    """Mean score per dimension after joins, lowest first."""
    name = f"avg_{value}"
    outputs = {"volume": rows_of(), name: mean_of(value, scale)}
    return joined_aggregate(
        fact, links, _dims(dim), [value], outputs, min_n, inclusive, where, [F.asc(name)]
    )


def joined_total(
    fact: DataFrame,
    links: Sequence[Link],
    dim: str | Sequence[str],
    value: str,
    min_n: int | None = None,
    inclusive: bool = False,
    where: Column | None = None,
    scale: int | None = 2,
) -> DataFrame:
    """Sum and mean of a measure per dimension after joins, greatest sum first."""
    outputs = {"volume": rows_of(), "total": total_of(value), "average": mean_of(value, scale)}
    return joined_aggregate(
        fact, links, _dims(dim), [value], outputs, min_n, inclusive, where, [F.desc("total")]
    )


def joined_multi(
    fact: DataFrame,
    links: Sequence[Link],
    dims: Sequence[str],
    rates: Mapping[str, int | None],
    means: Mapping[str, int | None],
    min_n: int | None = None,
    inclusive: bool = False,
    where: Column | None = None,
    rows_per_task: int | None = None,
) -> DataFrame:
    """Several rates and means over several dimensions after joins, highest first rate on top."""
    outputs = {"volume": rows_of()}
    outputs |= {f"rate_{m}": rate_of(m, digits) for m, digits in rates.items()}
    outputs |= {f"avg_{m}": mean_of(m, digits) for m, digits in means.items()}
    first = F.desc(f"rate_{next(iter(rates))}")
    return joined_aggregate(
        fact, links, list(dims), [*rates, *means], outputs, min_n, inclusive, where, [first], rows_per_task
    )


def share_distribution(
    df: DataFrame,
    dim: str,
    order_by: str | None = None,
    where: Column | None = None,
    scale: int | None = 2,
) -> DataFrame:
    """Rows per group and their share of all rows, in order of the group or of ``min(order_by)``.

    One aggregate by grouping sets gives the group rows and the grand total together. It is written once as a
    reliable checkpoint (one row per group), and both the group rows and the total read that: the input is read once,
    by one job. No task sees all groups.
    """
    order = F.min(order_by) if order_by else F.min(dim)
    sets = _where(df, where).groupingSets([[dim], []], dim).agg(
        F.count("*").alias("volume"), order.alias("_order"), F.grouping_id().alias("_set")
    )
    sets = cut_lineage(sets)
    total = sets.agg(F.max(F.when(F.col("_set") == 1, F.col("volume")))).scalar()
    groups = sets.filter(F.col("_set") == 0).drop("_set")
    shares = groups.withColumn("share", percent(F.col("volume"), total, scale))
    return shares.orderBy("_order", dim).drop("_order")


def outcome_headline(
    df: DataFrame, flag: str, where: Column | None = None, scale: int | None = 2
) -> DataFrame:
    """Total, positives, rate and negatives in one row. Rows without an outcome are in the total only."""
    return _where(df, where).agg(
        F.count("*").alias("total"),
        F.count_if(F.col(flag) == 1).alias("positives"),
        rate_expr(flag, scale).alias("rate"),
        F.count_if(F.col(flag) == 0).alias("negatives"),
    )


def monthly_trend(
    df: DataFrame,
    ts: str,
    flag: str,
    start: str,
    end: str,
    where: Column | None = None,
    scale: int | None = 2,
) -> DataFrame:
    """Volume and rate per calendar month, ``start`` and ``end`` included to the second.

    An ``end`` without a time of day is its midnight: the rest of that day is outside. The bounds are
    compared with the raw timestamp, so they are pushed down to the scan. The month is cut from the text
    form, which involves no time zone.
    """
    low, high = (F.lit(text).cast("timestamp_ntz") for text in (start, end))
    rows = _where(df, where).filter(F.col(ts).between(low, high))
    return (
        rows.groupBy(F.substring(F.col(ts).cast("string"), 1, 7).alias("month"))
        .agg(F.count("*").alias("volume"), rate_expr(flag, scale).alias("rate"))
        .orderBy("month")
    )


def month_of(ts: str) -> Column:
    """The calendar month of a timestamp as text, ``YYYY-MM``, without a time zone."""
    return F.substring(F.col(ts).cast("string"), 1, 7)


def monthly_trend_pruned(
    df: DataFrame,
    ts: str,
    flag: str,
    start: str,
    end: str,
    where: Column | None = None,
    scale: int | None = 2,
    month: str = "month",
) -> DataFrame:
    """``monthly_trend`` of a table stored partitioned by ``month`` (``month_of(ts)``, e.g. by ``materialize``).

    The bounds also fix the months, so the scan lists only the partitions between them (``PartitionFilters``); the
    exact bounds on the raw timestamp still apply inside the first and last month.
    """
    months = F.col(month).between(F.lit(start[:7]), F.lit(end[:7]))
    low, high = (F.lit(text).cast("timestamp_ntz") for text in (start, end))
    rows = _where(df.filter(months), where).filter(F.col(ts).between(low, high))
    return (
        rows.groupBy(F.col(month).alias("month"))
        .agg(F.count("*").alias("volume"), rate_expr(flag, scale).alias("rate"))
        .orderBy("month")
    )


def top_entities(
    summary: DataFrame, key: str, by: str, k: int, where: Column | None = None
) -> DataFrame:
    """The ``k`` entities with the greatest ``by`` (ties by key)."""
    return _where(summary, where).orderBy(F.desc(by), F.asc(key)).limit(k)


def tier_compare(
    summary: DataFrame,
    size: str,
    edges: Sequence,
    labels: Sequence[str],
    metrics: Mapping[str, Column],
    where: Column | None = None,
    name: str = "tier",
) -> DataFrame:
    """Metrics per size tier, ``[lo, hi)``. Means are unweighted: each entity counts once."""
    tiered = _where(summary, where).withColumn(name, band_column(size, edges, labels))
    counts = {"entities": F.count("*"), **metrics}
    out = tiered.groupBy(name).agg(*[e.alias(n) for n, e in counts.items()])
    return out.orderBy(F.desc("entities"), name)


def share_of_total(
    df: DataFrame, value: str, where: Column, scale: int | None = 2
) -> DataFrame:
    """Sum and row count of a segment, and the segment's share of the whole sum, in one scan."""
    inside = F.sum(F.when(where, F.col(value)))
    return df.agg(
        inside.alias("segment_total"),
        F.count_if(where).alias("segment_rows"),
        percent(inside, F.sum(value), scale).alias("share"),
    )
