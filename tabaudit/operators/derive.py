"""Derived columns: conversions, labels, bands, flags, ratios, lookups. All are projections, except that
``translate_lookup`` joins a lookup table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabaudit.functions import columns as C
from tabaudit.operators import skew


def days_to_years(
    df: DataFrame, col: str, name: str, null_when: Column | None = None, scale: int = 1
) -> DataFrame:
    return df.withColumn(name, C.days_to_years(col, null_when, scale))


def code_to_label(df: DataFrame, col: str, labels: Mapping, default: str, name: str) -> DataFrame:
    return df.withColumn(name, C.code_to_label(col, labels, default))


def to_timestamps(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``YYYY-MM-DD HH:MM:SS`` text to a timestamp without zone. NULL stays NULL, and so does text that
    is no timestamp; ``format_conformance`` counts such text beforehand."""
    return df.withColumns({c: F.col(c).try_cast("timestamp_ntz") for c in cols})


def outcome_flag(df: DataFrame, actual: str, promised: str, name: str) -> DataFrame:
    return df.withColumn(name, C.outcome_flag(actual, promised))


def day_variance(df: DataFrame, actual: str, promised: str, name: str) -> DataFrame:
    return df.withColumn(name, C.day_variance(actual, promised))


def guarded_ratio(
    df: DataFrame,
    num: str,
    den: str,
    name: str,
    scale: int | None = 4,
    precision: int = 38,
    null_when: Column | None = None,
) -> DataFrame:
    return df.withColumn(name, C.guarded_ratio(num, den, scale, precision, null_when))


def band(df: DataFrame, col: str, edges: Sequence, labels: Sequence[str], name: str) -> DataFrame:
    return df.withColumn(name, C.band(col, edges, labels))


def band_closed(df: DataFrame, col: str, ranges: Sequence[tuple], name: str) -> DataFrame:
    return df.withColumn(name, C.band_closed(col, ranges))


def classify(df: DataFrame, rules: Sequence[tuple[Column, str]], default: str | None, name: str) -> DataFrame:
    return df.withColumn(name, C.classify(rules, default))


def translate_lookup(
    df: DataFrame,
    lookup: DataFrame,
    on: str,
    value: str,
    name: str,
    overrides: Mapping[str, str] | None = None,
    lookup_key: str | None = None,
    spread_hot: bool = False,
    rows_per_task: int | None = None,
) -> DataFrame:
    """Add a label by lookup; manual overrides win; no match leaves NULL.

    The lookup key must be unique (``duplicate_keys`` checks it). No broadcast is forced: Catalyst and AQE
    broadcast the lookup while its measured size is below the session's threshold. Beyond that it is a
    shuffled join of plain inputs, whose hot partitions AQE splits; ``spread_hot`` salts hot keys instead, for
    sessions without AQE: a key gets one salt per ``rows_per_task`` rows (``skew.ROWS_PER_TASK`` by default).
    """
    pairs = lookup.select(F.col(lookup_key or on).alias("_key"), F.col(value).alias("_label"))
    match = F.col(on) == F.col("_key")
    rows = df
    if spread_hot:
        hot = skew.hot_buckets(df, on, rows_per_task)
        rows = skew.spread(df, on, df.columns, hot)
        pairs = skew.repeat_used(pairs, "_key", hot, rows, on).withColumnRenamed(skew.SALT, "_key_salt")
        match &= F.col(skew.SALT) == F.col("_key_salt")
    label = F.col("_label")
    if overrides:
        manual = C.classify([(F.col(on) == raw, text) for raw, text in overrides.items()], None)
        label = F.coalesce(manual, label)
    joined = rows.join(pairs, match, "left")
    return joined.select(*[F.col(c) for c in df.columns if c != name], label.alias(name))
