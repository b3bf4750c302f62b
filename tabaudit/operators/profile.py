"""Read-only profiling: counts, missing values, ranges, distributions, duplicates.

Rule of the module: one aggregate per table, however many columns are asked about. Every ``*_audit``
returns one wide row, and ``audit`` fuses all of them into a single scan. Aggregates combine on the map
side, so only one small row per task is shuffled, whatever the size or skew of the table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabaudit.functions.columns import mean

TIMESTAMP_TEXT = r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01]) ([01]\d|2[0-3]):[0-5]\d:[0-5]\d$"


# --- aggregate expressions -----------------------------------------------------------------------


def null_counts(cols: Sequence[str]) -> list[Column]:
    return [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in cols]


def blank_counts(cols: Sequence[str], null_is_blank: bool = False) -> list[Column]:
    """Empty strings per column. A CSV reader turns an empty field into NULL, so a port of an audit of
    text that arrived by CSV wants ``null_is_blank=True``."""

    def blank(c: str) -> Column:
        empty = F.col(c) == ""
        return (F.col(c).isNull() | empty) if null_is_blank else empty

    return [F.count_if(blank(c)).alias(f"blank_{c}") for c in cols]


def predicate_counts(predicates: Mapping[str, Column]) -> list[Column]:
    return [F.count_if(p).alias(name) for name, p in predicates.items()]


def range_stats(cols: Sequence[str] | Mapping[str, int | None], scale: int | None = 2) -> list[Column]:
    """min, max, rounded mean and NULL count per column; a mapping sets the rounding per column.

    Decimals are summed exactly before the one division.
    """
    scales = cols if isinstance(cols, Mapping) else {c: scale for c in cols}
    out = []
    for c, digits in scales.items():
        average = mean(F.sum(c), F.count(c), digits)
        out += [
            F.min(c).alias(f"min_{c}"),
            F.max(c).alias(f"max_{c}"),
            average.alias(f"avg_{c}"),
            F.count_if(F.col(c).isNull()).alias(f"null_{c}"),
        ]
    return out


# --- one-row audits ------------------------------------------------------------------------------


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("records"))


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One labelled row per table. On parquet each branch reads footers only."""
    parts = [
        df.agg(F.count("*").alias("records")).select(F.lit(name).alias("table_name"), "records")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def null_audit(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.agg(*null_counts(cols))


def blank_audit(df: DataFrame, cols: Sequence[str], null_is_blank: bool = False) -> DataFrame:
    return df.agg(*blank_counts(cols, null_is_blank))


def count_where(df: DataFrame, predicates: Mapping[str, Column]) -> DataFrame:
    """Rows for which each predicate is true, all predicates in one pass."""
    return df.agg(*predicate_counts(predicates))


def numeric_profile(
    df: DataFrame, cols: Sequence[str] | Mapping[str, int | None], scale: int | None = 2
) -> DataFrame:
    return df.agg(*range_stats(cols, scale))


def baseline_metrics(df: DataFrame, exprs: Mapping[str, Column]) -> DataFrame:
    """Whole-table benchmarks from named aggregate expressions."""
    return df.agg(*[e.alias(name) for name, e in exprs.items()])


def audit(
    df: DataFrame,
    nulls: Sequence[str] = (),
    blanks: Sequence[str] = (),
    counts: Mapping[str, Column] | None = None,
    metrics: Mapping[str, Column] | None = None,
    null_is_blank: bool = False,
) -> DataFrame:
    """Row count, NULLs, blanks, suspect values and benchmarks of one table in a single scan."""
    return df.agg(
        F.count("*").alias("records"),
        *null_counts(nulls),
        *blank_counts(blanks, null_is_blank),
        *predicate_counts(counts or {}),
        *[e.alias(name) for name, e in (metrics or {}).items()],
    )


def mean_of_group_totals(df: DataFrame, key: str, value: str, scale: int | None = 2) -> DataFrame:
    """Mean over keys of the per-key sums, e.g. the average order value."""
    totals = df.groupBy(key).agg(F.sum(value).alias("_total"))
    return totals.agg(mean(F.sum("_total"), F.count("_total"), scale).alias("mean_total"))


def format_conformance(df: DataFrame, cols: Sequence[str], pattern: str = TIMESTAMP_TEXT) -> DataFrame:
    """Values of each text column that do and do not have the expected form (NULL is neither)."""
    out = []
    for c in cols:
        fits = F.col(c).rlike(pattern)
        out += [F.count_if(fits).alias(f"conforming_{c}"), F.count_if(~fits).alias(f"malformed_{c}")]
    return df.agg(*out)


def structural_null_check(df: DataFrame, col: str, condition: Column) -> DataFrame:
    """Do the NULLs of ``col`` coincide with ``condition``, row by row?

    Structural missingness means both mismatch counts are 0. Comparing two totals, as one would by
    hand, cannot see mismatches that cancel out.
    """
    missing, holds = F.col(col).isNull(), F.coalesce(condition, F.lit(False))
    return df.agg(
        F.count_if(missing).alias("null_rows"),
        F.count_if(holds).alias("condition_rows"),
        F.count_if(missing & holds).alias("null_and_condition"),
        F.count_if(missing & ~holds).alias("null_without_condition"),
        F.count_if(~missing & holds).alias("value_despite_condition"),
    )


def change_audit(before: DataFrame, after: DataFrame, predicates: Mapping[str, Column]) -> DataFrame:
    """The same counts before and after a correction: two rows, one pass per frame.

    Predicates are unresolved column expressions, so each is resolved against the frame it is counted on.
    """
    stages = [
        count_where(df, predicates).select(F.lit(stage).alias("stage"), *predicates)
        for stage, df in (("before", before), ("after", after))
    ]
    return stages[0].unionByName(stages[1])


def audited_write(
    before: DataFrame, correct: Callable[[DataFrame], DataFrame], path: str, predicates: Mapping[str, Column]
) -> tuple[DataFrame, DataFrame]:
    """Write ``correct(before)`` as parquet to ``path`` and count ``predicates`` before and after on the way.

    Both sets of counts are observed metrics of the write job itself: the input is read once, by the write, and no
    further pass counts anything. Returns the written table, read back, and the two audit rows of ``change_audit``.
    """
    spark = before.sparkSession
    seen = {stage: Observation(f"audit-{stage}-{uuid.uuid4().hex}") for stage in ("before", "after")}

    counts = [F.count_if(F.coalesce(p, F.lit(False))).alias(name) for name, p in predicates.items()]
    watched = before.observe(seen["before"], *counts)
    correct(watched).observe(seen["after"], *counts).write.parquet(path)
    rows = [(stage, *[seen[stage].get[name] for name in predicates]) for stage in ("before", "after")]
    schema = T.StructType(
        [T.StructField("stage", T.StringType())] + [T.StructField(name, T.LongType()) for name in predicates]
    )
    return spark.read.parquet(path), spark.createDataFrame(rows, schema)


# --- value sets and distributions ----------------------------------------------------------------


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """The value set; NULL is one of the values."""
    return df.select(col).distinct()


def _name_value_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in cols]
    )
    return df.select(F.inline(pairs))


def distinct_values_of(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Value sets of many columns in one scan, as ``(column_name, value)`` text rows."""
    return _name_value_pairs(df, cols).distinct()


def value_distribution(
    df: DataFrame, col: str, where: Column | None = None, name: str = "records"
) -> DataFrame:
    """Rows per value, most frequent first (ties by value)."""
    rows = df if where is None else df.filter(where)
    return rows.groupBy(col).agg(F.count("*").alias(name)).orderBy(F.desc(name), F.asc(col))


def value_distributions(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distributions of many columns in one scan, as ``(column_name, value, records)``."""
    return (
        _name_value_pairs(df, cols)
        .groupBy("column_name", "value")
        .agg(F.count("*").alias("records"))
        .orderBy("column_name", F.desc("records"), "value")
    )


# --- duplicates ----------------------------------------------------------------------------------


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def duplicate_keys(df: DataFrame, key: str | Sequence[str], name: str = "duplicates") -> DataFrame:
    """Keys that occur more than once, with their number of rows. Empty when the table is clean."""
    return df.groupBy(*_keys(key)).agg(F.count("*").alias(name)).filter(F.col(name) > 1)


def duplicate_keys_prefiltered(df: DataFrame, key: str | Sequence[str], name: str = "duplicates") -> DataFrame:
    """``duplicate_keys`` that shuffles whole keys only where a repeat is possible.

    A first pass counts a 64-bit hash of the key, combined on the map side: narrow rows, whatever the key's width.
    Only rows whose hash occurs more than once (repeated keys, and the rare keys that share a hash) go on to the
    exact count of whole keys, so the second shuffle is in proportion to the possible duplicates. NULL keys hash
    like any value and are counted as in ``duplicate_keys``.
    """
    keys = _keys(key)
    hashed = df.withColumn("_key_hash", F.xxhash64(*[F.col(k) for k in keys]))
    repeated = hashed.groupBy("_key_hash").agg(F.count("*").alias("_n")).filter(F.col("_n") > 1).select("_key_hash")
    possible = hashed.join(repeated, "_key_hash", "left_semi")
    return possible.groupBy(*keys).agg(F.count("*").alias(name)).filter(F.col(name) > 1)


def duplicate_key_count(df: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """How many keys are duplicated and how many rows a deduplication would remove; 0 when clean."""
    repeated = duplicate_keys(df, key, "_n")
    return repeated.agg(
        F.count("*").alias("duplicated_keys"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("surplus_rows"),
    )
