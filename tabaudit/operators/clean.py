"""Corrections, missing values, deduplication.

All but the medians and ``dedupe_latest`` are projections: they add no shuffle,
and chains of them collapse into one ``Project``. Rows are never dropped by a correction.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.sql import types as T

from tabaudit.functions import columns as C
from tabaudit.functions.selection import middle_values


def sentinel_to_null(df: DataFrame, sentinels: Mapping[str, Sequence]) -> DataFrame:
    """Stand-in values (text or number) become NULL; everything else stays."""
    changed = {}
    for c, values in sentinels.items():
        hit = F.col(c).isin(list(values))
        changed[c] = F.when(~hit, F.col(c))
    return df.withColumns(changed)


def blank_to_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in cols})


def threshold_flag(df: DataFrame, col: str, gt, name: str) -> DataFrame:
    return df.withColumn(name, C.threshold_flag(col, gt))


def null_flag(df: DataFrame, col: str, name: str) -> DataFrame:
    return df.withColumn(name, C.null_flag(col))


def value_flag(df: DataFrame, col: str, value, name: str) -> DataFrame:
    return df.withColumn(name, C.value_flag(col, value))


def exact_medians(df: DataFrame, scales: Mapping[str, int | None]) -> DataFrame:
    """The exact median of every column, each rounded to its scale, as one row; NULL does not count.

    The mean of the middle one or two values. Exact at any size: ``functions.selection`` finds the middle of all columns
    together in five scans, without sorting the table, a window over it or a map of its values.
    """
    medians = []
    for i, (name, scale) in enumerate(scales.items()):
        exact = isinstance(df.schema[name].dataType, T.DecimalType)
        lower, upper = (F.col(f"{c}_{i}") if exact else F.col(f"{c}_{i}").cast("double") for c in ("lower", "upper"))
        median = (lower + upper) / F.lit(2)
        medians.append((median if scale is None else F.round(median, scale)).alias(name))
    return middle_values(df, list(scales)).select(*medians)


def exact_median(df: DataFrame, col: str, scale: int | None = None, name: str = "median") -> DataFrame:
    """The median of one column, as one row."""
    return exact_medians(df, {col: scale}).select(F.col(col).alias(name))


def impute_medians(df: DataFrame, scales: Mapping[str, int | None]) -> DataFrame:
    """Fill NULL with the exact median of each column; types do not change.

    The medians enter as one scalar subquery, computed once, so the fill itself is a projection.
    """
    medians = exact_medians(df, scales).select(F.struct(*scales).alias("medians")).scalar()
    return df.withColumns(
        {c: F.coalesce(F.col(c), medians.getField(c).cast(df.schema[c].dataType)) for c in scales}
    )


def impute_median(df: DataFrame, col: str, scale: int | None = None) -> DataFrame:
    """Fill NULL with the exact median of one column."""
    return impute_medians(df, {col: scale})


def impute_constant(df: DataFrame, values: Mapping) -> DataFrame:
    return df.withColumns(
        {c: F.coalesce(F.col(c), F.lit(v).cast(df.schema[c].dataType)) for c, v in values.items()}
    )


def reclassify_null(df: DataFrame, col: str, label: str) -> DataFrame:
    """NULL becomes a category of its own."""
    return df.withColumn(col, F.coalesce(F.col(col), F.lit(label)))


def dedupe_latest(df: DataFrame, key: str | Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the greatest by ``order`` (all descending, NULL last).

    Ties fall to the remaining columns in their order in the frame, so the kept row depends on the data
    only. ``max(struct)`` combines on the map side, by sorting: a key with any number of rows sends one row per
    task. Columns whose type has no order (maps) cannot be part of the frame.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys and c not in order]
    newest = F.max(F.struct(*order, *rest)).alias("_newest")
    kept = df.groupBy(*keys).agg(newest)
    return kept.select(*[c if c in keys else F.col("_newest").getField(c).alias(c) for c in df.columns])


def dedupe_latest_limited(df: DataFrame, key: str | Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the greatest by ``order`` (all descending, NULL last), by a group limit.

    A ranked window kept to its first row: Spark limits each task's rows of a key to one before the shuffle
    (``WindowGroupLimit``), then once more after it, so a key with any number of rows sends one row per task and no
    aggregate carries all columns in a struct. Ties fall to the remaining orderable columns in their order in the
    frame, descending; columns without an order (maps) ride along and cannot break a tie, so among rows equal in
    all other columns the kept one is any of them.
    """
    keys = [key] if isinstance(key, str) else list(key)
    unordered = (T.MapType,)
    rest = [c for c in df.columns if c not in keys and c not in order and not isinstance(df.schema[c].dataType, unordered)]
    ranking = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in [*order, *rest]])
    return df.withColumn("_rank", F.row_number().over(ranking)).filter(F.col("_rank") == 1).drop("_rank")


def narrow_type(df: DataFrame, col: str, to: str | T.DataType) -> DataFrame:
    """Store a float- or decimal-coded whole number in a small type.

    A value that the type cannot hold, or a fraction that it would lose, fails the job;
    ``narrowing_losses`` counts them beforehand.
    """
    return df.withColumn(col, C.fitting_cast(col, to, exact=True))


def narrowing_losses(df: DataFrame, col: str, to: str | T.DataType) -> DataFrame:
    """Values that a cast to ``to`` would change or could not hold."""
    narrowed: Column = F.col(col).try_cast(to)
    changed = F.col(col).isNotNull() & (narrowed.isNull() | (narrowed != F.col(col)))
    return df.agg(F.count(col).alias("checked"), F.count_if(changed).alias("losses"))
