"""Relations between tables: matches, orphans, reconciled totals.

Nothing here joins raw rows. Both sides are counted per key first, which combines on the map side, so
a key that owns a third of all rows becomes one row before the shuffle and cannot multiply with its
partners. The exact number of joined rows is then the sum of products of the counts.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Relation:
    """``child.on`` should point at ``parent.to``."""

    name: str
    child: DataFrame
    parent: DataFrame
    on: str
    to: str | None = None

    @property
    def target(self) -> str:
        return self.to or self.on


def _rows_per_key(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias(name))


def referential_matches(
    child: DataFrame, parent: DataFrame, on: str, to: str | None = None, name: str | None = None
) -> DataFrame:
    """One row: child rows, joined rows, and child rows without a parent (NULL keys included).

    ``matched_rows`` is what an inner join would return; it exceeds ``child_rows`` when the parent key
    is not unique.
    """
    relation = Relation(name or f"{on}_to_{to or on}", child, parent, on, to)
    children = _rows_per_key(relation.child, relation.on, "_child")
    parents = _rows_per_key(relation.parent, relation.target, "_parent")
    matched = F.col("_child") * F.coalesce(F.col("_parent"), F.lit(0))
    orphans = F.when(F.col("_parent").isNull(), F.col("_child")).otherwise(0)
    return children.join(parents, "_key", "left").agg(
        F.lit(relation.name).alias("relation"),
        F.coalesce(F.sum("_child"), F.lit(0)).alias("child_rows"),
        F.coalesce(F.sum(matched), F.lit(0)).alias("matched_rows"),
        F.coalesce(F.sum(orphans), F.lit(0)).alias("orphan_rows"),
    )


def referential_audit(relations: Sequence[Relation]) -> DataFrame:
    """One row per relation."""
    rows = [referential_matches(r.child, r.parent, r.on, r.to, r.name) for r in relations]
    return reduce(DataFrame.unionByName, rows)


def reconcile_total(left: DataFrame, right: DataFrame, left_metric: Column, right_metric: Column) -> DataFrame:
    """Two whole-table aggregates side by side, with their difference."""
    right_total = right.agg(right_metric.alias("_total")).scalar()
    return (
        left.agg(left_metric.alias("left_total"))
        .withColumn("right_total", right_total)
        .withColumn("difference", F.col("left_total") - F.col("right_total"))
    )


def missing_after_join(
    df: DataFrame, other: DataFrame, on: str, col: str, to: str | None = None
) -> DataFrame:
    """Rows of ``df JOIN other`` whose derived ``col`` is NULL although a partner exists."""
    absent = _rows_per_key(df.filter(F.col(col).isNull()), on, "_left")
    partners = _rows_per_key(other, to or on, "_right")
    return absent.join(partners, "_key").agg(
        F.coalesce(F.sum(F.col("_left") * F.col("_right")), F.lit(0)).alias("missing_rows")
    )


