"""Declared schemas as checks: types, nullability, keys."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabaudit.operators.profile import duplicate_key_count


@dataclass(frozen=True)
class Contract:
    """Columns with types and nullability, and the primary key (empty: none declared)."""

    schema: T.StructType
    key: tuple[str, ...] = ()

    def relaxed(self, *columns: str) -> Contract:
        """The same contract with NULL allowed in some columns, e.g. after a sentinel became NULL."""
        fields = [
            T.StructField(f.name, f.dataType, f.nullable or f.name in columns) for f in self.schema.fields
        ]
        return Contract(T.StructType(fields), self.key)


def check_contract(
    df: DataFrame, schema: T.StructType, pk: Sequence[str] = (), relax: Sequence[str] = ()
) -> DataFrame:
    """Violations as ``(check_name, column_name, violations)``; every check is listed, clean ones with 0.

    * ``missing_column`` and ``type`` come from the schema alone;
    * ``not_null`` counts NULLs of all NOT NULL columns in one scan;
    * ``primary_key`` counts the rows that share their key with an earlier row.
    """
    contract = Contract(schema, tuple(pk)).relaxed(*relax)
    actual = {f.name.lower(): f.dataType for f in df.schema.fields}
    spark = df.sparkSession
    static: list[tuple[str, str, int]] = []
    required: list[str] = []
    for f in contract.schema.fields:
        found = actual.get(f.name.lower())
        static.append(("missing_column", f.name, int(found is None)))
        if found is not None:
            static.append(("type", f.name, int(found != f.dataType)))
            if not f.nullable:
                required.append(f.name)
    parts = [spark.createDataFrame(static, "check_name string, column_name string, violations bigint")]

    if required:
        counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required])
        rows = F.inline(
            F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("violations")) for c in required])
        )
        parts.append(counts.select(rows).select(F.lit("not_null").alias("check_name"), "column_name", "violations"))
    if contract.key:
        surplus = duplicate_key_count(df, contract.key)
        parts.append(
            surplus.select(
                F.lit("primary_key").alias("check_name"),
                F.lit(",".join(contract.key)).alias("column_name"),
                F.col("surplus_rows").alias("violations"),
            )
        )
    return reduce(DataFrame.unionByName, parts)
