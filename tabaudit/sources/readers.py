"""Typed CSV and parquet input."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv_typed(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType,
    corrupt_column: str | None = None,
    multi_line: bool = False,
    mode: str | None = None,
) -> DataFrame:
    """CSV with a header, commas, optional double quotes and newline rows, in declared types.

    Columns are matched to the header by name, ignoring case, so the schema may name 25 of 122 columns in
    any order; the parser skips the rest. No inference pass runs: only the header line is read up front.
    An empty field, quoted or not, arrives as NULL.

    A value that does not parse fails the job, unless ``corrupt_column`` is given: that adds a text column
    with the raw line wherever a value did not parse, to be counted or stopped by the caller.
    ``multi_line`` allows newlines inside quotes, at the price of one task per file.
    """
    options = {"header": "true", "sep": ",", "quote": '"', "escape": '"', "multiLine": str(multi_line).lower()}
    header = spark.read.options(**options).csv(path).columns
    wanted = {f.name.lower(): f for f in schema.fields}
    missing = sorted(set(wanted) - {h.lower() for h in header})
    if missing:
        raise ValueError(f"the file has no column {', '.join(missing)}")
    fields = [
        T.StructField(wanted[h.lower()].name, wanted[h.lower()].dataType, True)
        if h.lower() in wanted
        else T.StructField(h, T.StringType(), True)
        for h in header
    ]
    scope = [f.name for f in schema.fields]
    if corrupt_column:
        fields.append(T.StructField(corrupt_column, T.StringType(), True))
        options["columnNameOfCorruptRecord"] = corrupt_column
        scope.append(corrupt_column)
    # Every file's own header is checked against these names, so files of another shape fail loudly.
    options["enforceSchema"] = "false"
    if not multi_line:
        options["lineSep"] = "\n"
    mode = mode or ("PERMISSIVE" if corrupt_column else "FAILFAST")
    reader = spark.read.options(**options).option("mode", mode)
    return reader.schema(T.StructType(fields)).csv(path).select(*scope)


def read_csv_quarantined(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType, multi_line: bool = False
) -> tuple[DataFrame, DataFrame]:
    """The rows of a CSV in declared types, and a quarantine of the fields that do not parse.

    The file is read once as text (header matched as in ``read_csv_typed``); each declared column is parsed with
    ``try_cast``. A field with text that does not parse becomes NULL in the typed rows and one row of the quarantine:
    file, column, raw value and reason. Nothing fails and no row is dropped, so the counts per column
    (``quarantine_counts``) can be judged before the data is used.
    """
    text = T.StructType([T.StructField(f.name, T.StringType(), True) for f in schema.fields])
    raw = read_csv_typed(spark, path, text, multi_line=multi_line).withColumn("_file", F.input_file_name())
    parsed = {f.name: F.col(f.name).try_cast(f.dataType) for f in schema.fields}
    bad = [
        F.when(F.col(f.name).isNotNull() & parsed[f.name].isNull(), F.struct(
            F.lit(f.name).alias("column"), F.col(f.name).alias("raw"),
            F.lit(f"not a {f.dataType.simpleString()}").alias("reason"),
        ))
        for f in schema.fields
    ]
    quarantine = raw.select(
        F.col("_file").alias("file"), F.explode(F.filter(F.array(*bad), lambda x: x.isNotNull())).alias("q")
    ).select("file", "q.*")
    typed = raw.select(*[parsed[f.name].alias(f.name) for f in schema.fields])
    return typed, quarantine


def quarantine_counts(quarantine: DataFrame) -> DataFrame:
    """Bad fields per column."""
    return quarantine.groupBy("column").agg(F.count("*").alias("bad_fields"))


def read_parquet_tables(spark: SparkSession, folder: str, names: Sequence[str]) -> dict[str, DataFrame]:
    """Named tables from ``<folder>/<name>.parquet``."""
    return {name: spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet") for name in names}


def select_scope(df: DataFrame, columns: Sequence[str] | Mapping[str, str]) -> DataFrame:
    """Keep the analysis columns only; a mapping also renames (old to new)."""
    if isinstance(columns, Mapping):
        return df.select(*[F.col(old).alias(new) for old, new in columns.items()])
    return df.select(*columns)


def preview(
    df: DataFrame, cols: Sequence[str | Column], n: int, order_by: Sequence[str], where: Column | None = None
) -> DataFrame:
    """The first ``n`` rows in key order, so that a repeated look shows the same rows."""
    rows = df if where is None else df.filter(where)
    return rows.orderBy(*order_by).limit(n).select(*cols)
