"""Small helpers of the registered queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabaudit.session import checkpoint_dir


def plain(df: DataFrame) -> DataFrame:
    """Decimals and floats as doubles, small integers as ints, so that results compare across engines."""

    def widened(f: T.StructField):
        if isinstance(f.dataType, (T.DecimalType, T.FloatType)):
            return F.col(f.name).cast("double").alias(f.name)
        if isinstance(f.dataType, (T.ByteType, T.ShortType)):
            return F.col(f.name).cast("int").alias(f.name)
        return F.col(f.name)

    return df.select(*[widened(f) for f in df.schema.fields])


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share, removed by Hadoop when the application ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/tabaudit/{name}-{uuid.uuid4().hex}"
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def rate_sql(target: str, name: str = "rate") -> str:
    return f"CAST(sum({target}) AS DOUBLE) * 100.0 / nullif(count({target}), 0) AS {name}"


def mean_sql(value: str, name: str) -> str:
    return f"CAST(sum({value}) AS DOUBLE) / nullif(count({value}), 0) AS {name}"


def half_up_sql(num: str, den: str, digits: int) -> str:
    """``num / den`` rounded half-up, in whole numbers; both must be whole and not negative."""
    num, den = f"CAST({num} AS HUGEINT)", f"CAST({den} AS HUGEINT)"
    unit = f"CAST({10**-digits:.{digits}f} AS DECIMAL({digits + 1},{digits}))"
    return f"(CAST(({num} * {2 * 10**digits} + {den}) // (2 * {den}) AS DECIMAL(18,0)) * {unit})"
