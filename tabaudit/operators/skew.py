"""Spreading hot join keys over many tasks.

A join sends all rows of a key to one task. Where AQE can split that task (both inputs are plain shuffles), it
is left to AQE. It cannot when an input was aggregated on the key or when the next step reuses the
partitioning; there the rows of a hot key get a salt, and the partner row is repeated once per salt.

Hot is decided by exact counts of hash buckets of the key, not of the keys: a scan task sends at most 4,096
counts. A bucket gets one salt per ``rows_per_task`` of its rows, so a task holds no more than that, whatever the size
of the table. A partner row, folded to one row per key before, is repeated once per salt that rows of its key really
hold (``repeat_used``): a key has no more copies than rows, also when every bucket is hot. Counts and salts are
functions of the data, so a retried task sends its rows to the same place.

``deal`` sets the number of tasks: by the input's size, so that what a task holds does not grow with the table. Left to
AQE, small partitions are merged until there is one per core, and a task's sorts and hash tables grow with the input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabaudit.sources.storage import bucket_count

BUCKETS = 1 << 12
ROWS_PER_TASK = 5_000_000
SALT = "_salt"
TASK_BYTES = 8 << 20  # of input files


def deal(df: DataFrame, keys: Sequence[str], source: DataFrame) -> DataFrame:
    """Rows dealt by ``keys`` to one task per ``TASK_BYTES`` of ``source``'s files, and no fewer than there are cores.

    A source without files, such as a checkpoint, leaves the number to the session.
    """
    if not source.inputFiles():
        return df.repartition(*keys)
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, bucket_count(source, TASK_BYTES)), *keys)


def _bucket(key: str) -> str:
    # As text, so that an int and a bigint that are equal share a bucket.
    return f"CAST(pmod(xxhash64(CAST(`{key}` AS STRING)), {BUCKETS}) AS INT)"


def hot_buckets(df: DataFrame, key: str, rows_per_task: int | None = None) -> Column:
    """Number of salts per bucket of ``key``, as a scalar array. One scan of one column."""
    most = ROWS_PER_TASK if rows_per_task is None else rows_per_task
    counts = df.selectExpr(f"{_bucket(key)} AS bucket").groupBy("bucket").agg(F.expr("count(*) AS n"))
    salts = counts.selectExpr("bucket", f"CAST(ceil(n / {most}) AS INT) AS salts").filter("salts > 1")
    found = salts.agg(F.expr("map_from_entries(collect_list(struct(bucket, salts))) AS hot"))
    each = f"transform(sequence(0, {BUCKETS - 1}), b -> coalesce(try_element_at(hot, b), 1))"
    return found.selectExpr(f"{each} AS salts").scalar()


def _salts(hot: Column, key: str) -> Column:
    return F.get(hot, F.expr(_bucket(key)))


def spread(df: DataFrame, key: str, by: Sequence[str], hot: Column) -> DataFrame:
    """Give every row a salt from its ``by`` columns; 0 unless its key is in a hot bucket."""
    salt = F.pmod(F.xxhash64(*by), _salts(hot, key)).cast("int")
    return df.withColumn(SALT, salt)


def repeat(df: DataFrame, key: str, hot: Column) -> DataFrame:
    """The partner side, already one row per key: a copy per salt of its bucket, for few keys or few salts."""
    return df.withColumn(SALT, F.explode(F.sequence(F.lit(0), _salts(hot, key) - 1)))


def repeat_used(df: DataFrame, key: str, hot: Column, salted: DataFrame, salted_key: str) -> DataFrame:
    """The partner side, already one row per key: a copy per salt that rows of its key hold in ``salted``.

    Rows of a cold bucket all have salt 0, so only the hot buckets' pairs of key and salt are collected, once each.
    Partners are joined with those; without a pair a partner keeps one row, with salt 0.
    """
    used = salted.filter(_salts(hot, salted_key) > 1).select(
        F.col(salted_key).alias("_used_key"), F.col(SALT).alias("_used_salt")
    )
    paired = df.join(used.distinct(), F.col(key) == F.col("_used_key"), "left")
    return paired.select(*df.columns, F.coalesce("_used_salt", F.lit(0)).alias(SALT))
