"""Persisting derived tables, and replacing a table by its cleaned version."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from tabaudit.session import cut_lineage

_VERSION = re.compile(r"^version=(\d+)$")


def materialize(
    df: DataFrame,
    target: str,
    partition_by: Sequence[str] | None = None,
    as_table: bool = False,
    buckets: tuple[int, Sequence[str]] | None = None,
    location: str | None = None,
) -> DataFrame:
    """Write ``df`` as parquet to a path, or as a catalog table, and read it back.

    ``buckets=(n, keys)`` stores the rows hashed on ``keys`` into ``n`` buckets, each sorted on the keys, as a catalog
    table (bucketing lives in the catalog). Two tables bucketed alike on their join keys join later without an
    exchange of either side. ``location`` puts a catalog table's files in a folder of one's own (a fresh one in the
    shared folder on a cluster); a table of that name is dropped first. The target is overwritten, so it must not be
    a table that ``df`` reads; ``replace_table`` is for that.
    """
    writer = df.write.mode("overwrite").format("parquet")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if buckets:
        count, keys = buckets
        writer = writer.bucketBy(count, *keys).sortBy(*keys)
        as_table = True
    if as_table:
        if location:
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {target}")
            writer = writer.option("path", location)
        writer.saveAsTable(target)
        return df.sparkSession.table(target)
    writer.save(target)
    return df.sparkSession.read.parquet(target)


def bucket_count(df: DataFrame, bytes_per_bucket: int = 128 << 20) -> int:
    """Buckets that hold about ``bytes_per_bucket`` of ``df``'s input files each."""
    spark = df.sparkSession
    total = 0
    for path in df.inputFiles():
        fs, where = _filesystem(spark, path)
        total += fs.getFileStatus(where).getLen()
    return max(1, -(-total // bytes_per_bucket))


def materialize_temporary(df: DataFrame, view: str) -> DataFrame:
    """Compute ``df`` once for this session and name it. It lives in the shared checkpoint folder, so
    losing executors does not lose it."""
    kept = cut_lineage(df)
    kept.createOrReplaceTempView(view)
    return kept


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def versions(spark: SparkSession, path: str, complete_only: bool = True) -> list[int]:
    """Version numbers under ``path``; a version counts once its job has committed."""
    fs, where = _filesystem(spark, path)
    if not fs.exists(where):
        return []
    found = []
    for status in fs.listStatus(where):
        match = _VERSION.match(status.getPath().getName())
        if not match:
            continue
        if complete_only and not fs.exists(status.getPath().suffix("/_SUCCESS")):
            continue
        found.append(int(match.group(1)))
    return sorted(found)


def _version_path(path: str, number: int) -> str:
    return f"{path.rstrip('/')}/version={number:06d}"


def read_current(spark: SparkSession, path: str) -> DataFrame:
    """The newest committed version of a replaceable table."""
    found = versions(spark, path)
    if not found:
        raise FileNotFoundError(f"no committed version under {path}")
    return spark.read.parquet(_version_path(path, found[-1]))


KEEP_VERSIONS = 3


def _claimed(spark: SparkSession, path: str) -> list[int]:
    fs, where = _filesystem(spark, f"{path.rstrip('/')}/_claims")
    if not fs.exists(where):
        return []
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(where) if s.getPath().getName().isdigit())


def _claim(spark: SparkSession, path: str) -> int:
    """The next version number, taken by an atomic create of its claim: of two writers, one gets it, the other
    tries the number after."""
    while True:
        number = max([0, *versions(spark, path, complete_only=False), *_claimed(spark, path)]) + 1
        fs, marker = _filesystem(spark, f"{path.rstrip('/')}/_claims/{number:06d}")
        try:
            fs.create(marker, False).close()
            return number
        except Exception as error:  # noqa: BLE001 - Hadoop reports a taken name as FileAlreadyExistsException
            if "FileAlreadyExists" not in str(error) and not fs.exists(marker):
                raise


def _retain(spark: SparkSession, path: str, keep: int) -> None:
    """Remove versions older than the ``keep`` newest committed ones, finished or left half-written."""
    committed = versions(spark, path)
    if len(committed) <= keep:
        return
    oldest_kept = committed[-keep]
    for number in versions(spark, path, complete_only=False):
        if number < oldest_kept:
            fs, folder = _filesystem(spark, _version_path(path, number))
            fs.delete(folder, True)
    for number in _claimed(spark, path):
        if number < oldest_kept:
            fs, marker = _filesystem(spark, f"{path.rstrip('/')}/_claims/{number:06d}")
            fs.delete(marker, False)


def replace_table(
    df: DataFrame, path: str, partition_by: Sequence[str] | None = None, keep: int = KEEP_VERSIONS
) -> DataFrame:
    """Make ``df`` the content of the table at ``path``.

    ``df`` may read that very table: nothing is overwritten. The writer claims a new version number by an atomic
    create (two writers at once get two numbers), writes that version folder next to the old ones, and readers
    switch to it when its commit marker appears. A job that dies half-way leaves the table as it was. After the
    commit, versions older than the ``keep`` newest committed ones are removed, also half-written ones of writers
    that died; a reader of such an old version must finish before ``keep`` newer versions are committed.
    """
    spark = df.sparkSession
    target = _version_path(path, _claim(spark, path))
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(target)
    current = read_current(spark, path)
    _retain(spark, path, keep)
    return current
