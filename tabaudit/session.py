"""Session settings the operators are tuned for, and the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings that help at any size. A cluster's own values win: these are applied by
# ``build_session`` only, never forced on a session somebody else made.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join partition even if that costs one more shuffle afterwards.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    # No call-site capture per column expression; it doubles the time to build a long plan.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


PARTITION_BYTES = 128 << 20


def shuffle_partitions(shuffled_bytes: int) -> int:
    """Partitions that keep each shuffle task near 128 MB, well inside an executor's memory."""
    return max(1, -(-shuffled_bytes // PARTITION_BYTES))


def build_session(
    app: str = "tabaudit", master: str | None = None, shuffled_bytes: int | None = None, **extra: str
) -> SparkSession:
    """A session with the recommended settings.

    ``shuffled_bytes`` is the size of the largest expected shuffle: of the columns a plan moves, not of
    the files. It sets the number of partitions AQE starts from; AQE merges the small ones again.
    """
    builder = SparkSession.builder.appName(app)
    if shuffled_bytes is not None:
        start = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
        builder = builder.config(start, str(shuffle_partitions(shuffled_bytes)))
    if master is not None:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder for reliable checkpoints.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session may fall back to a scratch
    folder, because other machines could not read it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    return tempfile.mkdtemp(prefix="tabaudit-checkpoint-")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder once, so that reuse survives lost executors."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_dir(df.sparkSession))
    return df.checkpoint(eager=True)
