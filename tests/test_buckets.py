from pyspark.sql import functions as F

from tabaudit.registry.catalog import REGISTRY
from tabaudit.sources import materialize
from tests.conftest import DATA


def _plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_tables_join_without_exchange(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(REGISTRY["bucketed_join"](spark, DATA))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan
    assert "hashpartitioning(l_orderkey" not in plan and "hashpartitioning(o_orderkey" not in plan


def test_buckets_keep_every_row(spark, tmp_path):
    rows = spark.range(1000).select((F.col("id") % 37).alias("k"), F.col("id").alias("v"))
    stored = materialize(rows, "tabaudit_test_buckets", buckets=(4, ["k"]), location=str(tmp_path / "b"))
    assert sorted(tuple(r) for r in stored.collect()) == sorted(tuple(r) for r in rows.collect())
    assert spark.catalog.getTable("tabaudit_test_buckets") is not None
