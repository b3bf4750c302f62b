"""The supplier summary's per-order aggregate runs in tasks sized by the input, and one pass serves both benchmarks."""

import re

import pytest

from tabaudit.operators import skew
from tabaudit.registry.catalog import REGISTRY
from tabaudit.sources import bucket_count
from tests.conftest import DATA
from tests.compare import connect, difference


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["entity_summary", "top_entities"])
def test_orders_of_a_supplier_are_dealt_by_the_input(spark, monkeypatch, name):
    monkeypatch.setattr(skew, "TASK_BYTES", 32 << 10)
    plan = _plan(REGISTRY[name](spark, DATA))
    dealt = re.findall(r"hashpartitioning\(l_suppkey#\d+L, l_orderkey#\d+L, (\d+)\), REPARTITION_BY_NUM", plan)
    tables = [spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("lineitem", "orders")]
    assert dealt and min(map(int, dealt)) >= max(bucket_count(t, 32 << 10) for t in tables) > 16
    assert difference(spark, connect(DATA), name, DATA) is None


def test_the_decision_reads_the_summary_only(spark):
    plan = _plan(REGISTRY["supplier_revenue_at_risk"](spark, DATA))
    assert "FileScan" not in plan and "Join" not in plan
