from decimal import Decimal

import pytest

from tabaudit.functions import selection


def brute(values):
    kept = sorted(v for v in values if v is not None and v == v)
    if not kept:
        return None, None
    n = len(kept)
    return kept[(n + 1) // 2 - 1], kept[(n + 2) // 2 - 1]


def middle(spark, rows, schema):
    df = spark.createDataFrame(rows, schema)
    row = selection.middle_values(df, df.columns).first()
    return [(row[f"lower_{i}"], row[f"upper_{i}"]) for i in range(len(df.columns))]


def test_wide_decimals_are_exact(spark):
    big = Decimal(10) ** 30
    values = [big + i for i in range(7)] + [big + 3]
    rows = [(v,) for v in values]
    assert middle(spark, rows, "d decimal(38,0)") == [brute(values)]


@pytest.mark.parametrize("limit, accuracy", [(1_000_000, 10_000), (3, 10), (2, 2)])
def test_hot_value_ties_and_narrowing(spark, monkeypatch, limit, accuracy):
    monkeypatch.setattr(selection, "BRACKET_VALUES", limit)
    monkeypatch.setattr(selection, "ACCURACY", accuracy)
    ints = [7] * 400 + list(range(800)) + [None] * 50
    doubles = [float("nan")] * 30 + [i / 3 for i in range(601)] + [None]
    rows = [(ints[i] if i < len(ints) else None, doubles[i] if i < len(doubles) else None) for i in range(1250)]
    assert middle(spark, rows, "a long, b double") == [brute([r[0] for r in rows]), brute([r[1] for r in rows])]


def test_nothing_to_rank(spark):
    assert middle(spark, [(None,), (None,)], "a int") == [(None, None)]
    assert middle(spark, [], "a int") == [(None, None)]
