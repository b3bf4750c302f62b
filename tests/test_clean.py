import random
from decimal import Decimal
from statistics import median

import pytest

from tabaudit.operators import clean


def column(spark, values, kind="double"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def exact(spark, values, kind="double", scale=None):
    return clean.exact_median(column(spark, values, kind), "x", scale).collect()[0][0]


@pytest.mark.parametrize(
    "values",
    [
        [3.0],
        [1.0, 2.0],
        [5.0, 1.0, 3.0],
        [7.0] * 50 + [1.0] * 49,
        [7.0] * 50 + [1.0] * 50,
        [-5.0, -1.0, 0.0, 1e300, -1e300],
        [1e-12, 2e-12, 3e-12, 4e-12],
        [0.1 + i * 1e-15 for i in range(8)],
        [i * 1e-12 for i in range(1001)],
        [5e-324, 1e-310, 2.2250738585072014e-308, 0.0, -5e-324],
        [2.0**e for e in range(-1022, 1024, 31)],
        [-(2.0**e) * (1 - 2.0**-53) for e in range(-1000, 1000, 37)],
        [float("inf"), 1.0, 2.0, float("-inf")],
    ],
)
def test_median_of_awkward_values(spark, values):
    assert exact(spark, values) == median(values)


def test_median_of_random_values(spark):
    rng = random.Random(7)
    for n in (999, 1000):
        values = [rng.choice([rng.gauss(0, 1), rng.expovariate(1e-6), round(rng.random(), 2), 0.0]) for _ in range(n)]
        assert exact(spark, values) == median(values)


def test_median_ignores_null_and_nan(spark):
    assert exact(spark, [1.0, None, float("nan"), 2.0, 9.0]) == 2.0
    assert exact(spark, [None, None]) is None


def test_median_of_other_types(spark):
    assert exact(spark, [1, 2, 10], "int") == 2.0
    assert exact(spark, [2**53 + 1, 2**53 + 3, 2**53 + 5], "bigint") == float(2**53 + 3)
    money = [Decimal("24903.0001"), Decimal("24903.0004"), Decimal("1.0000"), Decimal("90000.0000")]
    assert exact(spark, money, "decimal(15,4)", 4) == Decimal("24903.0003")


def test_medians_of_several_columns_at_once(spark):
    rows = [(float(i), i * 3, Decimal(i) / 4) for i in range(101)] + [(None, None, Decimal(-1))]
    df = spark.createDataFrame(rows, "x double, n bigint, d decimal(15,4)")
    got = clean.exact_medians(df, {"x": None, "n": None, "d": 2}).collect()[0]
    assert (got.x, got.n, got.d) == (50.0, 150.0, Decimal("12.38"))


def test_median_does_not_depend_on_partitions_or_order(spark):
    values = [float(i % 97) for i in range(1000)]
    df = column(spark, values)
    expected = median(values)
    for parts in (1, 7):
        shuffled = df.repartition(parts)
        assert clean.exact_median(shuffled, "x").collect()[0][0] == expected


def test_impute_median_keeps_the_type(spark):
    df = column(spark, [Decimal("1.0000"), None, Decimal("4.0000")], "decimal(15,4)")
    out = clean.impute_median(df, "x", 1)
    assert out.schema == df.schema
    assert sorted(r[0] for r in out.collect()) == [Decimal("1.0000"), Decimal("2.5000"), Decimal("4.0000")]


def test_sentinels_and_blanks(spark):
    df = spark.createDataFrame([(1, "XNA", 0), (2, "", 5), (3, None, None)], "id int, t string, n int")
    out = clean.blank_to_null(clean.sentinel_to_null(df, {"t": ["XNA"], "n": [0]}), ["t"])
    assert [tuple(r) for r in out.orderBy("id").collect()] == [(1, None, None), (2, None, 5), (3, None, None)]
    again = clean.blank_to_null(clean.sentinel_to_null(out, {"t": ["XNA"], "n": [0]}), ["t"])
    assert again.collect() == out.collect()


def test_constants_and_labels(spark):
    df = spark.createDataFrame([(1, None, None), (2, 3, "x")], "id int, n int, t string")
    out = clean.reclassify_null(clean.impute_constant(df, {"n": 1}), "t", "Unknown")
    assert [tuple(r) for r in out.orderBy("id").collect()] == [(1, 1, "Unknown"), (2, 3, "x")]
    assert out.schema["n"].dataType == df.schema["n"].dataType


def test_dedupe_latest(spark):
    rows = [
        ("a", 5, "2018-01-01"),
        ("a", 1, "2018-02-01"),
        ("a", 4, "2018-02-01"),
        ("b", 2, None),
        ("b", 1, "2017-01-01"),
        ("c", 3, "2018-01-01"),
        ("c", 3, "2018-01-01"),
    ]
    df = spark.createDataFrame(rows, "k string, score int, day string")
    out = clean.dedupe_latest(df, "k", ["day", "score"])
    assert out.columns == df.columns
    want = [("a", 4, "2018-02-01"), ("b", 1, "2017-01-01"), ("c", 3, "2018-01-01")]
    assert sorted(tuple(r) for r in out.collect()) == want
    assert sorted(clean.dedupe_latest(df.repartition(5), "k", ["day", "score"]).collect()) == sorted(out.collect())


def test_narrowing(spark):
    df = column(spark, [Decimal("1.0"), Decimal("2.5"), Decimal("300.0"), None], "decimal(5,1)")
    losses = clean.narrowing_losses(df, "x", "tinyint").collect()[0]
    assert (losses.checked, losses.losses) == (3, 2)
    for bad in ("2.5", "300.0"):
        with pytest.raises(Exception, match="does not fit tinyint"):
            clean.narrow_type(df.filter(f"x = {bad}"), "x", "tinyint").collect()
    fits = clean.narrow_type(df.filter("x = 1 OR x IS NULL"), "x", "tinyint")
    assert sorted(r[0] or 0 for r in fits.collect()) == [0, 1]


def test_dedupe_latest_limited_keeps_the_newest_row_and_maps(spark):
    from tabaudit.operators import clean as K

    rows = [(1, 3, "a", {"x": 1}), (1, 5, "b", {"y": 2}), (1, None, "z", {}), (2, 1, "c", None)]
    rows += [(3, i % 7, f"v{i}", {"i": i}) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, t int, s string, m map<string,int>").repartition(4)
    got = {r.k: (r.t, r.s, r.m) for r in K.dedupe_latest_limited(df, "k", ["t"]).collect()}
    assert got[1] == (5, "b", {"y": 2}) and got[2] == (1, "c", None)
    assert got[3][0] == 6 and got[3][1] == max(f"v{i}" for i in range(500) if i % 7 == 6)
