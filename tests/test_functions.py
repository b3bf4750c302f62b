import pytest
from pyspark.sql import functions as F

from tabaudit.functions import columns as C
from tabaudit.operators import derive, skew


def values(df, col):
    return [r[col] for r in df.orderBy("id").collect()]


def frame(spark, rows, kind):
    return spark.createDataFrame(list(enumerate(rows)), f"id int, x {kind}")


def test_band_is_half_open_and_null_falls_to_the_last_label(spark):
    df = frame(spark, [9, 10, 19, 20, None], "int")
    out = derive.band(df, "x", [10, 20], ["low", "mid", "high"], "b")
    assert values(out, "b") == ["low", "mid", "mid", "high", "high"]


def test_band_rejects_wrong_labels():
    with pytest.raises(ValueError):
        C.band("x", [1, 2], ["a", "b"])
    with pytest.raises(ValueError):
        C.band("x", [2, 1], ["a", "b", "c"])


def test_band_closed_has_no_else(spark):
    df = frame(spark, [-15, -14, -1, 0, 7, 8, None], "int")
    ranges = [(None, -15, "very early"), (-14, -1, "early"), (0, 0, "on time"), (1, 7, "late")]
    out = derive.band_closed(df, "x", ranges, "b")
    assert values(out, "b") == ["very early", "early", "early", "on time", "late", None, None]


def test_code_to_label_default_takes_null(spark):
    df = frame(spark, [1, 2, 3, None], "int")
    out = derive.code_to_label(df, "x", {1: "Low", 2: "Medium"}, "High", "l")
    assert values(out, "l") == ["Low", "Medium", "High", "High"]


def test_flags(spark):
    df = frame(spark, [10, 11, None], "int").select(
        "id",
        C.threshold_flag("x", 10).alias("t"),
        C.null_flag("x").alias("n"),
        C.value_flag("x", 11).alias("v"),
    )
    assert [tuple(r)[1:] for r in df.orderBy("id").collect()] == [(0, 0, 0), (1, 0, 1), (0, 1, 0)]


def test_days_to_years_rounds_half_up_and_drops_the_sentinel(spark):
    df = frame(spark, [-10957, -365, 365243, 0], "int")
    out = derive.days_to_years(df, "x", "y", F.col("x") == 365243)
    assert [None if v is None else str(v) for v in values(out, "y")] == ["30.0", "1.0", None, "0.0"]
    assert out.schema["y"].dataType.simpleString() == "decimal(5,1)"


def test_guarded_ratio(spark):
    rows = [(0, "1.00", "3.00"), (1, "1.00", "0.00"), (2, None, "2.00"), (3, "1.00", "8.00"), (4, "900.00", "1.00")]
    df = spark.createDataFrame(rows, "id int, a string, b string")
    df = df.select("id", F.col("a").cast("decimal(10,2)").alias("a"), F.col("b").cast("decimal(10,2)").alias("b"))
    plain = values(derive.guarded_ratio(df, "a", "b", "r"), "r")
    assert [None if v is None else str(v) for v in plain] == ["0.3333", None, None, "0.1250", "900.0000"]
    with pytest.raises(Exception, match="does not fit"):
        derive.guarded_ratio(df, "a", "b", "r", precision=6).collect()
    ruled = values(derive.guarded_ratio(df, "a", "b", "r", null_when=F.col("b") == 8), "r")
    assert ruled[3] is None and ruled[0] is not None


def test_guarded_ratio_keeps_rows_whose_rule_is_unknown(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0, None)], "id int, a double, b double, kind string")
    out = derive.guarded_ratio(df, "a", "b", "r", scale=None, null_when=F.col("kind") == "x")
    assert values(out, "r") == [0.5]


def test_late_flag_compares_times_and_variance_compares_dates(spark):
    rows = [
        (0, "2018-01-10 15:00:00", "2018-01-10 00:00:00"),
        (1, "2018-01-10 00:00:00", "2018-01-10 00:00:00"),
        (2, None, "2018-01-10 00:00:00"),
        (3, "2018-01-08 23:59:59", "2018-01-10 00:00:00"),
        (4, "2018-01-08 23:59:59", None),
    ]
    df = derive.to_timestamps(spark.createDataFrame(rows, "id int, a string, p string"), ["a", "p"])
    out = derive.day_variance(derive.outcome_flag(df, "a", "p", "late"), "a", "p", "days")
    assert values(out, "late") == [1, 0, None, 0, 0]
    assert values(out, "days") == [0, 0, None, -2, None]


def test_to_timestamps_turns_bad_text_into_null(spark):
    df = frame(spark, ["2018-01-10 15:00:00", "", "soon", None], "string")
    out = derive.to_timestamps(df, ["x"])
    assert [v is None for v in values(out, "x")] == [False, True, True, True]
    assert out.schema["x"].dataType.simpleString() == "timestamp_ntz"


def test_classify_takes_the_first_rule(spark):
    df = frame(spark, [5, 50, None], "int")
    rules = [(F.col("x") > 1, "some"), (F.col("x") > 10, "many")]
    assert values(derive.classify(df, rules, "none", "c"), "c") == ["some", "some", "none"]


@pytest.mark.parametrize("spread_hot", [False, True])
def test_translate_lookup(spark, spread_hot, monkeypatch):
    monkeypatch.setattr(skew, "ROWS_PER_TASK", 1)
    df = frame(spark, ["a", "b", "c", None, "d"] * 3, "string")
    lookup = spark.createDataFrame([("a", "Apple"), ("b", "Pear")], "x string, label string")
    out = derive.translate_lookup(df, lookup, "x", "label", "label", {"b": "PEAR", "d": "Date"}, spread_hot=spread_hot)
    assert values(out, "label") == ["Apple", "PEAR", None, None, "Date"] * 3
