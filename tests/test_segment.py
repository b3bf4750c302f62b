from pyspark.sql import functions as F

from tabaudit.operators import segment


def loans(spark):
    rows = [
        ("cash", "F", 1, 0.10),
        ("cash", "M", 0, 0.20),
        ("cash", None, 0, 0.40),
        ("revolving", "F", 0, None),
        ("revolving", "F", None, 0.30),
    ]
    return spark.createDataFrame(rows, "kind string, gender string, target int, dti double")


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_rate_by_sorts_by_rate_and_skips_null_targets(spark):
    assert rows(segment.rate_by(loans(spark), "kind", "target")) == [("cash", 33.33, 3), ("revolving", 0.0, 2)]


def test_rate_by_keeps_null_groups_unless_filtered(spark):
    df = loans(spark)
    assert (None, 0.0, 1) in rows(segment.rate_by(df, ["gender"], "target"))
    known = rows(segment.rate_by(df, "gender", "target", F.col("gender").isNotNull()))
    assert {r[0] for r in known} == {"F", "M"}


def test_volumes_add_up(spark):
    df = loans(spark)
    assert sum(r[-1] for r in rows(segment.rate_by(df, ["kind", "gender"], "target"))) == df.count()


def test_rate_by_band_puts_null_into_the_last_band(spark):
    from tabaudit.functions import columns as C

    bands = {"dti_band": C.band("dti", [0.3], ["Low", "High"])}
    assert {r[0]: r[2] for r in rows(segment.rate_by_band(loans(spark), bands, "target"))} == {"Low": 2, "High": 3}


def test_ranges_and_means(spark):
    df = loans(spark)
    assert rows(segment.range_by(df, "kind", "dti")) == [("revolving", 0.3, 0.3, 0.3), ("cash", 0.1, 0.4, 0.2333)]
    assert rows(segment.mean_by(df, "target", "dti")) == [(None, 0.3, 1), (0, 0.3, 3), (1, 0.1, 1)]


def test_profiles(spark):
    df = loans(spark)
    metrics = {"rate": segment.rate_expr("target"), "n": F.count("*")}
    assert rows(segment.profile_metrics(df, [F.col("kind") == "cash", F.col("dti") < 0.3], metrics)) == [(50.0, 2)]
    nobody = rows(segment.profile_metrics(df, [F.col("kind") == "other"], metrics))
    assert nobody == [(None, 0)]
    rules = [(F.col("dti") > 0.25, "high")]
    assert rows(segment.compare_profiles(df, rules, "rest", metrics)) == [("high", 0.0, 2), ("rest", 33.33, 3)]


def test_top_k_needs_more_than_the_floor_and_a_name(spark):
    data = [("a", 1)] * 3 + [("b", 1)] * 2 + [("c", 0)] * 4 + [(None, 1)] * 9
    df = spark.createDataFrame(data, "dim string, target int")
    assert rows(segment.top_k_min_volume(df, "dim", "target", 2, 5)) == [("a", 100.0, 3), ("c", 0.0, 4)]
    assert rows(segment.top_k_min_volume(df, "dim", "target", 3, 5)) == [("c", 0.0, 4)]
    assert len(rows(segment.top_k_min_volume(df, "dim", "target", 1, 1))) == 1


def test_shares_sum_to_one_hundred(spark):
    df = spark.createDataFrame([(v,) for v in [1, 1, 2, 3, None]], "v int")
    out = rows(segment.share_distribution(df, "v"))
    assert sum(r[2] for r in out) == 100.0
    assert rows(segment.share_distribution(df, "v", where=F.col("v").isNotNull()))[0] == (1, 2, 50.0)


def test_headline_counts_unknown_outcomes_in_the_total_only(spark):
    df = spark.createDataFrame([(1,), (0,), (0,), (None,)], "late int")
    assert rows(segment.outcome_headline(df, "late")) == [(4, 1, 33.33, 2)]


def test_month_trend_ends_at_midnight(spark):
    inside = [("2018-08-31 00:00:00", 1), ("2018-08-01 10:00:00", 0)]
    data = [*inside, ("2018-08-31 00:00:01", 1), ("2016-12-31 23:59:59", 1)]
    df = spark.createDataFrame(data, "t string, late int").withColumn("t", F.col("t").cast("timestamp_ntz"))
    assert rows(segment.monthly_trend(df, "t", "late", "2017-01-01", "2018-08-31")) == [("2018-08", 2, 50.0)]


def test_tiers_share_and_top(spark):
    data = [("a", 60, 100, 0.1), ("b", 10, 50, 0.3), ("c", 9, 900, 0.9), ("d", 49, 50, None)]
    df = spark.createDataFrame(data, "seller string, orders int, revenue int, late double")
    enough = F.col("orders") >= 10
    out = segment.tier_compare(df, "orders", [50], ["small", "big"], {"late": segment.mean_expr("late")}, enough)
    assert rows(out) == [("small", 2, 0.3), ("big", 1, 0.1)]
    top = segment.top_entities(df, "seller", "revenue", 2, enough).select("seller")
    assert rows(top) == [("a",), ("b",)]
    assert rows(segment.share_of_total(df, "revenue", enough & (F.col("late") > 0.2))) == [(50, 1, 4.55)]


def test_monthly_trend_pruned_equals_the_plain_form(spark, tmp_path):
    from tabaudit.operators import segment as S
    from tabaudit.sources import materialize

    rows = [(f"1997-{m:02d}-{d:02d} 10:00:00", (m + d) % 3 == 0) for m in range(1, 13) for d in (1, 15, 28)]
    df = spark.createDataFrame(rows, "t string, late boolean").select(
        F.col("t").cast("timestamp_ntz").alias("t"), F.col("late").cast("int").alias("late")
    )
    stored = materialize(df.withColumn("month", S.month_of("t")), str(tmp_path / "m"), partition_by=["month"])
    plain = S.monthly_trend(df, "t", "late", "1997-02-15", "1997-11-01", None, None)
    pruned = S.monthly_trend_pruned(stored, "t", "late", "1997-02-15", "1997-11-01", None, None)
    assert [tuple(r) for r in pruned.collect()] == [tuple(r) for r in plain.collect()]
