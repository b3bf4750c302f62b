from pyspark.sql import functions as F

from tabaudit.operators import integrity, profile


def one(df):
    return df.collect()[0].asDict()


def events(spark):
    rows = [(1, "a", 1.0), (2, "", None), (3, None, 4.0), (3, "a", 4.0)]
    return spark.createDataFrame(rows, "id int, kind string, x double")


def test_counts_of_missing_values(spark):
    df = events(spark)
    assert one(profile.null_audit(df, ["kind", "x"])) == {"null_kind": 1, "null_x": 1}
    assert one(profile.blank_audit(df, ["kind"])) == {"blank_kind": 1}
    assert one(profile.blank_audit(df, ["kind"], null_is_blank=True)) == {"blank_kind": 2}
    fused = one(profile.audit(df, nulls=["x"], blanks=["kind"], counts={"big": F.col("x") > 3}))
    assert fused == {"records": 4, "null_x": 1, "blank_kind": 1, "big": 2}


def test_numeric_profile_rounds_per_column(spark):
    out = one(profile.numeric_profile(events(spark), {"x": 1, "id": None}))
    assert (out["min_x"], out["max_x"], out["avg_x"], out["null_x"]) == (1.0, 4.0, 3.0, 1)
    assert out["avg_id"] == 2.25


def test_distributions_keep_null_as_a_value(spark):
    df = events(spark)
    assert {r[0] for r in profile.distinct_values(df, "kind").collect()} == {"a", "", None}
    assert profile.value_distribution(df, "kind").collect()[0].asDict() == {"kind": "a", "records": 2}
    long = {tuple(r) for r in profile.value_distributions(df, ["kind", "id"]).collect()}
    assert ("kind", None, 1) in long and ("id", "3", 2) in long


def test_format_conformance(spark):
    rows = [("2018-01-31 23:59:59",), ("2018-1-3 00:00:00",), ("",), (None,), ("2018-01-31 24:00:00",)]
    df = spark.createDataFrame(rows, "t string")
    assert one(profile.format_conformance(df, ["t"])) == {"conforming_t": 1, "malformed_t": 3}


def test_structural_nulls_are_checked_row_by_row(spark):
    rows = [("N", None), ("Y", None), ("N", 3), ("Y", 4), (None, 5)]
    df = spark.createDataFrame(rows, "own string, age int")
    out = one(profile.structural_null_check(df, "age", F.col("own") == "N"))
    # The totals agree (2 and 2) although two rows contradict the rule.
    assert out == {
        "null_rows": 2,
        "condition_rows": 2,
        "null_and_condition": 1,
        "null_without_condition": 1,
        "value_despite_condition": 1,
    }


def test_duplicates(spark):
    df = events(spark)
    assert [tuple(r) for r in profile.duplicate_keys(df, "id").collect()] == [(3, 2)]
    assert one(profile.duplicate_key_count(df, "id")) == {"duplicated_keys": 1, "surplus_rows": 1}
    assert one(profile.duplicate_key_count(df, ["id", "kind"])) == {"duplicated_keys": 0, "surplus_rows": 0}


def test_mean_of_group_totals(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 5)], "k string, v int")
    assert one(profile.mean_of_group_totals(df, "k", "v")) == {"mean_total": 4.0}


def test_change_audit_resolves_predicates_per_frame(spark):
    df = events(spark)
    after = df.withColumn("kind", F.nullif("kind", F.lit("")))
    out = profile.change_audit(df, after, {"blank": F.col("kind") == "", "null": F.col("kind").isNull()})
    assert {tuple(r) for r in out.collect()} == {("before", 1, 1), ("after", 0, 2)}


def test_referential_matches_counts_orphans_and_fan_out(spark):
    child = spark.createDataFrame([(1,), (1,), (2,), (9,), (None,)], "k int")
    parent = spark.createDataFrame([(1,), (2,), (2,), (3,)], "k int")
    out = one(integrity.referential_matches(child, parent, "k"))
    joined = child.join(parent, "k").count()
    assert out == {"relation": "k_to_k", "child_rows": 5, "matched_rows": joined, "orphan_rows": 2}


def test_referential_matches_of_nothing(spark):
    empty = spark.createDataFrame([], "k int")
    out = one(integrity.referential_matches(empty, empty, "k"))
    assert (out["child_rows"], out["matched_rows"], out["orphan_rows"]) == (0, 0, 0)


def test_reconcile_total(spark):
    left = spark.createDataFrame([(1,), (2,)], "v int")
    right = spark.createDataFrame([(5,)], "w int")
    out = one(integrity.reconcile_total(left, right, F.sum("v"), F.sum("w")))
    assert out == {"left_total": 3, "right_total": 5, "difference": -2}


def test_missing_after_join_equals_the_plain_join(spark):
    left = spark.createDataFrame([(1, None), (1, 5), (2, None), (3, None)], "k int, v int")
    right = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    plain = left.join(right, "k").filter("v IS NULL").count()
    assert one(integrity.missing_after_join(left, right, "k", "v")) == {"missing_rows": plain} == {"missing_rows": 3}


def test_audited_write_counts_what_the_two_pass_audit_counts(spark, tmp_path):
    from tabaudit.operators import profile as P

    df = spark.createDataFrame([(1, "x"), (2, "n/a"), (3, None), (4, "n/a")], "id int, s string")
    predicates = {"marked": F.col("s") == "n/a", "missing": F.col("s").isNull()}

    def correct(frame):
        return frame.withColumn("s", F.nullif("s", F.lit("n/a")))

    written, audit = P.audited_write(df, correct, str(tmp_path / "w"), predicates)
    expected = P.change_audit(df, correct(df), predicates)
    assert sorted(map(tuple, audit.collect())) == sorted(map(tuple, expected.collect()))
    assert sorted(map(tuple, written.collect())) == [(1, "x"), (2, None), (3, None), (4, None)]


def test_prefiltered_duplicate_keys_equal_the_plain_form(spark):
    rows = [(i % 50, None if i % 7 == 0 else f"k{i % 3}") for i in range(400)] + [(1000, "once"), (None, None), (None, None)]
    df = spark.createDataFrame(rows, "a int, b string")
    plain = sorted(map(tuple, profile.duplicate_keys(df, ["a", "b"]).collect()), key=repr)
    pre = sorted(map(tuple, profile.duplicate_keys_prefiltered(df, ["a", "b"]).collect()), key=repr)
    assert pre == plain and (None, None, 2) in pre
