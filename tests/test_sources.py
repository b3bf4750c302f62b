from decimal import Decimal
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabaudit import sources
from tabaudit.session import checkpoint_dir, cut_lineage, shuffle_partitions
from tabaudit.sources.storage import versions

SCHEMA = T.StructType(
    [
        T.StructField("id", T.IntegerType(), False),
        T.StructField("amount", T.DecimalType(10, 2), True),
        T.StructField("name", T.StringType(), True),
    ]
)


def write(path, text):
    path.write_text(text)
    return str(path)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_csv_columns_are_matched_by_name(spark, tmp_path):
    text = 'NAME,skipped,ID,AMOUNT\n"a, ""b""",z,1,2.50\n,z,2,\n"",z,3,1\n'
    df = sources.read_csv_typed(spark, write(tmp_path / "t.csv", text), SCHEMA)
    assert df.columns == ["id", "amount", "name"]
    assert [f.dataType for f in df.schema] == [f.dataType for f in SCHEMA]
    got = [(r[0], None if r[1] is None else str(r[1]), r[2]) for r in df.collect()]
    # Empty fields are NULL, quoted or not.
    assert got == [(1, "2.50", 'a, "b"'), (2, None, None), (3, "1.00", None)]


def test_csv_keeps_malformed_lines(spark, tmp_path):
    path = write(tmp_path / "t.csv", "id,amount,name\n1,2.5,x\nsoon,1,y\n")
    df = sources.read_csv_typed(spark, path, SCHEMA, corrupt_column="raw")
    assert [(r.id, r.raw) for r in df.collect()] == [(1, None), (None, "soon,1,y")]


def test_csv_with_a_missing_column_fails_early(spark, tmp_path):
    with pytest.raises(ValueError, match="amount, name"):
        sources.read_csv_typed(spark, write(tmp_path / "t.csv", "id\n1\n"), SCHEMA)


def test_csv_files_of_another_shape_fail(spark, tmp_path):
    write(tmp_path / "a.csv", "id,amount,name\n1,2.5,x\n")
    write(tmp_path / "b.csv", "id,name,amount\n1,x,2.5\n")
    with pytest.raises(Exception, match="(?i)header"):
        sources.read_csv_typed(spark, str(tmp_path), SCHEMA).collect()


def test_shuffle_partitions():
    assert [shuffle_partitions(n) for n in (0, 1, 128 << 20, (128 << 20) + 1)] == [1, 1, 1, 2]


def test_csv_scan_reads_the_scope_only(spark, tmp_path):
    path = write(tmp_path / "t.csv", "id,amount,name,x1,x2\n1,2.5,x,1,2\n")
    plan = sources.read_csv_typed(spark, path, SCHEMA)._jdf.queryExecution().executedPlan().toString()
    assert "x1" not in plan.split("ReadSchema")[1]


def test_contract(spark):
    df = spark.createDataFrame([(1, None), (1, "x"), (None, "y")], "id int, name string")
    schema = T.StructType(
        [
            T.StructField("id", T.IntegerType(), False),
            T.StructField("name", T.StringType(), False),
            T.StructField("gone", T.StringType(), True),
        ]
    )
    found = {r[:2]: r[2] for r in rows(sources.check_contract(df, schema, ["id"])) if r[2]}
    assert found == {
        ("missing_column", "gone"): 1,
        ("not_null", "id"): 1,
        ("not_null", "name"): 1,
        ("primary_key", "id"): 1,
    }
    relaxed = {r[:2]: r[2] for r in rows(sources.check_contract(df, schema, ["id"], relax=["name"])) if r[2]}
    assert ("not_null", "name") not in relaxed
    types = sources.check_contract(df.select(F.col("id").cast("bigint"), "name"), schema)
    assert ("type", "id", 1) in rows(types)


def test_replace_table_may_read_itself(spark, tmp_path):
    path = str(tmp_path / "orders")
    first = sources.replace_table(spark.createDataFrame([(1, "bad"), (2, "ok")], "id int, s string"), path)
    second = sources.replace_table(first.withColumn("s", F.nullif("s", F.lit("bad"))), path)
    assert sorted(rows(second)) == [(1, None), (2, "ok")]
    assert sorted(rows(sources.read_current(spark, path))) == sorted(rows(second))
    assert versions(spark, path) == [1, 2]


def test_an_unfinished_version_is_not_current(spark, tmp_path):
    path = tmp_path / "t"
    sources.replace_table(spark.range(3).toDF("id"), str(path))
    (path / "version=000002").mkdir()
    assert sources.read_current(spark, str(path)).count() == 3
    sources.replace_table(spark.range(5).toDF("id"), str(path))
    assert versions(spark, str(path)) == [1, 3]
    assert sources.read_current(spark, str(path)).count() == 5


def test_read_current_of_nothing(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        sources.read_current(spark, str(tmp_path / "none"))


def test_materialize_by_partition(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, k string")
    out = sources.materialize(df, str(tmp_path / "m"), partition_by=["k"])
    assert sorted(rows(out.select("id", "k"))) == [(1, "a"), (2, "b")]
    assert (tmp_path / "m" / "k=a").is_dir()


def test_materialize_as_a_table(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS marts LOCATION '{tmp_path}'")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, k string")
    for _ in range(2):
        out = sources.materialize(df, "marts.letters", as_table=True)
    assert sorted(rows(out)) == [(1, "a"), (2, "b")]


def test_materialize_temporary_uses_the_checkpoint_folder(spark):
    kept = sources.materialize_temporary(spark.range(4).toDF("id"), "four")
    assert spark.table("four").count() == 4
    assert "Range" not in kept._jdf.queryExecution().optimizedPlan().toString()  # the lineage is cut
    assert cut_lineage(spark.range(2)).count() == 2


def test_checkpoint_dir_prefers_the_session_setting(spark):
    before = spark.conf.get("spark.checkpoint.dir", None)
    assert checkpoint_dir(spark) == before or before is None


def test_preview_is_ordered(spark):
    df = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "id int, k string")
    assert rows(sources.preview(df, ["k"], 2, ["id"])) == [("a",), ("b",)]
    assert rows(sources.preview(df, ["k"], 2, ["id"], F.col("id") > 1)) == [("b",), ("c",)]
    assert sources.select_scope(df, ["k"]).columns == ["k"]


def test_two_writers_at_once_leave_two_whole_versions(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    path = str(tmp_path / "race")
    frames = [spark.range(n).toDF("id") for n in (100, 200)]
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda df: sources.replace_table(df, path), frames))
    assert versions(spark, path) == [1, 2]
    counts = sorted(spark.read.parquet(f"{path}/version={n:06d}").count() for n in (1, 2))
    assert counts == [100, 200]


def test_old_and_half_written_versions_go(spark, tmp_path):
    path = tmp_path / "kept"
    for n in range(1, 3):
        sources.replace_table(spark.range(n).toDF("id"), str(path), keep=2)
    (path / "version=000003").mkdir()
    (path / "version=000003" / "part-00000.parquet").write_bytes(b"half")
    for n in range(4, 7):
        sources.replace_table(spark.range(n).toDF("id"), str(path), keep=2)
    assert versions(spark, str(path), complete_only=False) == [5, 6]
    assert sources.read_current(spark, str(path)).count() == 6


def test_quarantine_keeps_rows_and_lists_bad_fields(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text("id,amount,note\n1,2.50,a\n2,abc,b\nx,3,c\n4,,d\n")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("amount", T.DecimalType(10, 2))])
    typed, bad = sources.read_csv_quarantined(spark, str(path), schema)
    assert sorted(map(tuple, typed.collect()), key=repr) == sorted(
        [(1, Decimal("2.50")), (2, None), (None, Decimal("3.00")), (4, None)], key=repr
    )
    assert sorted((r.column, r.raw) for r in bad.collect()) == [("amount", "abc"), ("id", "x")]
    assert sorted(map(tuple, sources.quarantine_counts(bad).collect())) == [("amount", 1), ("id", 1)]
