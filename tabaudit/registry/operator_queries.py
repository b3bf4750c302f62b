"""One query per operator, over the whole given tables.

Rates and means stay unrounded here, because the engines round doubles differently; sums of money go through
decimals, because sums of doubles depend on their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabaudit.functions import columns as C
from tabaudit.functions.columns import mean, percent
from tabaudit.operators import clean, derive, integrity, marts, profile, segment, skew
from tabaudit.operators.star import Link
from tabaudit.registry.core import TABLES, Given, duck, query
from tabaudit.registry.shared import mean_sql, plain, rate_sql, shared_path
from tabaudit.registry.standins import aged_orders, deliveries, gappy_events
from tabaudit.session import cut_lineage
from tabaudit.sources import (
    bucket_count,
    check_contract,
    materialize,
    materialize_temporary,
    preview,
    quarantine_counts,
    read_csv_quarantined,
    read_csv_typed,
    replace_table,
    select_scope,
)

NOT_SPECIFIED = "4-NOT SPECIFIED"


def _money(col: str):
    return F.col(col).cast("decimal(18,2)")


def _money_sum(col: str):
    return F.sum(_money(col)).cast("double")


def _returned(t: Given) -> DataFrame:
    flag = (F.col("l_returnflag") == "R").cast("int")
    return t.lineitem.withColumn("returned", flag)


def _with_gap(t: Given) -> DataFrame:
    """Orders whose unspecified priority is NULL."""
    return clean.sentinel_to_null(t.orders, {"o_orderpriority": [NOT_SPECIFIED]})


# --- sources, sinks, contracts -------------------------------------------------------------------


@query(
    "read_csv_typed",
    """SELECT o_orderkey, CAST(o_custkey AS INTEGER) AS o_custkey, o_orderstatus,
              CAST(CAST(o_totalprice AS DECIMAL(15,4)) AS DOUBLE) AS o_totalprice,
              CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE o_orderpriority END AS o_orderpriority
       FROM orders""",
)
def _read_csv_typed(t: Given) -> DataFrame:
    folder = shared_path(t.spark, "orders-csv")
    _with_gap(t).write.option("header", True).csv(folder)
    schema = T.StructType(
        [
            T.StructField("O_ORDERKEY", T.LongType(), False),
            T.StructField("o_custkey", T.IntegerType(), False),
            T.StructField("o_orderstatus", T.StringType(), False),
            T.StructField("o_totalprice", T.DecimalType(15, 4), False),
            T.StructField("o_orderpriority", T.StringType(), True),
        ]
    )
    return plain(read_csv_typed(t.spark, folder, schema)).withColumnRenamed("O_ORDERKEY", "o_orderkey")


@query("select_scope", "SELECT o_orderkey AS order_id, o_orderstatus AS status, o_totalprice AS price FROM orders")
def _select_scope(t: Given) -> DataFrame:
    return select_scope(
        t.orders, {"o_orderkey": "order_id", "o_orderstatus": "status", "o_totalprice": "price"}
    )


@query(
    "check_contract",
    """SELECT 'missing_column' AS check_name, 'l_orderkey' AS column_name, CAST(0 AS BIGINT) AS violations
       UNION ALL SELECT 'type', 'l_orderkey', 0
       UNION ALL SELECT 'missing_column', 'l_linenumber', 0
       UNION ALL SELECT 'type', 'l_linenumber', 1
       UNION ALL SELECT 'missing_column', 'l_discount', 0
       UNION ALL SELECT 'type', 'l_discount', 0
       UNION ALL SELECT 'missing_column', 'l_tax', 0
       UNION ALL SELECT 'type', 'l_tax', 0
       UNION ALL SELECT 'missing_column', 'l_comment', 1
       UNION ALL SELECT 'not_null', 'l_orderkey', count(*) FILTER (WHERE l_orderkey IS NULL) FROM lineitem
       UNION ALL SELECT 'not_null', 'l_linenumber', count(*) FILTER (WHERE l_linenumber IS NULL) FROM lineitem
       UNION ALL SELECT 'not_null', 'l_discount', count(*) FILTER (WHERE l_discount = 0) FROM lineitem
       UNION ALL SELECT 'primary_key', 'l_orderkey,l_linenumber',
                        count(*) - count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem""",
)
def _check_contract(t: Given) -> DataFrame:
    schema = T.StructType(
        [
            T.StructField("l_orderkey", T.LongType(), False),
            T.StructField("l_linenumber", T.ByteType(), False),
            T.StructField("l_discount", T.DoubleType(), False),
            T.StructField("l_tax", T.DoubleType(), False),
            T.StructField("l_comment", T.StringType(), True),
        ]
    )
    gaps = clean.sentinel_to_null(t.lineitem, {"l_discount": [0], "l_tax": [0]})
    return check_contract(gaps, schema, ("l_orderkey", "l_linenumber"), relax=("l_tax",))


@query("materialize", "SELECT l_suppkey, count(*) AS items FROM lineitem GROUP BY l_suppkey")
def _materialize(t: Given) -> DataFrame:
    volumes = t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("items"))
    return materialize(volumes, shared_path(t.spark, "supplier-volume"))


@query(
    "bucketed_join",
    """SELECT o_orderstatus, count(*) AS items, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS revenue
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderstatus""",
)
def _bucketed_join(t: Given) -> DataFrame:
    # Both sides are stored once, bucketed alike on the order key; the join then reads bucket i of each in task i.
    count = max(bucket_count(t.lineitem), bucket_count(t.orders))
    items = materialize(
        t.lineitem.select("l_orderkey", "l_extendedprice"), "tabaudit_items_by_order", buckets=(count, ["l_orderkey"]),
        location=shared_path(t.spark, "items-by-order"),
    )
    orders = materialize(
        t.orders.select("o_orderkey", "o_orderstatus"), "tabaudit_orders_by_key", buckets=(count, ["o_orderkey"]),
        location=shared_path(t.spark, "orders-by-key"),
    )
    joined = items.join(orders, items["l_orderkey"] == orders["o_orderkey"])
    revenue = F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("revenue")
    return joined.groupBy("o_orderstatus").agg(F.count("*").alias("items"), revenue)


@query("materialize_temporary", "SELECT l_returnflag, count(*) AS items FROM lineitem GROUP BY l_returnflag")
def _materialize_temporary(t: Given) -> DataFrame:
    volumes = t.lineitem.groupBy("l_returnflag").agg(F.count("*").alias("items"))
    materialize_temporary(volumes, "tabaudit_flag_volume")
    return t.spark.table("tabaudit_flag_volume")


@query(
    "replace_table",
    """SELECT o_orderkey, o_custkey,
              CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE o_orderpriority END AS o_orderpriority
       FROM orders""",
)
def _replace_table(t: Given) -> DataFrame:
    path = shared_path(t.spark, "orders")
    landed = replace_table(t.orders.select("o_orderkey", "o_custkey", "o_orderpriority"), path)
    return replace_table(clean.sentinel_to_null(landed, {"o_orderpriority": [NOT_SPECIFIED]}), path)


@query(
    "preview",
    """SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'
       ORDER BY o_totalprice DESC, o_orderkey LIMIT 10""",
)
def _preview(t: Given) -> DataFrame:
    order = [F.desc("o_totalprice"), F.asc("o_orderkey")]
    return preview(t.orders, ["o_orderkey", "o_totalprice"], 10, order, F.col("o_orderstatus") == "F")


# --- profiling and audit -------------------------------------------------------------------------


@query("row_count", "SELECT count(*) AS records FROM lineitem")
def _row_count(t: Given) -> DataFrame:
    return profile.row_count(t.lineitem)


@query(
    "row_counts",
    " UNION ALL ".join(f"SELECT '{name}' AS table_name, count(*) AS records FROM {name}" for name in TABLES),
)
def _row_counts(t: Given) -> DataFrame:
    return profile.row_counts({name: getattr(t, name) for name in TABLES})


@query(
    "null_audit",
    """SELECT count(*) FILTER (WHERE o_orderpriority = '4-NOT SPECIFIED') AS null_o_orderpriority,
              count(*) FILTER (WHERE o_totalprice IS NULL) AS null_o_totalprice,
              count(*) FILTER (WHERE o_orderstatus IS NULL) AS null_o_orderstatus FROM orders""",
)
def _null_audit(t: Given) -> DataFrame:
    return profile.null_audit(_with_gap(t), ["o_orderpriority", "o_totalprice", "o_orderstatus"])


@query(
    "blank_audit",
    f"""WITH e AS ({duck(gappy_events)})
        SELECT count(*) FILTER (WHERE event_type = '') AS blank_event_type,
               count(*) FILTER (WHERE ts_text = '') AS blank_ts_text FROM e""",
)
def _blank_audit(t: Given) -> DataFrame:
    return profile.blank_audit(t.derive(gappy_events), ["event_type", "ts_text"])


@query(
    "blank_audit_null_is_blank",
    f"""WITH e AS ({duck(gappy_events)})
        SELECT count(*) FILTER (WHERE event_type = '' OR event_type IS NULL) AS blank_event_type,
               count(*) FILTER (WHERE ts_text = '' OR ts_text IS NULL) AS blank_ts_text FROM e""",
)
def _blank_audit_null_is_blank(t: Given) -> DataFrame:
    """As a CSV reader would see the text: NULL counts as blank."""
    return profile.blank_audit(t.derive(gappy_events), ["event_type", "ts_text"], null_is_blank=True)


@query(
    "csv_quarantine",
    """SELECT 'o_totalprice' AS column, count(*) AS bad_fields FROM orders WHERE o_orderkey % 97 = 0
       UNION ALL SELECT 'o_custkey', count(*) FROM orders WHERE o_orderkey % 89 = 0""",
)
def _csv_quarantine(t: Given) -> DataFrame:
    """Orders as CSV with text planted in two numeric columns, read back with a quarantine."""
    folder = shared_path(t.spark, "orders-bad-csv")
    key = F.col("o_orderkey")
    planted = t.orders.select(
        key,
        F.when(key % 89 == 0, F.lit("x")).otherwise(F.col("o_custkey").cast("string")).alias("o_custkey"),
        F.when(key % 97 == 0, F.lit("n/a")).otherwise(F.col("o_totalprice").cast("string")).alias("o_totalprice"),
    )
    planted.write.option("header", True).csv(folder)
    schema = T.StructType(
        [
            T.StructField("o_orderkey", T.LongType()),
            T.StructField("o_custkey", T.IntegerType()),
            T.StructField("o_totalprice", T.DecimalType(15, 2)),
        ]
    )
    _, quarantine = read_csv_quarantined(t.spark, folder, schema)
    return quarantine_counts(quarantine)


@query(
    "count_where",
    """SELECT count(*) FILTER (WHERE l_discount = 0) AS no_discount,
              count(*) FILTER (WHERE l_quantity > 45) AS bulk,
              count(*) FILTER (WHERE l_returnflag = 'R' AND l_tax = 0) AS untaxed_returns FROM lineitem""",
)
def _count_where(t: Given) -> DataFrame:
    return profile.count_where(
        t.lineitem,
        {
            "no_discount": F.col("l_discount") == 0,
            "bulk": F.col("l_quantity") > 45,
            "untaxed_returns": (F.col("l_returnflag") == "R") & (F.col("l_tax") == 0),
        },
    )


@query(
    "distinct_values",
    """SELECT DISTINCT CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE o_orderpriority END
              AS o_orderpriority FROM orders""",
)
def _distinct_values(t: Given) -> DataFrame:
    return profile.distinct_values(_with_gap(t), "o_orderpriority")


@query(
    "distinct_values_of",
    """SELECT DISTINCT 'p_brand' AS column_name, p_brand AS value FROM part
       UNION ALL SELECT DISTINCT 'p_type', p_type FROM part
       UNION ALL SELECT DISTINCT 'p_size', CAST(p_size AS VARCHAR) FROM part""",
)
def _distinct_values_of(t: Given) -> DataFrame:
    return profile.distinct_values_of(t.part, ["p_brand", "p_type", "p_size"])


@query("value_distribution", "SELECT event_type, count(*) AS records FROM events GROUP BY event_type")
def _value_distribution(t: Given) -> DataFrame:
    return profile.value_distribution(t.events, "event_type")


@query(
    "value_distributions",
    """SELECT 'lang' AS column_name, lang AS value, count(*) AS records FROM documents GROUP BY lang
       UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source""",
)
def _value_distributions(t: Given) -> DataFrame:
    return profile.value_distributions(t.documents, ["lang", "source"])


@query(
    "numeric_profile",
    f"""SELECT min(o_totalprice) AS min_o_totalprice, max(o_totalprice) AS max_o_totalprice,
               {mean_sql("CAST(o_totalprice AS DECIMAL(18,2))", "avg_o_totalprice")},
               count(*) FILTER (WHERE o_totalprice IS NULL) AS null_o_totalprice,
               min(o_custkey) AS min_o_custkey, max(o_custkey) AS max_o_custkey,
               {mean_sql("o_custkey", "avg_o_custkey")},
               count(*) FILTER (WHERE o_custkey IS NULL) AS null_o_custkey
        FROM orders""",
)
def _numeric_profile(t: Given) -> DataFrame:
    # Whole cents, so that the mean does not depend on the order of summation.
    cents = t.orders.withColumn("o_totalprice", _money("o_totalprice"))
    return plain(profile.numeric_profile(cents, ["o_totalprice", "o_custkey"], None))


@query(
    "baseline_metrics",
    f"""SELECT {rate_sql("CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END", "return_rate")},
               {mean_sql("l_quantity", "avg_quantity")},
               CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total_price FROM lineitem""",
)
def _baseline_metrics(t: Given) -> DataFrame:
    return profile.baseline_metrics(
        _returned(t),
        {
            "return_rate": segment.rate_expr("returned", None),
            "avg_quantity": segment.mean_expr("l_quantity", None),
            "total_price": _money_sum("l_extendedprice"),
        },
    )


@query(
    "audit",
    f"""WITH e AS ({duck(gappy_events)})
        SELECT count(*) AS records, count(*) FILTER (WHERE user_id IS NULL) AS null_user_id,
               count(*) FILTER (WHERE event_type = '') AS blank_event_type,
               count(*) FILTER (WHERE value > 300) AS high_value,
               CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total_value FROM e""",
)
def _audit(t: Given) -> DataFrame:
    return profile.audit(
        t.derive(gappy_events),
        nulls=["user_id"],
        blanks=["event_type"],
        counts={"high_value": F.col("value") > 300},
        metrics={"total_value": _money_sum("value")},
    )


@query(
    "mean_of_group_totals",
    f"""SELECT {mean_sql("s", "mean_total")} FROM
        (SELECT sum(CAST(o_totalprice AS DECIMAL(18,2))) AS s FROM orders GROUP BY o_custkey)""",
)
def _mean_of_group_totals(t: Given) -> DataFrame:
    priced = t.orders.withColumn("price", _money("o_totalprice"))
    return profile.mean_of_group_totals(priced, "o_custkey", "price", None)


@query(
    "format_conformance",
    f"""WITH e AS ({duck(gappy_events)})
        SELECT count(*) FILTER (WHERE ts_text NOT IN ('', 'unknown')) AS conforming_ts_text,
               count(*) FILTER (WHERE ts_text IN ('', 'unknown')) AS malformed_ts_text FROM e""",
)
def _format_conformance(t: Given) -> DataFrame:
    return profile.format_conformance(t.derive(gappy_events), ["ts_text"])


@query(
    "structural_null_check",
    f"""WITH d AS ({duck(deliveries)})
        SELECT count(*) FILTER (WHERE actual IS NULL) AS null_rows,
               count(*) FILTER (WHERE o_orderstatus <> 'F') AS condition_rows,
               count(*) FILTER (WHERE actual IS NULL AND o_orderstatus <> 'F') AS null_and_condition,
               count(*) FILTER (WHERE actual IS NULL AND o_orderstatus = 'F') AS null_without_condition,
               count(*) FILTER (WHERE actual IS NOT NULL AND o_orderstatus <> 'F') AS value_despite_condition
        FROM d""",
)
def _structural_null_check(t: Given) -> DataFrame:
    return profile.structural_null_check(t.derive(deliveries), "actual", F.col("o_orderstatus") != "F")


@query(
    "duplicate_keys",
    """SELECT l_orderkey, l_linenumber, count(*) AS duplicates FROM lineitem
       GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""",
)
def _duplicate_keys(t: Given) -> DataFrame:
    return profile.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query(
    "duplicate_keys_prefiltered",
    """SELECT o_custkey, o_orderpriority, count(*) AS duplicates FROM orders
       GROUP BY o_custkey, o_orderpriority HAVING count(*) > 1""",
)
def _duplicate_keys_prefiltered(t: Given) -> DataFrame:
    return profile.duplicate_keys_prefiltered(t.orders, ["o_custkey", "o_orderpriority"])


@query(
    "duplicate_key_count",
    """SELECT count(*) AS duplicated_keys, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS surplus_rows FROM
       (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)""",
)
def _duplicate_key_count(t: Given) -> DataFrame:
    return profile.duplicate_key_count(t.lineitem, ["l_orderkey", "l_linenumber"])


@query(
    "referential_matches",
    """SELECT 'items_to_large_orders' AS relation, count(*) AS child_rows,
              count(o_orderkey) AS matched_rows, count(*) - count(o_orderkey) AS orphan_rows
       FROM lineitem LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_totalprice > 100000)
            ON l_orderkey = o_orderkey""",
)
def _referential_matches(t: Given) -> DataFrame:
    large = t.orders.filter(F.col("o_totalprice") > 100000)
    return integrity.referential_matches(
        t.lineitem, large, "l_orderkey", "o_orderkey", "items_to_large_orders"
    )


_RELATIONS = (
    ("orders_to_customer", "orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem_to_orders", "lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem_to_part", "lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem_to_supplier", "lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("labels_to_documents", "labels", "doc_id", "documents", "doc_id"),
    ("orders_to_lineitem", "orders", "o_orderkey", "lineitem", "l_orderkey"),
)


@query(
    "referential_audit",
    " UNION ALL ".join(
        f"""SELECT '{name}' AS relation, (SELECT count(*) FROM {child}) AS child_rows,
                   (SELECT count(*) FROM {child} c JOIN {parent} p ON c.{on} = p.{to}) AS matched_rows,
                   (SELECT count(*) FROM {child} WHERE {on} NOT IN (SELECT {to} FROM {parent})) AS orphan_rows"""
        for name, child, on, parent, to in _RELATIONS
    ),
)
def _referential_audit(t: Given) -> DataFrame:
    return integrity.referential_audit(
        [
            integrity.Relation(name, getattr(t, child), getattr(t, parent), on, to)
            for name, child, on, parent, to in _RELATIONS
        ]
    )


@query(
    "change_audit",
    """SELECT 'before' AS stage, count(*) FILTER (WHERE o_orderpriority = '4-NOT SPECIFIED') AS sentinels,
              CAST(0 AS BIGINT) AS nulls FROM orders
       UNION ALL
       SELECT 'after', 0, count(*) FILTER (WHERE o_orderpriority = '4-NOT SPECIFIED') FROM orders""",
)
def _change_audit(t: Given) -> DataFrame:
    predicates = {
        "sentinels": F.col("o_orderpriority") == NOT_SPECIFIED,
        "nulls": F.col("o_orderpriority").isNull(),
    }
    return profile.change_audit(t.orders, _with_gap(t), predicates)


@query(
    "change_audit_while_writing",
    """SELECT 'before' AS stage, count(*) FILTER (WHERE o_orderpriority = '4-NOT SPECIFIED') AS sentinels,
              CAST(0 AS BIGINT) AS nulls FROM orders
       UNION ALL
       SELECT 'after', 0, count(*) FILTER (WHERE o_orderpriority = '4-NOT SPECIFIED') FROM orders""",
)
def _change_audit_while_writing(t: Given) -> DataFrame:
    predicates = {
        "sentinels": F.col("o_orderpriority") == NOT_SPECIFIED,
        "nulls": F.col("o_orderpriority").isNull(),
    }

    def correct(df: DataFrame) -> DataFrame:
        return clean.sentinel_to_null(df, {"o_orderpriority": [NOT_SPECIFIED]})

    _, audit = profile.audited_write(t.orders, correct, shared_path(t.spark, "orders-corrected"), predicates)
    return audit


@query(
    "reconcile_total",
    """WITH c AS (SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS s FROM orders GROUP BY o_custkey),
            p AS (SELECT (SELECT sum(s) FROM c JOIN customer ON o_custkey = c_custkey) AS l,
                         (SELECT sum(CAST(o_totalprice AS DECIMAL(18,2))) FROM orders) AS r)
       SELECT CAST(l AS DOUBLE) AS left_total, CAST(r AS DOUBLE) AS right_total,
              CAST(l - r AS DOUBLE) AS difference FROM p""",
)
def _reconcile_total(t: Given) -> DataFrame:
    spent = marts.rollup_to_parent(
        t.customer, t.orders, "c_custkey", {"spent": F.sum(_money("o_totalprice"))}, "o_custkey"
    )
    return plain(
        integrity.reconcile_total(spent, t.orders, F.sum("spent"), F.sum(_money("o_totalprice")))
    )


@query(
    "missing_after_join",
    """SELECT count(*) AS missing_rows FROM orders JOIN lineitem ON o_orderkey = l_orderkey
       WHERE o_orderpriority = '4-NOT SPECIFIED'""",
)
def _missing_after_join(t: Given) -> DataFrame:
    return integrity.missing_after_join(
        _with_gap(t), t.lineitem, "o_orderkey", "o_orderpriority", "l_orderkey"
    )


# --- correction, missing values, deduplication ---------------------------------------------------


@query(
    "sentinel_to_null",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN NULL ELSE l_discount END AS l_discount,
              CASE WHEN l_returnflag IN ('A', 'N') THEN NULL ELSE l_returnflag END AS l_returnflag FROM lineitem""",
)
def _sentinel_to_null(t: Given) -> DataFrame:
    out = clean.sentinel_to_null(t.lineitem, {"l_discount": [0], "l_returnflag": ["A", "N"]})
    return out.select("l_orderkey", "l_linenumber", "l_discount", "l_returnflag")


@query(
    "blank_to_null",
    f"""WITH e AS ({duck(gappy_events)})
        SELECT event_id, nullif(event_type, '') AS event_type, nullif(ts_text, '') AS ts_text FROM e""",
)
def _blank_to_null(t: Given) -> DataFrame:
    out = clean.blank_to_null(t.derive(gappy_events), ["event_type", "ts_text"])
    return out.select("event_id", "event_type", "ts_text")


@query(
    "threshold_flag",
    "SELECT o_orderkey, CASE WHEN o_totalprice > 450000 THEN 1 ELSE 0 END AS flag_high FROM orders",
)
def _threshold_flag(t: Given) -> DataFrame:
    return clean.threshold_flag(t.orders, "o_totalprice", 450000, "flag_high").select("o_orderkey", "flag_high")


@query(
    "null_flag",
    """SELECT o_orderkey, CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 1 ELSE 0 END AS flag_no_priority
       FROM orders""",
)
def _null_flag(t: Given) -> DataFrame:
    out = clean.null_flag(_with_gap(t), "o_orderpriority", "flag_no_priority")
    return out.select("o_orderkey", "flag_no_priority")


@query(
    "value_flag",
    f"""WITH a AS ({duck(aged_orders)})
        SELECT o_orderkey, CASE WHEN day_age = 365243 THEN 1 ELSE 0 END AS flag_not_applicable FROM a""",
)
def _value_flag(t: Given) -> DataFrame:
    out = clean.value_flag(t.derive(aged_orders), "day_age", 365243, "flag_not_applicable")
    return out.select("o_orderkey", "flag_not_applicable")


_MEDIAN_SQL = """SELECT (min(v) FILTER (WHERE rn = (n + 1) // 2) + min(v) FILTER (WHERE rn = (n + 2) // 2)) / 2
                        AS {name} FROM (SELECT {col} AS v, row_number() OVER (ORDER BY {col}) AS rn,
                        count(*) OVER () AS n FROM {table} WHERE {where})"""


@query(
    "exact_median",
    _MEDIAN_SQL.format(name="median", col="l_extendedprice", table="lineitem", where="l_extendedprice IS NOT NULL"),
)
def _exact_median(t: Given) -> DataFrame:
    return clean.exact_median(t.lineitem, "l_extendedprice")


@query(
    "impute_median",
    f"""WITH m AS ({_MEDIAN_SQL.format(name="m", col="l_discount", table="lineitem", where="l_discount <> 0")})
        SELECT l_orderkey, l_linenumber,
               CASE WHEN l_discount = 0 THEN (SELECT m FROM m) ELSE l_discount END AS l_discount FROM lineitem""",
)
def _impute_median(t: Given) -> DataFrame:
    gaps = clean.sentinel_to_null(t.lineitem, {"l_discount": [0]})
    return clean.impute_median(gaps, "l_discount").select("l_orderkey", "l_linenumber", "l_discount")


@query(
    "impute_constant",
    """SELECT o_orderkey, CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN '3-MEDIUM' ELSE o_orderpriority END
              AS o_orderpriority FROM orders""",
)
def _impute_constant(t: Given) -> DataFrame:
    return clean.impute_constant(_with_gap(t), {"o_orderpriority": "3-MEDIUM"}).select(
        "o_orderkey", "o_orderpriority"
    )


@query(
    "reclassify_null",
    """SELECT CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'Unknown' ELSE o_orderpriority END
              AS o_orderpriority, count(*) AS records FROM orders GROUP BY 1""",
)
def _reclassify_null(t: Given) -> DataFrame:
    known = clean.reclassify_null(_with_gap(t), "o_orderpriority", "Unknown")
    return profile.value_distribution(known, "o_orderpriority")


_LATEST = ("l_shipdate", "l_quantity")
_REST = ("l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")


@query(
    "dedupe_latest",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax,
               l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m-%d') AS shipped
        FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
              ORDER BY {", ".join(f"{c} DESC" for c in _LATEST + _REST)}) AS rn FROM lineitem) WHERE rn = 1""",
)
def _dedupe_latest(t: Given) -> DataFrame:
    kept = clean.dedupe_latest(t.lineitem, ["l_orderkey", "l_linenumber"], _LATEST)
    return kept.select(
        *[c for c in kept.columns if c != "l_shipdate"],
        F.substring(F.col("l_shipdate").cast("string"), 1, 10).alias("shipped"),
    )


@query(
    "dedupe_latest_limited",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax,
               l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m-%d') AS shipped
        FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
              ORDER BY {", ".join(f"{c} DESC" for c in _LATEST + _REST)}) AS rn FROM lineitem) WHERE rn = 1""",
)
def _dedupe_latest_limited(t: Given) -> DataFrame:
    kept = clean.dedupe_latest_limited(t.lineitem, ["l_orderkey", "l_linenumber"], _LATEST)
    return kept.select(
        *[c for c in kept.columns if c != "l_shipdate"],
        F.substring(F.col("l_shipdate").cast("string"), 1, 10).alias("shipped"),
    )


@query(
    "exact_median_of_close_values",
    """WITH v AS (SELECT CAST(o_custkey AS DOUBLE) * 1e-13 AS tiny, o_orderkey AS k FROM orders),
       ranked AS (SELECT tiny, row_number() OVER (ORDER BY tiny) AS i, row_number() OVER (ORDER BY k) AS j, k,
                         count(*) OVER () AS n FROM v)
       SELECT avg(tiny) FILTER (WHERE i IN ((n + 1) // 2, (n + 2) // 2)) AS tiny,
              CAST(sum(k) FILTER (WHERE j IN ((n + 1) // 2, (n + 2) // 2)) AS DOUBLE) / (2 - max(n) % 2) AS k FROM ranked""",
)
def _exact_median_of_close_values(t: Given) -> DataFrame:
    """Values that all lie within 1e-9, and whole numbers, in one set of scans."""
    close = t.orders.select((F.col("o_custkey").cast("double") * 1e-13).alias("tiny"), F.col("o_orderkey").alias("k"))
    return clean.exact_medians(close, {"tiny": None, "k": None})


@query(
    "narrow_type",
    """SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) AS l_quantity FROM lineitem""",
)
def _narrow_type(t: Given) -> DataFrame:
    narrow = clean.narrow_type(t.lineitem, "l_quantity", "tinyint")
    return plain(narrow.select("l_orderkey", "l_linenumber", "l_quantity"))


@query(
    "narrowing_losses",
    """SELECT count(p_retailprice) AS checked,
              count(*) FILTER (WHERE p_retailprice <> floor(p_retailprice) OR p_retailprice > 950) AS losses
       FROM (SELECT CASE WHEN p_retailprice > 950 THEN p_retailprice * 100 ELSE p_retailprice END
             AS p_retailprice FROM part)""",
)
def _narrowing_losses(t: Given) -> DataFrame:
    price = F.col("p_retailprice")
    widened = t.part.withColumn("p_retailprice", F.when(price > 950, price * 100).otherwise(price))
    return clean.narrowing_losses(widened, "p_retailprice", "smallint")


# --- transformation and derived columns ----------------------------------------------------------


@query(
    "days_to_years",
    f"""WITH a AS ({duck(aged_orders)})
        SELECT o_orderkey, CASE WHEN day_age = 365243 THEN NULL
               ELSE CAST((abs(day_age) * 2000 + 36525) // 73050 AS DOUBLE) / 10 END AS years FROM a""",
)
def _days_to_years(t: Given) -> DataFrame:
    out = derive.days_to_years(t.derive(aged_orders), "day_age", "years", F.col("day_age") == 365243)
    return plain(out.select("o_orderkey", "years"))


@query(
    "code_to_label",
    """SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'Low Risk' WHEN 1 THEN 'Medium Risk' ELSE 'High Risk' END
              AS region_risk FROM nation""",
)
def _code_to_label(t: Given) -> DataFrame:
    labels = {0: "Low Risk", 1: "Medium Risk"}
    out = derive.code_to_label(t.nation, "n_regionkey", labels, "High Risk", "region_risk")
    return out.select("n_nationkey", "region_risk")


@query(
    "to_timestamps",
    f"""WITH e AS ({duck(gappy_events)})
        SELECT event_id, CASE WHEN ts_text IN ('', 'unknown') THEN NULL
               ELSE epoch(CAST(ts_text AS TIMESTAMP)) / 60 END AS minutes FROM e""",
)
def _to_timestamps(t: Given) -> DataFrame:
    out = derive.to_timestamps(t.derive(gappy_events), ["ts_text"])
    seconds = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts_text"))
    return out.select("event_id", (seconds.cast("double") / 60).alias("minutes"))


@query(
    "outcome_flag",
    f"""WITH d AS ({duck(deliveries)})
        SELECT CASE WHEN actual > promised THEN 1 WHEN actual IS NULL THEN NULL ELSE 0 END AS is_late,
               count(*) AS records FROM d GROUP BY 1""",
)
def _outcome_flag(t: Given) -> DataFrame:
    flagged = derive.outcome_flag(t.derive(deliveries), "actual", "promised", "is_late")
    return profile.value_distribution(flagged, "is_late")


@query(
    "day_variance",
    f"""WITH d AS ({duck(deliveries)})
        SELECT CAST(date_diff('day', CAST(promised AS DATE), CAST(actual AS DATE)) AS INTEGER) AS variance,
               count(*) AS records FROM d GROUP BY 1""",
)
def _day_variance(t: Given) -> DataFrame:
    flagged = derive.day_variance(t.derive(deliveries), "actual", "promised", "variance")
    return profile.value_distribution(flagged, "variance")


@query(
    "guarded_ratio",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' OR l_discount = 0 THEN NULL
              ELSE l_tax / l_discount + 0.0 END AS ratio FROM lineitem""",
)
def _guarded_ratio(t: Given) -> DataFrame:
    out = derive.guarded_ratio(
        t.lineitem, "l_tax", "l_discount", "ratio", scale=None, null_when=F.col("l_returnflag") == "R"
    )
    return out.select("l_orderkey", "l_linenumber", (F.col("ratio") + 0.0).alias("ratio"))


@query(
    "guarded_ratio_above_100",
    """SELECT l_orderkey, l_linenumber, CAST(cents * 20000 + d AS HUGEINT) // (2 * d) / 10000 AS ratio
       FROM (SELECT *, CAST(round(l_extendedprice * 100) AS HUGEINT) AS cents,
                    CAST(round(l_quantity) * 100 AS HUGEINT) AS d FROM lineitem)""",
)
def _guarded_ratio_above_100(t: Given) -> DataFrame:
    """Unit prices, nearly all above 100, keep their value."""
    items = t.lineitem.select(
        "l_orderkey", "l_linenumber", _money("l_extendedprice").alias("price"), _money("l_quantity").alias("n")
    )
    out = derive.guarded_ratio(items, "price", "n", "ratio")
    return plain(out.select("l_orderkey", "l_linenumber", "ratio"))


@query(
    "guarded_ratio_rounded",
    """SELECT o_orderkey, CAST((CAST(round(o_totalprice * 100) AS HUGEINT) * 20000 + d) // (2 * d) AS DOUBLE)
              / 10000 AS ratio
       FROM (SELECT *, CAST(100 * (10000 + o_custkey) AS HUGEINT) AS d FROM orders)""",
)
def _guarded_ratio_rounded(t: Given) -> DataFrame:
    priced = t.orders.select(
        "o_orderkey",
        _money("o_totalprice").alias("price"),
        (F.lit(10000) + F.col("o_custkey")).cast("decimal(18,2)").alias("base"),
    )
    return plain(derive.guarded_ratio(priced, "price", "base", "ratio", 4, 10).select("o_orderkey", "ratio"))


_EDGES = (0, 2500, 5000, 7500)
_LABELS = ("Debt", "Low", "Mid", "Upper-Mid", "High")
_BAND_SQL = """CASE WHEN c_acctbal < 0 THEN 'Debt' WHEN c_acctbal < 2500 THEN 'Low' WHEN c_acctbal < 5000 THEN 'Mid'
                    WHEN c_acctbal < 7500 THEN 'Upper-Mid' ELSE 'High' END"""


@query("band", f"SELECT {_BAND_SQL} AS balance_tier, count(*) AS records FROM customer GROUP BY 1")
def _band(t: Given) -> DataFrame:
    tiers = derive.band(t.customer, "c_acctbal", _EDGES, _LABELS, "balance_tier")
    return profile.value_distribution(tiers, "balance_tier")


@query(
    "band_closed",
    """SELECT CASE WHEN p_size <= 10 THEN 'tiny' WHEN p_size BETWEEN 11 AND 20 THEN 'small'
                   WHEN p_size = 25 THEN 'standard' WHEN p_size >= 40 THEN 'large' END AS size_band,
              count(*) AS records FROM part GROUP BY 1""",
)
def _band_closed(t: Given) -> DataFrame:
    ranges = [(None, 10, "tiny"), (11, 20, "small"), (25, 25, "standard"), (40, None, "large")]
    return profile.value_distribution(
        derive.band_closed(t.part, "p_size", ranges, "size_band"), "size_band"
    )


@query(
    "translate_lookup",
    """SELECT l_orderkey, l_linenumber, CASE n_name WHEN 'NATION_3' THEN 'Third' WHEN 'NATION_4' THEN 'Fourth'
              ELSE r_name END AS region
       FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
       LEFT JOIN (SELECT * FROM region WHERE r_name <> 'ASIA') ON n_regionkey = r_regionkey""",
)
def _translate_lookup(t: Given, spread_hot: bool = False, rows_per_task: int | None = None) -> DataFrame:
    nations = t.nation.join(t.region.filter(F.col("r_name") != "ASIA"), F.col("n_regionkey") == F.col("r_regionkey"))
    homes = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    items = t.lineitem.join(homes, F.col("l_suppkey") == F.col("s_suppkey"))
    items = items.select("l_orderkey", "l_linenumber", F.col("n_name").alias("home"))
    manual = {"NATION_3": "Third", "NATION_4": "Fourth"}
    out = derive.translate_lookup(
        items, nations, "home", "r_name", "region", manual, "n_name", spread_hot=spread_hot, rows_per_task=rows_per_task
    )
    return out.select("l_orderkey", "l_linenumber", "region")


_TRANSLATE_SQL = """SELECT l_orderkey, l_linenumber, CASE n_name WHEN 'NATION_3' THEN 'Third' WHEN 'NATION_4' THEN 'Fourth'
              ELSE r_name END AS region
       FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
       LEFT JOIN (SELECT * FROM region WHERE r_name <> 'ASIA') ON n_regionkey = r_regionkey"""


@query("translate_lookup_spread", _TRANSLATE_SQL)
def _translate_lookup_spread(t: Given) -> DataFrame:
    """The same on the salted path: a salt per 1000 rows of a nation, so every nation is spread."""
    return _translate_lookup(t, spread_hot=True, rows_per_task=1000)


@query(
    "rollup_to_parent",
    """SELECT o_orderkey, items, price FROM orders LEFT JOIN
       (SELECT l_orderkey, count(*) AS items, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS price
        FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey""",
)
def _rollup_to_parent(t: Given) -> DataFrame:
    aggs = {"items": F.count("*"), "price": _money_sum("l_extendedprice")}
    out = marts.rollup_to_parent(t.orders, t.lineitem, "o_orderkey", aggs, "l_orderkey")
    return out.select("o_orderkey", "items", "price")


_SUPPLIER_SQL = f"""
    WITH d AS ({duck(deliveries)}),
    f AS (SELECT *, CASE WHEN actual > promised THEN 1 WHEN actual IS NULL THEN NULL ELSE 0 END AS late FROM d),
    s AS (SELECT b1.l_suppkey, total_orders, total_revenue, late_rate, score FROM
          (SELECT l_suppkey, count(DISTINCT l_orderkey) AS total_orders,
                  CAST(sum(o_totalprice) AS DOUBLE) AS total_revenue FROM f GROUP BY l_suppkey) b1
          LEFT JOIN (SELECT l_suppkey, {rate_sql("late", "late_rate")} FROM f WHERE o_orderstatus <> 'P'
                     GROUP BY l_suppkey) b2 ON b1.l_suppkey = b2.l_suppkey
          LEFT JOIN (SELECT l_suppkey, {mean_sql("l_quantity", "score")} FROM f GROUP BY l_suppkey) b3
                 ON b1.l_suppkey = b3.l_suppkey),
    cut AS (SELECT {rate_sql("late", "late_cut")}, {mean_sql("l_quantity", "score_cut")} FROM f)"""


def _supplier_blocks(t: Given):
    rows = derive.outcome_flag(t.derive(deliveries), "actual", "promised", "late")
    base = (
        skew.deal(rows, ["l_suppkey", "l_orderkey"], rows)
        .groupBy("l_suppkey", "l_orderkey")
        .agg(F.sum("o_totalprice").alias("revenue"))
        .groupBy("l_suppkey")
        .agg(F.count("*").alias("total_orders"), F.sum("revenue").cast("double").alias("total_revenue"))
    )
    late = rows.filter(F.col("o_orderstatus") != "P").groupBy("l_suppkey")
    late = late.agg(segment.rate_expr("late", None).alias("late_rate"))
    score = rows.groupBy("l_suppkey").agg(segment.mean_expr("l_quantity", None).alias("score"))
    return base, [late, score]


def _supplier_summary(t: Given) -> DataFrame:
    """The same metrics in one pass: sums per supplier and order, then per supplier, with what benchmarks need."""
    rows = derive.outcome_flag(t.derive(deliveries), "actual", "promised", "late")
    rows = rows.withColumn("judged", F.when(F.col("o_orderstatus") != "P", F.col("late")))
    sums = {
        "revenue": F.sum("o_totalprice"),
        "late": F.sum("late"),
        "outcomes": F.count("late"),
        "judged_late": F.sum("judged"),
        "judged": F.count("judged"),
        "quantity": F.sum("l_quantity"),
        "items": F.count("l_quantity"),
    }
    dealt = skew.deal(rows, ["l_suppkey", "l_orderkey"], rows)
    orders = dealt.groupBy("l_suppkey", "l_orderkey").agg(*[e.alias(name) for name, e in sums.items()])
    return (
        orders.groupBy("l_suppkey")
        .agg(F.count("*").alias("total_orders"), *[F.sum(name).alias(name) for name in sums])
        .withColumn("late_rate", percent(F.col("judged_late"), F.col("judged"), None))
        .withColumn("score", mean(F.col("quantity"), F.col("items"), None))
    )


@query("entity_summary", f"{_SUPPLIER_SQL} SELECT * FROM s")
def _entity_summary(t: Given) -> DataFrame:
    base, blocks = _supplier_blocks(t)
    return marts.entity_summary(base, blocks, "l_suppkey")


_BRIDGED_SQL = """WITH i AS (SELECT l_suppkey, l_orderkey, l_quantity FROM lineitem),
       o AS (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS price FROM orders WHERE o_orderstatus <> 'P')
       SELECT i.l_suppkey, count(DISTINCT o_orderkey) AS paid_keys, CAST(sum(price) AS DOUBLE) AS paid_price_sum,
              count(price) AS paid_price_count, CAST(sum(price) AS DOUBLE) / count(price) AS paid_price_mean,
              sum(l_quantity) AS l_quantity_sum, count(l_quantity) AS l_quantity_count,
              sum(l_quantity) / count(l_quantity) AS l_quantity_mean
       FROM i LEFT JOIN o ON l_orderkey = o_orderkey GROUP BY i.l_suppkey HAVING count(o_orderkey) > 0"""


def _bridged(t: Given, rows_per_task: int | None = None) -> DataFrame:
    priced = t.orders.withColumn("price", _money("o_totalprice"))
    paid = marts.Block(priced, "o_orderkey", ["price"], F.col("o_orderstatus") != "P", required=True)
    blocks = {"paid": paid}
    return plain(
        marts.bridged_summary(
            t.lineitem, "l_suppkey", "l_orderkey", blocks, ["l_quantity"], rows_per_task=rows_per_task
        )
    )


@query("bridged_summary", _BRIDGED_SQL)
def _bridged_summary(t: Given) -> DataFrame:
    return _bridged(t)


@query("bridged_summary_spread", _BRIDGED_SQL)
def _bridged_summary_spread(t: Given) -> DataFrame:
    """The same with three rows to a task, so that nearly every key is spread over salts."""
    return _bridged(t, 3)


@query(
    "bridged_summary_no_fan_out",
    """SELECT l_suppkey, count(*) AS paid_keys, CAST(sum(price) AS DOUBLE) AS paid_price_sum,
              count(price) AS paid_price_count, CAST(sum(price) AS DOUBLE) / count(price) AS paid_price_mean
       FROM (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem)
       JOIN (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS price FROM orders)
            ON l_orderkey = o_orderkey GROUP BY l_suppkey""",
)
def _bridged_summary_no_fan_out(t: Given) -> DataFrame:
    priced = t.orders.withColumn("price", _money("o_totalprice"))
    paid = marts.Block(priced, "o_orderkey", ["price"], required=True)
    return plain(
        marts.bridged_summary(t.lineitem, "l_suppkey", "l_orderkey", {"paid": paid}, fan_out=False)
    )


def _order_classes():
    rules = [
        ((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 300000), "Pending large"),
        (F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "Pressing"),
    ]
    return rules, "Standard"


_CLASS_SQL = """CASE WHEN o_orderstatus = 'P' AND o_totalprice > 300000 THEN 'Pending large'
                     WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Pressing' ELSE 'Standard' END"""


@query("classify", f"SELECT o_orderkey, {_CLASS_SQL} AS order_class FROM orders")
def _classify(t: Given) -> DataFrame:
    rules, default = _order_classes()
    return derive.classify(t.orders, rules, default, "order_class").select("o_orderkey", "order_class")


# --- segmentation, ranking, trend ----------------------------------------------------------------

_RETURN_RATE = rate_sql("CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END")


@query(
    "rate_by",
    f"""SELECT l_linestatus, {_RETURN_RATE}, count(*) AS volume FROM lineitem GROUP BY l_linestatus""",
)
def _rate_by(t: Given) -> DataFrame:
    return segment.rate_by(_returned(t), "l_linestatus", "returned", scale=None)


@query(
    "rate_by_two_dims",
    f"""SELECT lang, source, {rate_sql("toxic")}, count(*) AS volume
        FROM documents JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY lang, source""",
)
def _rate_by_two_dims(t: Given) -> DataFrame:
    labelled = t.documents.select("doc_id", "lang", "source").join(t.labels, "doc_id")
    return segment.rate_by(labelled, ["lang", "source"], "toxic", F.col("quality") == 1, None)


@query(
    "rate_by_band",
    f"""SELECT CASE WHEN l_quantity < 10 THEN 'few' WHEN l_quantity < 30 THEN 'some' ELSE 'many' END AS size_band,
               CASE WHEN l_discount < 0.05 THEN 'low' ELSE 'high' END AS discount_band,
               {_RETURN_RATE}, count(*) AS volume FROM lineitem GROUP BY 1, 2""",
)
def _rate_by_band(t: Given) -> DataFrame:
    bands = {
        "size_band": C.band("l_quantity", [10, 30], ["few", "some", "many"]),
        "discount_band": C.band("l_discount", [0.05], ["low", "high"]),
    }
    return segment.rate_by_band(_returned(t), bands, "returned", scale=None)


@query(
    "range_by",
    f"""SELECT o_orderstatus, min(CAST(price AS DOUBLE)) AS min_price, max(CAST(price AS DOUBLE)) AS max_price,
               {mean_sql("price", "avg_price")}
        FROM (SELECT *, CAST(o_totalprice AS DECIMAL(18,2)) AS price FROM orders) GROUP BY o_orderstatus""",
)
def _range_by(t: Given) -> DataFrame:
    priced = t.orders.withColumn("price", _money("o_totalprice"))
    return plain(segment.range_by(priced, "o_orderstatus", "price", scale=None))


@query(
    "mean_by",
    f"""WITH d AS ({duck(deliveries)})
        SELECT CASE WHEN actual > promised THEN 1 WHEN actual IS NULL THEN NULL ELSE 0 END AS is_late,
               {mean_sql("l_quantity", "avg_l_quantity")}, count(*) AS volume FROM d GROUP BY 1""",
)
def _mean_by(t: Given) -> DataFrame:
    flagged = derive.outcome_flag(t.derive(deliveries), "actual", "promised", "is_late")
    return segment.mean_by(flagged, "is_late", "l_quantity", scale=None)


@query(
    "profile_metrics",
    f"""SELECT {_RETURN_RATE}, {mean_sql("l_quantity", "avg_quantity")}, count(*) AS volume
        FROM lineitem WHERE l_quantity > 40 AND l_linestatus = 'O' AND l_discount >= 0.05""",
)
def _profile_metrics(t: Given) -> DataFrame:
    predicates = [F.col("l_quantity") > 40, F.col("l_linestatus") == "O", F.col("l_discount") >= 0.05]
    metrics = {
        "rate": segment.rate_expr("returned", None),
        "avg_quantity": segment.mean_expr("l_quantity", None),
        "volume": F.count("*"),
    }
    return segment.profile_metrics(_returned(t), predicates, metrics)


@query(
    "compare_profiles",
    f"""SELECT {_CLASS_SQL} AS profile, {mean_sql("CAST(o_totalprice AS DECIMAL(18,2))", "avg_price")},
               count(*) AS volume FROM orders GROUP BY 1""",
)
def _compare_profiles(t: Given) -> DataFrame:
    rules, default = _order_classes()
    metrics = {"avg_price": segment.mean_expr(_money("o_totalprice"), None), "volume": F.count("*")}
    return segment.compare_profiles(t.orders, rules, default, metrics)


@query(
    "top_k_min_volume",
    f"""SELECT l_suppkey, {_RETURN_RATE}, count(*) AS volume FROM lineitem GROUP BY l_suppkey
        HAVING count(l_suppkey) > 580 ORDER BY rate DESC, l_suppkey LIMIT 5""",
)
def _top_k_min_volume(t: Given) -> DataFrame:
    return segment.top_k_min_volume(_returned(t), "l_suppkey", "returned", 580, 5, None)


@query(
    "joined_rate",
    f"""SELECT n_name, count(*) AS volume, {_RETURN_RATE} FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
        WHERE o_orderstatus = 'F' GROUP BY n_name HAVING count(*) > 300""",
)
def _joined_rate(t: Given) -> DataFrame:
    links = [
        Link(t.orders, "l_orderkey", "o_orderkey", F.col("o_orderstatus") == "F", unique=True),
        Link(t.supplier, "l_suppkey", "s_suppkey", unique=True),
        Link(t.nation, "s_nationkey", "n_nationkey", unique=True),
    ]
    return segment.joined_rate(_returned(t), links, "n_name", "returned", 300, scale=None)


@query(
    "joined_mean",
    f"""SELECT p_brand, count(*) AS volume, {mean_sql("l_quantity", "avg_l_quantity")}
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand HAVING count(*) >= 2000""",
)
def _joined_mean(t: Given) -> DataFrame:
    links = [Link(t.part, "l_partkey", "p_partkey", unique=True)]
    return segment.joined_mean(t.lineitem, links, "p_brand", "l_quantity", 2000, inclusive=True, scale=None)


@query(
    "joined_total",
    f"""SELECT n_name, count(*) AS volume, CAST(sum(price) AS DOUBLE) AS total, {mean_sql("price", "average")}
        FROM lineitem JOIN (SELECT *, CAST(o_totalprice AS DECIMAL(18,2)) AS price FROM orders)
             ON l_orderkey = o_orderkey
        JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        GROUP BY n_name HAVING count(*) > 100""",
)
def _joined_total(t: Given) -> DataFrame:
    links = [
        Link(t.orders.withColumn("price", _money("o_totalprice")), "l_orderkey", "o_orderkey", unique=True),
        Link(t.customer, "o_custkey", "c_custkey", unique=True),
        Link(t.nation, "c_nationkey", "n_nationkey", unique=True),
    ]
    return plain(segment.joined_total(t.lineitem, links, "n_name", "price", 100, scale=None))


_MULTI_SQL = f"""SELECT p_type, n_name, count(*) AS volume, {rate_sql("i.returned", "rate_returned")},
               {mean_sql("e.score", "avg_score")}
        FROM (SELECT *, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS returned FROM lineitem) i
        JOIN (SELECT l_orderkey, l_linenumber AS score FROM lineitem) e
             ON i.l_orderkey = e.l_orderkey
        JOIN part ON i.l_partkey = p_partkey JOIN supplier ON i.l_suppkey = s_suppkey
        JOIN nation ON s_nationkey = n_nationkey GROUP BY p_type, n_name HAVING count(*) > 100"""


def _multi(t: Given, rows_per_task: int | None = None) -> DataFrame:
    scored = t.lineitem.select(F.col("l_orderkey").alias("scored_order"), F.col("l_linenumber").alias("score"))
    links = [
        Link(scored, "l_orderkey", "scored_order"),
        Link(t.part, "l_partkey", "p_partkey", unique=True),
        Link(t.supplier, "l_suppkey", "s_suppkey", unique=True),
        Link(t.nation, "s_nationkey", "n_nationkey", unique=True),
    ]
    return segment.joined_multi(
        _returned(t), links, ["p_type", "n_name"], {"returned": None}, {"score": None}, 100,
        rows_per_task=rows_per_task,
    )


@query("joined_multi", _MULTI_SQL)
def _joined_multi(t: Given) -> DataFrame:
    return _multi(t)


@query("joined_multi_spread", _MULTI_SQL)
def _joined_multi_spread(t: Given) -> DataFrame:
    """The same with three rows to a task, so that nearly every key is spread over salts."""
    return _multi(t, 3)


@query(
    "share_distribution",
    """SELECT l_linenumber, count(*) AS volume,
              count(*) * 100.0::DOUBLE / (SELECT count(*) FROM lineitem) AS share
       FROM lineitem GROUP BY l_linenumber""",
)
def _share_distribution(t: Given) -> DataFrame:
    return segment.share_distribution(t.lineitem, "l_linenumber", scale=None)


_WIDE_BANDS = (
    (None, -1001, "Early by more than 1000 days"),
    (-1000, -1, "Early"),
    (0, 0, "On time"),
    (1, 1000, "Late"),
    (1001, None, "Late by more than 1000 days"),
)


@query(
    "share_distribution_ordered",
    f"""WITH d AS ({duck(deliveries)}),
        v AS (SELECT date_diff('day', CAST(promised AS DATE), CAST(actual AS DATE)) AS v FROM d
              WHERE actual IS NOT NULL AND promised IS NOT NULL)
        SELECT CASE WHEN v <= -1001 THEN 'Early by more than 1000 days' WHEN v <= -1 THEN 'Early'
                    WHEN v = 0 THEN 'On time' WHEN v <= 1000 THEN 'Late' WHEN v >= 1001 THEN 'Late by more than 1000 days'
               END AS band,
               count(*) AS volume, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM v) AS share
        FROM v GROUP BY 1""",
)
def _share_distribution_ordered(t: Given) -> DataFrame:
    rows = derive.day_variance(t.derive(deliveries), "actual", "promised", "variance")
    rows = derive.band_closed(rows.filter(F.col("variance").isNotNull()), "variance", _WIDE_BANDS, "band")
    return segment.share_distribution(rows, "band", "variance", scale=None)


@query(
    "outcome_headline",
    f"""WITH d AS ({duck(deliveries)}),
        f AS (SELECT *, CASE WHEN actual > promised THEN 1 WHEN actual IS NULL THEN NULL ELSE 0 END AS late FROM d)
        SELECT count(*) AS total, count(*) FILTER (WHERE late = 1) AS positives, {rate_sql("late")},
               count(*) FILTER (WHERE late = 0) AS negatives FROM f WHERE o_orderstatus <> 'O'""",
)
def _outcome_headline(t: Given) -> DataFrame:
    flagged = derive.outcome_flag(t.derive(deliveries), "actual", "promised", "late")
    return segment.outcome_headline(flagged, "late", F.col("o_orderstatus") != "O", None)


@query(
    "monthly_trend",
    f"""SELECT strftime(l_shipdate, '%Y-%m') AS month, count(*) AS volume, {_RETURN_RATE}
        FROM lineitem WHERE l_linestatus = 'F' AND l_shipdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1998-08-31'
        GROUP BY 1""",
)
def _monthly_trend(t: Given) -> DataFrame:
    filled = F.col("l_linestatus") == "F"
    return segment.monthly_trend(
        _returned(t), "l_shipdate", "returned", "1997-01-01", "1998-08-31", filled, None
    )


@query(
    "monthly_trend_pruned",
    f"""SELECT strftime(l_shipdate, '%Y-%m') AS month, count(*) AS volume, {_RETURN_RATE}
        FROM lineitem WHERE l_linestatus = 'F' AND l_shipdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1998-08-31'
        GROUP BY 1""",
)
def _monthly_trend_pruned(t: Given) -> DataFrame:
    """The same over items stored partitioned by shipping month."""
    items = _returned(t).select("l_shipdate", "returned", "l_linestatus").withColumn("month", segment.month_of("l_shipdate"))
    stored = materialize(items, shared_path(t.spark, "items-by-month"), partition_by=["month"])
    filled = F.col("l_linestatus") == "F"
    return segment.monthly_trend_pruned(stored, "l_shipdate", "returned", "1997-01-01", "1998-08-31", filled, None)


@query(
    "top_entities",
    f"""{_SUPPLIER_SQL} SELECT * FROM s WHERE total_orders >= 550
        ORDER BY total_revenue DESC, l_suppkey LIMIT 10""",
)
def _top_entities(t: Given) -> DataFrame:
    top = segment.top_entities(_supplier_summary(t), "l_suppkey", "revenue", 10, F.col("total_orders") >= 550)
    total = F.col("revenue").cast("double").alias("total_revenue")
    return top.select("l_suppkey", "total_orders", total, "late_rate", "score")


@query(
    "tier_compare",
    """WITH s AS (SELECT l_suppkey, count(*) AS items, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS returned
                  FROM lineitem GROUP BY l_suppkey)
       SELECT CASE WHEN items < 580 THEN 'small' WHEN items < 610 THEN 'middle' ELSE 'large' END AS tier,
              count(*) AS entities, CAST(sum(returned) AS DOUBLE) / count(*) AS avg_returned
       FROM s WHERE items >= 550 GROUP BY 1""",
)
def _tier_compare(t: Given) -> DataFrame:
    summary = _returned(t).groupBy("l_suppkey").agg(
        F.count("*").alias("items"), F.sum("returned").alias("returned")
    )
    return segment.tier_compare(
        summary, "items", [580, 610], ["small", "middle", "large"],
        {"avg_returned": segment.mean_expr("returned", None)}, F.col("items") >= 550,
    )


@query(
    "share_of_total",
    """SELECT CAST(sum(p) FILTER (WHERE l_returnflag = 'R') AS DOUBLE) AS segment_total,
              count(*) FILTER (WHERE l_returnflag = 'R') AS segment_rows,
              CAST(sum(p) FILTER (WHERE l_returnflag = 'R') AS DOUBLE) * 100.0 / CAST(sum(p) AS DOUBLE) AS share
       FROM (SELECT *, CAST(l_extendedprice AS DECIMAL(18,2)) AS p FROM lineitem)""",
)
def _share_of_total(t: Given) -> DataFrame:
    priced = t.lineitem.withColumn("price", _money("l_extendedprice"))
    return plain(segment.share_of_total(priced, "price", F.col("l_returnflag") == "R", None))


# --- the flagship: mart, then decision -----------------------------------------------------------


@query(
    "supplier_revenue_at_risk",
    f"""{_SUPPLIER_SQL},
        r AS (SELECT *, late_rate > (SELECT late_cut FROM cut) AND score < (SELECT score_cut FROM cut) AS risky FROM s)
        SELECT CAST(sum(CAST(total_revenue AS DECIMAL(18,2))) FILTER (WHERE risky) AS DOUBLE) AS segment_total,
               count(*) FILTER (WHERE risky) AS segment_rows,
               CAST(sum(CAST(total_revenue AS DECIMAL(18,2))) FILTER (WHERE risky) AS DOUBLE) * 100.0
                   / CAST(sum(CAST(total_revenue AS DECIMAL(18,2))) AS DOUBLE) AS share FROM r""",
)
def supplier_revenue_at_risk(t: Given) -> DataFrame:
    """Share of revenue carried by suppliers that are later and scored lower than the whole table."""
    # Both benchmarks are sums of the summary's own sums: written once, one row per supplier, and read twice.
    summary = cut_lineage(_supplier_summary(t))
    cut = summary.agg(
        F.struct(
            percent(F.sum("late"), F.sum("outcomes"), None).alias("late"),
            mean(F.sum("quantity"), F.sum("items"), None).alias("score"),
        ).alias("cut")
    ).scalar()
    risky = (F.col("late_rate") > cut.getField("late")) & (F.col("score") < cut.getField("score"))
    return plain(segment.share_of_total(summary, "revenue", risky, None))
