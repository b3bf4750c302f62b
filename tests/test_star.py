"""Folded joins against the plain join, with fan-out, hot keys, copies and NULLs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tabaudit.operators import marts, skew, star
from tabaudit.operators.star import Link
from tabaudit.sources import bucket_count


@pytest.fixture(params=["cold", "salted"])
def salting(request, monkeypatch):
    """Both paths: with the floor down, every frequent bucket of the small fixture counts as hot."""
    if request.param == "salted":
        monkeypatch.setattr(skew, "ROWS_PER_TASK", 5)
    return request.param


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(3)

    def hot(n):  # a third of the rows on key 0, some NULL
        return rng.choice([0, 0, 0, *range(n), *range(n), None])

    items = [(hot(40), hot(12), hot(9), rng.randint(1, 5)) for _ in range(1200)]
    items += [(0, 0, 0, 1)] * 600  # copies
    orders = [(o, o % 7, rng.choice([0, 1, None]), rng.choice(["done", "open"])) for o in range(35)]
    reviews = [(hot(40), rng.choice([1, 2, 5, None])) for _ in range(150)]
    products = [(p, rng.choice(["x", "y", None]), 0) for p in range(10)]
    sellers = [(s, f"S{s % 3}") for s in range(9)]
    states = [(c, f"C{c % 2}") for c in range(7)]
    make = spark.createDataFrame
    return {
        "items": make(items, "order_id int, product_id int, seller_id int, qty int").repartition(6).cache(),
        "orders": make(orders, "order_id bigint, customer_id int, late int, status string").cache(),
        "reviews": make(reviews, "order_id int, score int").cache(),
        "products": make(products, "product_id int, category string, flag int").cache(),
        "sellers": make(sellers, "seller_id int, state string").cache(),
        "customers": make(states, "customer_id int, region string").cache(),
    }


def plain(df, by, measures):
    aggs = [F.count("*").alias("rows")]
    for m in measures:
        aggs += [F.sum(m).alias(f"sum_{m}"), F.count(m).alias(f"cnt_{m}")]
    return rows(df.groupBy(*by).agg(*aggs))


def rows(df):
    return sorted(map(tuple, df.collect()), key=lambda r: tuple((v is None, v if v is not None else 0) for v in r))


def folded(df, by, measures):
    cols = [star.ROWS, *[c for m in measures for c in (f"_sum_{m}", f"_cnt_{m}")]]
    return rows(df.select(*by, *cols))


def test_one_unique_link(tables):
    t = tables
    got = star.star_fold(t["items"], [Link(t["sellers"], "seller_id", unique=True)], ["state"], ["qty"])
    assert folded(got, ["state"], ["qty"]) == plain(t["items"].join(t["sellers"], "seller_id"), ["state"], ["qty"])


def test_no_links_is_a_group_by(tables):
    got = star.star_fold(tables["items"], [], ["seller_id"], ["qty"])
    assert folded(got, ["seller_id"], ["qty"]) == plain(tables["items"], ["seller_id"], ["qty"])


@pytest.mark.parametrize("unique", [True, False])
def test_star_with_fan_out_equals_the_plain_join(tables, salting, unique):
    t = tables
    links = [
        Link(t["orders"], "order_id", where=F.col("status") == "done", unique=unique),
        Link(t["reviews"], "order_id"),
        Link(t["products"], "product_id", where=F.col("flag") == 0, unique=unique),
        Link(t["sellers"], "seller_id", unique=unique),
    ]
    by, measures = ["category", "state"], ["late", "score", "qty"]
    got = star.star_fold(t["items"], links, by, measures)
    joined = (
        t["items"]
        .join(t["orders"].filter("status = 'done'"), "order_id")
        .join(t["reviews"], "order_id")
        .join(t["products"], "product_id")
        .join(t["sellers"], "seller_id")
    )
    assert folded(got, by, measures) == plain(joined, by, measures)


def test_a_wrong_promise_of_uniqueness_stays_exact(tables):
    t = tables
    links = [Link(t["reviews"], "order_id", unique=True), Link(t["sellers"], "seller_id", unique=True)]
    got = star.star_fold(t["items"], links, ["state"], ["score"])
    joined = t["items"].join(t["reviews"], "order_id").join(t["sellers"], "seller_id")
    assert folded(got, ["state"], ["score"]) == plain(joined, ["state"], ["score"])


def test_snowflake(tables, salting):
    t = tables
    links = [
        Link(t["orders"], "order_id", unique=True),
        Link(t["customers"], "customer_id", unique=True),
        Link(t["sellers"], "seller_id"),
    ]
    got = star.star_fold(t["items"], links, ["region", "state"], ["late"], where=F.col("qty") > 2)
    joined = (
        t["items"].filter("qty > 2").join(t["orders"], "order_id").join(t["customers"], "customer_id")
    ).join(t["sellers"], "seller_id")
    assert folded(got, ["region", "state"], ["late"]) == plain(joined, ["region", "state"], ["late"])


def test_unknown_column_is_an_error(tables):
    with pytest.raises(ValueError, match="no table has a column 'nowhere'"):
        star.star_fold(tables["items"], [], ["nowhere"])


def test_hot_buckets_hold_the_hot_keys(tables, monkeypatch):
    monkeypatch.setattr(skew, "ROWS_PER_TASK", 300)
    hot = skew.hot_buckets(tables["items"], "order_id")
    spread = skew.spread(tables["items"], "order_id", ["product_id", "seller_id", "qty"], hot)
    salts = {r[0]: r[1] for r in spread.groupBy("order_id").agg(F.countDistinct("_salt")).collect()}
    assert 3 <= salts[0] <= 6
    assert all(n == 1 for key, n in salts.items() if key != 0)
    partners = skew.repeat(tables["orders"], "order_id", hot).groupBy("order_id").count()
    repeated = {r[0]: r[1] for r in partners.collect()}
    assert repeated[0] >= salts[0] and repeated[5] == 1


def test_partners_have_no_more_copies_than_rows(spark, monkeypatch):
    monkeypatch.setattr(skew, "BUCKETS", 2)  # every bucket is hot, with hundreds of salts
    fact = spark.range(3000).select(F.expr("id % 1000 AS k"), F.col("id").alias("v"))
    hot = skew.hot_buckets(fact, "k", 3)
    salted = skew.spread(fact, "k", ["v"], hot)
    partners = spark.range(1010).withColumnRenamed("id", "p")
    got = skew.repeat_used(partners, "p", hot, salted, "k")
    want = salted.select("k", skew.SALT).distinct()
    assert skew.repeat(partners, "p", hot).count() > 100 * got.count()
    assert rows(got.filter("p < 1000")) == rows(want) and got.filter("p >= 1000").count() == 10


@pytest.mark.parametrize("buckets", [1, 4096])
def test_spread_joins_equal_the_plain_ones_when_every_bucket_is_hot(tables, monkeypatch, buckets):
    monkeypatch.setattr(skew, "BUCKETS", buckets)
    t = tables
    links = [Link(t["reviews"], "order_id"), Link(t["orders"], "order_id"), Link(t["sellers"], "seller_id")]
    args = t["items"], links, ["state"], ["score", "late", "qty"]
    few, many = (folded(star.star_fold(*args, rows_per_task=n), ["state"], args[3]) for n in (1, 10**9))
    assert few == many
    blocks = {"reviewed": marts.Block(t["reviews"], "order_id", ["score"]), "ordered": marts.Block(t["orders"], "order_id")}
    args = t["items"], "seller_id", "order_id", blocks, ["qty"]
    few, many = (rows(marts.bridged_summary(*args, rows_per_task=n)) for n in (1, 10**9))
    assert few == many


@pytest.fixture
def stored_items(spark, tables, tmp_path, monkeypatch):
    """Items in files, with a task size that asks for more tasks than there are cores."""
    path = str(tmp_path / "items")
    tables["items"].write.parquet(path)
    monkeypatch.setattr(skew, "TASK_BYTES", 100)
    return spark.read.parquet(path)


def _tasks_per_exchange(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [int(n) for n in re.findall(r"hashpartitioning\(order_id#\d+, _salt#\d+, (\d+)\), REPARTITION_BY_NUM", plan)]


def test_star_fold_deals_the_fact_by_its_size(tables, stored_items):
    t = tables
    links = [Link(t["reviews"], "order_id"), Link(t["sellers"], "seller_id", unique=True)]
    got = star.star_fold(stored_items, links, ["state"], ["score"])
    assert min(_tasks_per_exchange(got)) == bucket_count(stored_items, 100) > 16
    joined = t["items"].join(t["reviews"], "order_id").join(t["sellers"], "seller_id")
    assert folded(got, ["state"], ["score"]) == plain(joined, ["state"], ["score"])


def test_bridged_summary_deals_the_bridge_by_its_size(tables, stored_items):
    blocks = {"reviewed": marts.Block(tables["reviews"], "order_id", ["score"])}
    got = marts.bridged_summary(stored_items, "seller_id", "order_id", blocks, ["qty"])
    assert min(_tasks_per_exchange(got)) == bucket_count(stored_items, 100) > 16
    assert rows(got) == rows(marts.bridged_summary(tables["items"], "seller_id", "order_id", blocks, ["qty"]))


def test_bridged_summary_equals_separate_blocks(tables, salting):
    t = tables
    blocks = {
        "ordered": marts.Block(t["orders"], "order_id", ["late"], F.col("status") == "done", required=True),
        "reviewed": marts.Block(t["reviews"], "order_id", ["score"]),
    }
    got = marts.bridged_summary(t["items"], "seller_id", "order_id", blocks, ["qty"])
    got = got.select(
        "seller_id", "ordered_keys", "ordered_late_sum", "ordered_late_count", "reviewed_score_sum",
        "reviewed_score_count", "qty_sum",
    )
    done = t["items"].join(t["orders"].filter("status = 'done'"), "order_id")
    base = done.groupBy("seller_id").agg(
        F.countDistinct("order_id").alias("o"), F.sum("late").alias("ls"), F.count("late").alias("lc")
    )
    scored = t["items"].join(t["reviews"], "order_id").groupBy("seller_id")
    scored = scored.agg(F.sum("score").alias("ss"), F.count("score").alias("sc"))
    total = t["items"].groupBy("seller_id").agg(F.sum("qty").alias("q"))
    # A NULL seller does not survive the join of blocks by equality; the one-pass form keeps its row.
    want = marts.entity_summary(base, [scored, total], "seller_id").filter("seller_id IS NOT NULL")
    assert rows(got.filter("seller_id IS NOT NULL")) == rows(want)


def test_rollup_leaves_null_without_children(spark):
    parent = spark.createDataFrame([(1,), (2,)], "k int")
    child = spark.createDataFrame([(1, 5), (1, 6), (3, 1)], "k int, v int")
    out = marts.rollup_to_parent(parent, child, "k", {"total": F.sum("v")})
    assert rows(out) == [(1, 11), (2, None)]


def test_aqe_can_split_a_hot_key_of_a_join_of_plain_inputs(spark):
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "16",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "false",
    }
    before = {k: spark.conf.get(k, None) for k in small}
    items = spark.range(0, 600_000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("order_id"),
        (F.col("id") % 5).alias("seller_id"),
        F.pmod(F.xxhash64("id"), F.lit(1_000_000_007)).alias("x"),  # incompressible, so that sizes show
    )
    orders = spark.range(600_000).withColumnRenamed("id", "order_id")
    sellers = spark.range(5).select(F.col("id").alias("seller_id"), (F.col("id") % 2).alias("state"))
    links = [Link(orders, "order_id", unique=True), Link(sellers, "seller_id", unique=True)]
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        got = star.star_fold(items, links, ["state"], ["x"])
        assert sorted(r[1] for r in got.collect()) == [240_000, 360_000]
        assert "skew=true" in got._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
