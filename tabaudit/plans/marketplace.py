"""Marketplace delivery, satisfaction and revenue risk: eight tables, from landed text to a seller mart.

``Tables`` holds the frames. ``clean`` corrects and derives, ``verify`` audits, ``seller_summary`` builds the
mart, and ``REPORTS`` holds every segment query.

Semantics kept on purpose:

* late means later than the promised *timestamp*; the variance compares *dates*. A delivery on the promised
  day is late with variance 0 when the promise is midnight.
* "orders" in reports that start from items are item rows, and payments and reviews fan out.
* seller revenue counts an order's payments once per item row of the seller (``fan_out``).
* the mart lists sellers with at least one paid order.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabaudit.functions import columns as C
from tabaudit.operators import clean as fix
from tabaudit.operators import derive, integrity, marts, profile, segment
from tabaudit.operators.star import Link
from tabaudit.sources import Contract, read_csv_typed

_MONEY = T.DecimalType(10, 2)
_TEXT = T.StringType()


def _schema(*columns: tuple) -> T.StructType:
    """Columns as ``(name, type)``; a third entry ``True`` allows NULL."""
    return T.StructType([T.StructField(c[0], c[1], len(c) > 2 and c[2]) for c in columns])


CONTRACTS: dict[str, Contract] = {
    "customers": Contract(
        _schema(("customer_id", _TEXT), ("customer_unique_id", _TEXT), ("customer_state", _TEXT)),
        ("customer_id",),
    ),
    "sellers": Contract(
        _schema(("seller_id", _TEXT), ("seller_city", _TEXT), ("seller_state", _TEXT)), ("seller_id",)
    ),
    "products": Contract(
        _schema(
            ("product_id", _TEXT),
            ("product_category_name", _TEXT, True),
            ("product_weight_g", _MONEY, True),
            ("product_length_cm", _MONEY, True),
            ("product_height_cm", _MONEY, True),
        ),
        ("product_id",),
    ),
    "product_category": Contract(
        _schema(("product_category_name", _TEXT), ("product_category_name_english", _TEXT)),
        ("product_category_name",),
    ),
    "orders": Contract(
        _schema(
            ("order_id", _TEXT),
            ("customer_id", _TEXT),
            ("order_status", _TEXT),
            ("order_purchase_timestamp", _TEXT),
            ("order_approved_at", _TEXT, True),
            ("order_delivered_carrier_date", _TEXT, True),
            ("order_delivered_customer_date", _TEXT, True),
            ("order_estimated_delivery_date", _TEXT),
        ),
        ("order_id",),
    ),
    "order_items": Contract(
        _schema(
            ("order_id", _TEXT),
            ("order_item_id", T.ByteType()),
            ("product_id", _TEXT),
            ("seller_id", _TEXT),
            ("shipping_limit_date", _TEXT),
            ("price", _MONEY),
            ("freight_value", _MONEY),
        )
    ),
    "order_payments": Contract(
        _schema(
            ("order_id", _TEXT),
            ("payment_type", _TEXT),
            ("payment_installments", T.ByteType()),
            ("payment_value", _MONEY),
        )
    ),
    "order_reviews": Contract(
        _schema(("order_id", _TEXT), ("review_score", T.ByteType()), ("review_creation_date", _TEXT))
    ),
}


@dataclass(frozen=True)
class Tables:
    customers: DataFrame
    sellers: DataFrame
    products: DataFrame
    product_category: DataFrame
    orders: DataFrame
    order_items: DataFrame
    order_payments: DataFrame
    order_reviews: DataFrame

    def items(self):
        return [(f.name, getattr(self, f.name)) for f in fields(self)]


@dataclass(frozen=True)
class Settings:
    """Fixed values of the domain. ``late_cut`` and ``score_cut`` override the computed benchmarks."""

    delivered: str = "delivered"
    payment_sentinel: str = "not_defined"
    overrides: tuple = (
        ("pc_gamer", "PC Gaming"),
        ("portateis_cozinha_e_preparadores_de_alimentos", "Portable Kitchen Appliances"),
    )
    variance_ranges: tuple = (
        (None, -15, "Early by more than 14+ days"),
        (-14, -1, "Early by 1-14 days"),
        (0, 0, "On time"),
        (1, 7, "Late by 1-7 days"),
        (8, 14, "Late by 8-14 days"),
        (15, None, "Late by 14+ days"),
    )
    trend_start: str = "2017-01-01"
    trend_end: str = "2018-08-31"
    min_volume: int = 100
    min_orders: int = 10
    top_sellers: int = 10
    volume_edges: tuple = (50,)
    volume_labels: tuple = ("Low Volume (10-49 orders)", "High Volume (50+ orders)")
    late_cut: float | None = None
    score_cut: float | None = None


DEFAULTS = Settings()

ORDER_TIMES = (
    "order_purchase_timestamp",
    "order_approved_at",
    "order_delivered_carrier_date",
    "order_delivered_customer_date",
    "order_estimated_delivery_date",
)
OPTIONAL_TIMES = ORDER_TIMES[1:4]
DISTRIBUTIONS = (
    ("orders", "order_status"),
    ("order_payments", "payment_type"),
    ("customers", "customer_state"),
    ("sellers", "seller_state"),
    ("products", "product_category_name"),
)


def load(spark: SparkSession, paths: Mapping[str, str]) -> Tables:
    return Tables(**{name: read_csv_typed(spark, paths[name], c.schema) for name, c in CONTRACTS.items()})


# --- observe -------------------------------------------------------------------------------------


def table_sizes(t: Tables) -> DataFrame:
    return profile.row_counts(dict(t.items()))


def relations(t: Tables) -> list[integrity.Relation]:
    return [
        integrity.Relation("orders_to_customers", t.orders, t.customers, "customer_id"),
        integrity.Relation("items_to_orders", t.order_items, t.orders, "order_id"),
        integrity.Relation("items_to_products", t.order_items, t.products, "product_id"),
        integrity.Relation("items_to_sellers", t.order_items, t.sellers, "seller_id"),
        integrity.Relation("reviews_to_orders", t.order_reviews, t.orders, "order_id"),
        integrity.Relation("payments_to_orders", t.order_payments, t.orders, "order_id"),
    ]


def referential_audit(t: Tables) -> DataFrame:
    return integrity.referential_audit(relations(t))


def defects(s: Settings = DEFAULTS) -> dict[str, dict[str, Column]]:
    """Suspect values per table, counted before and after the corrections."""
    return {
        "products": {
            "blank_category": F.col("product_category_name") == "",
            "null_category": F.col("product_category_name").isNull(),
            "zero_weight": F.col("product_weight_g") == 0,
            "null_weight": F.col("product_weight_g").isNull(),
            "zero_length": F.col("product_length_cm") == 0,
            "null_length": F.col("product_length_cm").isNull(),
            "zero_height": F.col("product_height_cm") == 0,
            "null_height": F.col("product_height_cm").isNull(),
        },
        "order_payments": {
            "undefined_type": F.col("payment_type") == s.payment_sentinel,
            "null_type": F.col("payment_type").isNull(),
        },
        "orders": {f"null_{c}": F.col(c).isNull() for c in OPTIONAL_TIMES},
    }


def correction_audit(before: Tables, after: Tables, table: str, s: Settings = DEFAULTS) -> DataFrame:
    return profile.change_audit(getattr(before, table), getattr(after, table), defects(s)[table])


def distributions(t: Tables) -> dict[str, DataFrame]:
    return {col: profile.value_distribution(getattr(t, table), col) for table, col in DISTRIBUTIONS}


def time_formats(t: Tables) -> DataFrame:
    """Do the landed order times have the timestamp form?"""
    return profile.format_conformance(t.orders, ORDER_TIMES)


def baseline(t: Tables, rounded: bool = True) -> DataFrame:
    """Average score, total revenue and average order value, one row."""
    digits = 2 if rounded else None
    score = t.order_reviews.agg(segment.mean_expr("review_score", digits).alias("x")).scalar()
    value = profile.mean_of_group_totals(t.order_payments, "order_id", "payment_value", digits).scalar()
    return (
        t.order_payments.agg(F.sum("payment_value").alias("total_revenue"))
        .withColumn("avg_review_score", score)
        .withColumn("avg_order_value", value)
    )


# --- clean ---------------------------------------------------------------------------------------


def clean_products(products: DataFrame, lookup: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    out = fix.blank_to_null(products, ["product_category_name"])
    sizes = ("product_weight_g", "product_length_cm", "product_height_cm")
    out = fix.sentinel_to_null(out, {c: [0] for c in sizes})
    out = fix.null_flag(out, "product_category_name", "flag_null_category")
    out = fix.null_flag(out, "product_weight_g", "flag_suspect_weight")
    return derive.translate_lookup(
        out,
        lookup,
        "product_category_name",
        "product_category_name_english",
        "product_category_english",
        dict(s.overrides),
    )


def clean_orders(orders: DataFrame) -> DataFrame:
    """Blank times to NULL, text to timestamps, late flag and day variance. One projection."""
    out = fix.blank_to_null(orders, OPTIONAL_TIMES)
    out = derive.to_timestamps(out, ORDER_TIMES)
    actual, promised = "order_delivered_customer_date", "order_estimated_delivery_date"
    out = derive.outcome_flag(out, actual, promised, "is_late_delivery")
    out = derive.day_variance(out, actual, promised, "delivery_days_variance")
    return out.withColumn("delivery_days_variance", F.col("delivery_days_variance").cast("decimal(6,1)"))


def clean_items(items: DataFrame) -> DataFrame:
    out = derive.to_timestamps(items, ["shipping_limit_date"])
    return derive.guarded_ratio(out, "freight_value", "price", "freight_ratio")


def clean_payments(payments: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    return fix.sentinel_to_null(payments, {"payment_type": [s.payment_sentinel]})


def clean_reviews(reviews: DataFrame) -> DataFrame:
    """Newest review per order, ties by the higher score; dates become timestamps."""
    newest = fix.dedupe_latest(reviews, "order_id", ["review_creation_date", "review_score"])
    return derive.to_timestamps(newest, ["review_creation_date"])


def attach_revenue(orders: DataFrame, payments: DataFrame) -> DataFrame:
    total = F.sum("payment_value")
    return marts.rollup_to_parent(orders, payments, "order_id", {"order_revenue": total})


def clean(t: Tables, s: Settings = DEFAULTS) -> Tables:
    payments = clean_payments(t.order_payments, s)
    return replace(
        t,
        products=clean_products(t.products, t.product_category, s),
        orders=attach_revenue(clean_orders(t.orders), payments),
        order_items=clean_items(t.order_items),
        order_payments=payments,
        order_reviews=clean_reviews(t.order_reviews),
    )


# --- verify --------------------------------------------------------------------------------------


def verify(t: Tables, table: str) -> DataFrame:
    """NULLs, flags and derived columns of one cleaned table in one scan."""
    checks = {
        "products": {
            "null_categories": F.col("flag_null_category") == 1,
            "suspect_weights": F.col("flag_suspect_weight") == 1,
            "null_lengths": F.col("product_length_cm").isNull(),
            "null_heights": F.col("product_height_cm").isNull(),
            "translated": F.col("product_category_english").isNotNull(),
            "untranslated": F.col("product_category_english").isNull()
            & F.col("product_category_name").isNotNull(),
        },
        "orders": {
            **{f"null_{c}": F.col(c).isNull() for c in OPTIONAL_TIMES},
            "late": F.col("is_late_delivery") == 1,
            "in_time": F.col("is_late_delivery") == 0,
            "no_outcome": F.col("is_late_delivery").isNull(),
            "no_variance": F.col("delivery_days_variance").isNull(),
        },
        "order_items": {
            "null_shipping_limit": F.col("shipping_limit_date").isNull(),
            "null_freight_ratio": F.col("freight_ratio").isNull(),
            "unfit_freight_ratio": F.col("freight_ratio").isNull() & (F.col("price") != 0),
        },
        "order_payments": {"null_payment_type": F.col("payment_type").isNull()},
        "order_reviews": {"null_review_date": F.col("review_creation_date").isNull()},
    }
    return profile.audit(getattr(t, table), counts=checks[table])


def review_duplicates(t: Tables) -> DataFrame:
    return profile.duplicate_key_count(t.order_reviews, "order_id")


def variance_profile(t: Tables, rounded: bool = True) -> DataFrame:
    return profile.numeric_profile(t.orders, {"delivery_days_variance": 1 if rounded else None})


def late_orders(t: Tables, rounded: bool = True) -> DataFrame:
    """How many orders were late, by how many days on average, and at most."""
    days = "delivery_days_variance"
    metrics = {
        "late_orders": F.count("*"),
        "avg_days_late": segment.mean_expr(days, 1 if rounded else None),
        "max_days_late": F.max(days),
    }
    return segment.profile_metrics(t.orders, [F.col("is_late_delivery") == 1], metrics)


def freight_profile(t: Tables, rounded: bool = True) -> DataFrame:
    return profile.numeric_profile(t.order_items, {"freight_ratio": 4 if rounded else None})


def revenue_reconciliation(t: Tables) -> DataFrame:
    """Revenue attached to orders against revenue in the payments."""
    left, right = F.sum("order_revenue"), F.sum("payment_value")
    return integrity.reconcile_total(t.orders, t.order_payments, left, right)


def revenue_gaps(t: Tables) -> DataFrame:
    """Payment rows whose order got no revenue; 0 when the roll-up is complete."""
    return integrity.missing_after_join(t.orders, t.order_payments, "order_id", "order_revenue")


# --- mart ----------------------------------------------------------------------------------------


def seller_summary(t: Tables, s: Settings = DEFAULTS, fan_out: bool = True) -> DataFrame:
    """One row per seller with a paid order: volume, revenue, late rate, score, freight ratio.

    Orders, reviews and payments meet the items in one pass; the rates are rounded because the tiers
    compare the rounded values.
    """
    blocks = {
        "paid": marts.Block(t.order_payments, "order_id", ["payment_value"], required=True),
        "delivered": marts.Block(
            t.orders, "order_id", ["is_late_delivery"], F.col("order_status") == s.delivered
        ),
        "reviewed": marts.Block(t.order_reviews, "order_id", ["review_score"]),
    }
    folded = marts.bridged_summary(
        t.order_items, "seller_id", "order_id", blocks, ["freight_ratio"], fan_out
    )

    def rounded_mean(prefix: str, digits: int) -> Column:
        return C.exact_mean(F.col(f"{prefix}_sum"), F.col(f"{prefix}_count"), digits)

    return folded.select(
        "seller_id",
        F.col("paid_keys").alias("total_orders"),
        F.col("paid_payment_value_sum").alias("total_revenue"),
        rounded_mean("delivered_is_late_delivery", 4).alias("late_delivery_rate"),
        rounded_mean("reviewed_review_score", 2).alias("avg_review_score"),
        rounded_mean("freight_ratio", 4).alias("avg_freight_ratio"),
    )


def benchmarks(t: Tables, s: Settings = DEFAULTS) -> tuple[Column, Column]:
    """Late rate of delivered orders (4 digits) and mean score (2 digits), or the overrides."""
    late, score = F.lit(s.late_cut), F.lit(s.score_cut)
    if s.late_cut is None:
        flag = "is_late_delivery"
        rate = C.exact_mean(F.sum(flag), F.count(flag), 4).alias("x")
        late = t.orders.filter(F.col("order_status") == s.delivered).agg(rate).scalar()
    if s.score_cut is None:
        average = C.exact_mean(F.sum("review_score"), F.count("review_score"), 2).alias("x")
        score = t.order_reviews.agg(average).scalar()
    return late, score


# --- segment -------------------------------------------------------------------------------------

Digits = Callable[[int], "int | None"]


@dataclass(frozen=True)
class Context:
    """What a report reads: cleaned tables, the seller mart, the two benchmarks and the settings."""

    tables: Tables
    sellers: DataFrame
    late_cut: Column
    score_cut: Column
    settings: Settings = DEFAULTS


def context(t: Tables, mart: DataFrame | None = None, s: Settings = DEFAULTS) -> Context:
    """``mart`` is the stored seller summary; without one it is planned into each report."""
    late, score = benchmarks(t, s)
    return Context(t, seller_summary(t, s) if mart is None else mart, late, score, s)


def _delivered(c: Context) -> Column:
    return F.col("order_status") == c.settings.delivered


def _order_link(c: Context, where: Column | None = None) -> Link:
    return Link(c.tables.orders, "order_id", where=where, unique=True)


def _product_link(c: Context) -> Link:
    return Link(c.tables.products, "product_id", where=F.col("flag_null_category") == 0, unique=True)


def _seller_link(c: Context) -> Link:
    return Link(c.tables.sellers, "seller_id", unique=True)


def _customer_link(c: Context) -> Link:
    return Link(c.tables.customers, "customer_id", unique=True)


def _headline(c, digits):
    return segment.outcome_headline(c.tables.orders, "is_late_delivery", _delivered(c), digits(2))


def _by_status(c, digits):
    return segment.rate_by(c.tables.orders, "order_status", "is_late_delivery", None, digits(2)).orderBy(
        F.desc("volume"), "order_status"
    )


def _late_by_customer_state(c, digits):
    return segment.joined_rate(
        c.tables.orders, [_customer_link(c)], "customer_state", "is_late_delivery",
        c.settings.min_volume, where=_delivered(c), scale=digits(2),
    )


def _late_by_seller_state(c, digits):
    links = [_order_link(c, _delivered(c)), _seller_link(c)]
    return segment.joined_rate(
        c.tables.order_items, links, "seller_state", "is_late_delivery", c.settings.min_volume, scale=digits(2)
    )


def _late_by_category(c, digits):
    links = [_order_link(c, _delivered(c)), _product_link(c)]
    return segment.joined_rate(
        c.tables.order_items, links, "product_category_english", "is_late_delivery",
        c.settings.min_volume, scale=digits(2),
    )


def _variance_bands(c, digits):
    known = c.tables.orders.filter(F.col("delivery_days_variance").isNotNull())
    banded = derive.band_closed(known, "delivery_days_variance", c.settings.variance_ranges, "variance_band")
    return segment.share_distribution(banded, "variance_band", "delivery_days_variance", scale=digits(2))


def _trend(c, digits):
    s = c.settings
    return segment.monthly_trend(
        c.tables.orders, "order_purchase_timestamp", "is_late_delivery", s.trend_start, s.trend_end,
        _delivered(c), digits(2),
    )


def _score_share(c, digits):
    return segment.share_distribution(c.tables.order_reviews, "review_score", scale=digits(2))


def _score_by_outcome(c, digits):
    return segment.joined_mean(
        c.tables.order_reviews, [_order_link(c)], "is_late_delivery", "review_score", scale=digits(2)
    ).orderBy("is_late_delivery")


def _score_by_category(c, digits):
    links = [Link(c.tables.order_reviews, "order_id"), _product_link(c)]
    return segment.joined_mean(
        c.tables.order_items, links, "product_category_english", "review_score",
        c.settings.min_volume, scale=digits(2),
    )


def _score_by_customer_state(c, digits):
    links = [_order_link(c), _customer_link(c)]
    return segment.joined_mean(
        c.tables.order_reviews, links, "customer_state", "review_score", c.settings.min_volume, scale=digits(2)
    )


def _score_by_payment(c, digits):
    links = [Link(c.tables.order_payments, "order_id", where=F.col("payment_type").isNotNull())]
    return segment.joined_mean(
        c.tables.order_reviews, links, "payment_type", "review_score", scale=digits(2)
    )


def _totals(c, digits):
    return profile.baseline_metrics(
        c.tables.orders,
        {
            "total_revenue": F.sum("order_revenue"),
            "avg_order_value": segment.mean_expr("order_revenue", digits(2)),
        },
    )


def _revenue_by_category(c, digits):
    # The revenue may be planned in rather than stored; then orders are already joined on their key.
    links = [Link(c.tables.orders, "order_id"), _product_link(c)]
    return segment.joined_total(
        c.tables.order_items, links, "product_category_english", "order_revenue",
        c.settings.min_volume, scale=digits(2),
    )


def _revenue_by_customer_state(c, digits):
    return segment.joined_total(
        c.tables.orders, [_customer_link(c)], "customer_state", "order_revenue",
        c.settings.min_volume, scale=digits(2),
    )


def _enough_orders(c: Context) -> Column:
    return F.col("total_orders") >= c.settings.min_orders


def _at_risk(c: Context) -> Column:
    return C.in_every(
        _enough_orders(c), F.col("late_delivery_rate") > c.late_cut, F.col("avg_review_score") < c.score_cut
    )


def _top_sellers(c, digits):
    top = segment.top_entities(c.sellers, "seller_id", "total_revenue", c.settings.top_sellers, _enough_orders(c))
    return top.drop("avg_freight_ratio").withColumn("late_delivery_rate", F.col("late_delivery_rate") * 100)


def _performance_tiers(c, digits):
    late, score = F.col("late_delivery_rate"), F.col("avg_review_score")
    reliable, satisfying = late <= c.late_cut, score >= c.score_cut
    rules = [
        (late.isNull() | score.isNull(), "Insufficient Data"),
        (reliable & satisfying, "High reliability / High satisfaction"),
        (reliable, "High reliability / Low satisfaction"),
        (satisfying, "Low reliability / High satisfaction"),
    ]
    return segment.compare_profiles(
        c.sellers, rules, "Low reliability / Low satisfaction", {"seller_count": F.count("*")},
        "performance_tier", _enough_orders(c),
    )


def _rate_in_percent(digits: Digits) -> Column:
    return segment.mean_expr(F.col("late_delivery_rate") * 100, digits(2))


def _volume_tiers(c, digits):
    metrics = {
        "late_delivery_rate": _rate_in_percent(digits),
        "avg_review": segment.mean_expr("avg_review_score", digits(2)),
    }
    s = c.settings
    return segment.tier_compare(
        c.sellers, "total_orders", s.volume_edges, s.volume_labels, metrics, _enough_orders(c), "volume_tier"
    )


def _high_risk_sellers(c, digits):
    metrics = {
        "high_risk_seller_count": F.count("*"),
        "combined_revenue": F.sum("total_revenue"),
        "combined_late_delivery_rate": _rate_in_percent(digits),
        "combined_avg_review_score": segment.mean_expr("avg_review_score", digits(2)),
    }
    return segment.profile_metrics(c.sellers, [_at_risk(c)], metrics)


def _category_risk(c, digits):
    links = [_order_link(c, _delivered(c)), _product_link(c)]
    return segment.joined_rate(
        c.tables.order_items, links, "product_category_english", "is_late_delivery", c.settings.min_volume,
        inclusive=True, scale=digits(2), means={"freight_ratio": digits(4)},
    )


def _category_by_state(c, digits):
    links = [
        _order_link(c, _delivered(c)),
        Link(c.tables.order_reviews, "order_id"),
        _product_link(c),
        _seller_link(c),
    ]
    return segment.joined_multi(
        c.tables.order_items, links, ["product_category_english", "seller_state"],
        {"is_late_delivery": digits(2)}, {"review_score": digits(2)}, c.settings.min_volume,
    )


def _revenue_at_risk(c, digits):
    return segment.share_of_total(c.sellers, "total_revenue", _at_risk(c), digits(2))


Report = Callable[[Context, Digits], DataFrame]

REPORTS: dict[str, Report] = {
    "headline": _headline,
    "by_status": _by_status,
    "late_by_customer_state": _late_by_customer_state,
    "late_by_seller_state": _late_by_seller_state,
    "late_by_category": _late_by_category,
    "variance_bands": _variance_bands,
    "monthly_trend": _trend,
    "score_share": _score_share,
    "score_by_outcome": _score_by_outcome,
    "score_by_category": _score_by_category,
    "score_by_customer_state": _score_by_customer_state,
    "score_by_payment": _score_by_payment,
    "totals": _totals,
    "revenue_by_category": _revenue_by_category,
    "revenue_by_customer_state": _revenue_by_customer_state,
    "top_sellers": _top_sellers,
    "performance_tiers": _performance_tiers,
    "volume_tiers": _volume_tiers,
    "high_risk_sellers": _high_risk_sellers,
    "category_risk": _category_risk,
    "category_by_state": _category_by_state,
    "revenue_at_risk": _revenue_at_risk,
}


def report(c: Context, name: str, rounded: bool = True) -> DataFrame:
    """One named report; ``rounded=False`` keeps full precision."""
    return REPORTS[name](c, (lambda n: n) if rounded else (lambda n: None))
