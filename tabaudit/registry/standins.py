"""Domain tables made from the given tables by deterministic expressions, with planted defects.

Each template is plain SQL that both engines understand; the operators then run on the result. Nothing is
invented: every row comes from a row of ``orders``, ``lineitem``, ``customer``, ``supplier`` or ``part``.
"""

from __future__ import annotations

from tabaudit.registry.core import Dialect

# --- missing values planted in the given tables --------------------------------------------------


def gappy_events(d: Dialect) -> str:
    """Events with blank types, and their time as text, blank for some."""
    return f"""
    SELECT event_id, user_id, value,
           CASE WHEN event_id % 7 = 0 THEN '' ELSE event_type END AS event_type,
           CASE WHEN event_id % 11 = 0 THEN ''
                WHEN event_id % 13 = 0 THEN 'unknown'
                ELSE {d.time_text("ts")} END AS ts_text
    FROM {{events}}"""


def aged_orders(d: Dialect) -> str:
    """Orders with a signed day offset; a magic number stands for 'does not apply'."""
    return """
    SELECT o_orderkey, o_custkey, o_orderpriority, o_totalprice,
           CASE WHEN o_orderkey % 11 = 0 THEN 365243
                ELSE -CAST(1 + (o_orderkey * 37 + o_custkey) % 20000 AS INT) END AS day_age
    FROM {orders}"""


def deliveries(d: Dialect) -> str:
    """Line items with the promise and the outcome of their order; some have no promise."""
    return f"""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, o_custkey, o_orderstatus, o_orderdate,
           CAST(o_totalprice AS DECIMAL(18,2)) AS o_totalprice,
           CASE WHEN o_orderkey % 301 = 5 THEN NULL ELSE {d.plus("o_orderdate", "DAY", "40")} END AS promised,
           CASE WHEN o_orderstatus = 'P' THEN NULL
                ELSE {d.plus("l_shipdate", "HOUR", "l_linenumber")} END AS actual
    FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey"""


# --- lending -------------------------------------------------------------------------------------


def applications(d: Dialect) -> str:
    """One loan application per order: 25 columns in the declared types."""
    return """
    SELECT CAST(o_orderkey AS INT) AS sk_id_curr,
           CAST(CASE WHEN (o_orderkey * 7 + o_custkey) % 12 = 0 THEN 1 ELSE 0 END AS INT) AS target,
           CASE WHEN o_orderkey % 10 = 3 THEN 'Revolving loans' ELSE 'Cash loans' END AS name_contract_type,
           CAST(o_totalprice AS DECIMAL(15,4)) AS amt_credit,
           CAST(CASE o_orderkey % 50 WHEN 0 THEN 112500 WHEN 1 THEN 202500 WHEN 2 THEN 472500
                    WHEN 3 THEN 900000 WHEN 4 THEN 950000
                    ELSE CAST(floor(o_totalprice) AS BIGINT) + 27000 END AS DECIMAL(15,4)) AS amt_income_total,
           CAST(CASE WHEN o_orderkey % 97 = 5 THEN NULL
                     ELSE CAST(floor(o_totalprice / 5) AS BIGINT) + 2000 END AS DECIMAL(15,4)) AS amt_annuity,
           CAST(CASE WHEN o_orderkey % 10 = 3 AND o_orderkey % 4 = 1 THEN NULL
                     ELSE CAST(floor(o_totalprice * 0.8) AS BIGINT) + (o_orderkey % 7) * 5000
                     END AS DECIMAL(15,4)) AS amt_goods_price,
           CASE WHEN o_orderkey % 400 = 7 THEN 'XNA' WHEN o_orderkey % 3 = 0 THEN 'M' ELSE 'F' END AS code_gender,
           -CAST(7500 + (o_orderkey * 31) % 17500 AS INT) AS days_birth,
           CASE o_orderkey % 5 WHEN 0 THEN 'Higher education' WHEN 1 THEN 'Incomplete higher'
                WHEN 2 THEN 'Lower secondary' WHEN 3 THEN 'Academic degree'
                ELSE 'Secondary / secondary special' END AS name_education_type,
           CASE WHEN o_orderkey % 500 = 11 THEN 'Unknown' WHEN o_custkey % 3 = 0 THEN 'Married'
                WHEN o_custkey % 3 = 1 THEN 'Widow' ELSE 'Separated' END AS name_family_status,
           CASE o_custkey % 4 WHEN 0 THEN 'Working' WHEN 1 THEN 'State servant' WHEN 2 THEN 'Pensioner'
                ELSE 'Commercial associate' END AS name_income_type,
           CASE WHEN o_custkey % 6 < 3 THEN 'House / apartment' WHEN o_custkey % 6 = 3 THEN 'Rented apartment'
                WHEN o_custkey % 6 = 4 THEN 'With parents' ELSE 'Office apartment' END AS name_housing_type,
           CAST(CASE WHEN o_orderkey % 700 = 13 THEN 11 WHEN o_orderkey % 700 = 14 THEN 10
                     ELSE o_orderkey % 4 END AS TINYINT) AS cnt_children,
           CAST(CASE WHEN o_orderkey % 600 = 17 THEN NULL ELSE 1 + o_orderkey % 5 END AS DECIMAL(5,1))
               AS cnt_fam_members,
           CASE WHEN o_orderkey % 3 = 1 THEN 'Y' ELSE 'N' END AS flag_own_car,
           CASE WHEN o_custkey % 2 = 1 THEN 'Y' ELSE 'N' END AS flag_own_realty,
           CAST(CASE WHEN o_orderkey % 3 = 1 THEN o_orderkey % 20 ELSE NULL END AS DECIMAL(5,1)) AS own_car_age,
           CASE WHEN o_orderkey % 6 = 5 THEN 365243
                ELSE -CAST(100 + (o_orderkey * 13) % 9000 AS INT) END AS days_employed,
           CASE o_orderkey % 6 WHEN 0 THEN 'Laborers' WHEN 1 THEN 'Drivers' WHEN 3 THEN 'Managers'
                WHEN 4 THEN 'Cooking staff' ELSE NULL END AS occupation_type,
           concat('Type ', CAST(CASE WHEN o_custkey % 40 < 30 THEN o_custkey % 5 ELSE o_custkey % 40 END AS STRING))
               AS organization_type,
           CAST(CASE WHEN o_orderkey % 200 = 9 THEN NULL ELSE ((o_orderkey * 17) % 1000) / 1000.0 END AS FLOAT)
               AS ext_source_2,
           CAST(CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE ((o_orderkey * 29) % 1000) / 1000.0 END AS FLOAT)
               AS ext_source_3,
           CAST(1 + o_orderkey % 3 AS TINYINT) AS region_rating_client,
           CAST(1 + (o_orderkey + o_custkey) % 3 AS TINYINT) AS region_rating_client_w_city
    FROM {orders}"""


# --- marketplace ---------------------------------------------------------------------------------


def customers(d: Dialect) -> str:
    return """
    SELECT c_custkey AS customer_id, c_name AS customer_unique_id, n_name AS customer_state
    FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey"""


def sellers(d: Dialect) -> str:
    return """
    SELECT s_suppkey AS seller_id, s_name AS seller_city, n_name AS seller_state
    FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey"""


_CATEGORY = """CASE p_brand WHEN 'Brand#1' THEN 'pc_gamer'
                WHEN 'Brand#2' THEN 'portateis_cozinha_e_preparadores_de_alimentos' ELSE p_brand END"""


def products(d: Dialect) -> str:
    return f"""
    SELECT p_partkey AS product_id,
           CASE WHEN p_partkey % 50 = 7 THEN '' ELSE {_CATEGORY} END AS product_category_name,
           CAST(CASE WHEN p_partkey % 300 = 1 THEN 0 ELSE p_size * 100 END AS DECIMAL(10,2)) AS product_weight_g,
           CAST(CASE WHEN p_partkey % 900 = 2 THEN 0 ELSE p_size END AS DECIMAL(10,2)) AS product_length_cm,
           CAST(CASE WHEN p_partkey % 900 = 2 THEN 0 ELSE 51 - p_size END AS DECIMAL(10,2)) AS product_height_cm
    FROM {{part}}"""


def product_category(d: Dialect) -> str:
    return """
    SELECT DISTINCT p_brand AS product_category_name, concat('Category ', p_brand) AS product_category_name_english
    FROM {part} WHERE p_brand NOT IN ('Brand#1', 'Brand#2')"""


def marketplace_orders(d: Dialect) -> str:
    bought = d.plus("o_orderdate", "HOUR", "o_orderkey % 24")
    arrived = d.plus(d.plus("o_orderdate", "DAY", "5 + (o_orderkey * 13) % 53"), "HOUR", "o_orderkey % 24")
    return f"""
    SELECT o_orderkey AS order_id, o_custkey AS customer_id,
           CASE WHEN o_orderkey % 50 = 49 THEN 'canceled' WHEN o_orderkey % 20 = 6 THEN 'shipped'
                ELSE 'delivered' END AS order_status,
           {d.time_text(bought)} AS order_purchase_timestamp,
           CASE WHEN o_orderkey % 90 = 1 THEN '' ELSE {d.time_text(d.plus(bought, "MINUTE", "17"))} END
               AS order_approved_at,
           CASE WHEN o_orderkey % 20 = 6 THEN '' ELSE {d.time_text(d.plus(bought, "DAY", "2"))} END
               AS order_delivered_carrier_date,
           CASE WHEN o_orderkey % 20 = 6 OR o_orderkey % 400 = 3 OR o_orderkey % 100 = 49 THEN ''
                ELSE {d.time_text(arrived)} END AS order_delivered_customer_date,
           {d.time_text(d.plus("o_orderdate", "DAY", "40"))} AS order_estimated_delivery_date
    FROM {{orders}}"""


def order_items(d: Dialect) -> str:
    return f"""
    SELECT l_orderkey AS order_id, CAST(l_linenumber AS TINYINT) AS order_item_id,
           l_partkey AS product_id, l_suppkey AS seller_id,
           {d.time_text("l_shipdate")} AS shipping_limit_date,
           CAST(CASE WHEN l_linenumber = 7 AND l_orderkey % 100 = 0 THEN 0 ELSE l_extendedprice END
                AS DECIMAL(10,2)) AS price,
           CAST(l_quantity * 25 AS DECIMAL(10,2)) AS freight_value
    FROM {{lineitem}}"""


def order_payments(d: Dialect) -> str:
    kind = """CASE WHEN o_orderkey % 500 = 77 THEN 'not_defined' WHEN o_orderkey % 4 < 2 THEN 'credit_card'
                WHEN o_orderkey % 4 = 2 THEN 'boleto' ELSE 'debit_card' END"""
    return f"""
    SELECT o_orderkey AS order_id, {kind} AS payment_type,
           CAST(1 + o_orderkey % 12 AS TINYINT) AS payment_installments,
           CAST(o_totalprice AS DECIMAL(10,2)) AS payment_value
    FROM {{orders}} WHERE o_orderkey % 60 <> 59
    UNION ALL
    SELECT o_orderkey, 'voucher', CAST(1 AS TINYINT), CAST(floor(o_totalprice / 10) AS DECIMAL(10,2))
    FROM {{orders}} WHERE o_orderkey % 60 <> 59 AND o_orderkey % 4 = 0"""


def order_reviews(d: Dialect) -> str:
    return f"""
    SELECT l_orderkey AS order_id, CAST(1 + CAST(floor(l_quantity) AS INT) % 5 AS TINYINT) AS review_score,
           {d.time_text("l_shipdate")} AS review_creation_date
    FROM {{lineitem}}"""


MARKETPLACE = {
    "customers": customers,
    "sellers": sellers,
    "products": products,
    "product_category": product_category,
    "orders": marketplace_orders,
    "order_items": order_items,
    "order_payments": order_payments,
    "order_reviews": order_reviews,
}
