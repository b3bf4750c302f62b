"""Both plans end to end, from CSV files with planted defects of known number."""

import random

import pytest
from pyspark.sql import functions as F

from tabaudit.operators import profile
from tabaudit.plans import lending, marketplace
from tabaudit.sources import check_contract, materialize, read_csv_typed

# --- lending -------------------------------------------------------------------------------------

HEADER = ["EXTRA_1", *[f.name.upper() for f in lending.SCHEMA.fields], "EXTRA_2"]


def application(i, **changed):
    base = {
        "sk_id_curr": i,
        "target": int(i % 12 == 0),
        "name_contract_type": "Cash loans",
        "amt_credit": 200000 + i,
        "amt_income_total": 150000,
        "amt_annuity": 20000 + i,
        "amt_goods_price": 180000,
        "code_gender": "F" if i % 2 else "M",
        "days_birth": -(8000 + 53 * i),
        "name_education_type": "Higher education",
        "name_family_status": "Married",
        "name_income_type": "Working",
        "name_housing_type": "House / apartment",
        "cnt_children": i % 3,
        "cnt_fam_members": "2.0",
        "flag_own_car": "N",
        "flag_own_realty": "Y",
        "own_car_age": "",
        "days_employed": -1000,
        "occupation_type": "Laborers",
        "organization_type": "School" if i % 2 else "Bank",
        "ext_source_2": 0.5,
        "ext_source_3": 0.4,
        "region_rating_client": 1 + i % 3,
        "region_rating_client_w_city": 2,
    }
    return {**base, **changed}


def applications():
    rows = [application(i) for i in range(1, 201)]
    rows[0].update(code_gender="XNA")
    rows[1].update(name_family_status="Unknown")
    rows[2].update(cnt_children=10)
    rows[3].update(cnt_children=11)
    rows[4].update(amt_income_total=900000)
    rows[5].update(amt_income_total="900000.01")
    rows[6].update(amt_annuity="")
    rows[7].update(name_contract_type="Revolving loans", amt_goods_price="")
    rows[8].update(cnt_fam_members="")
    rows[9].update(occupation_type="")
    rows[10].update(ext_source_2="", ext_source_3="")
    rows[11].update(days_employed=365243)
    rows[12].update(flag_own_car="Y", own_car_age="7.0")
    for i, income in enumerate((112499, 112500, 202499, 202500, 472499, 472500)):
        rows[20 + i].update(amt_income_total=income)
    for i, days in enumerate((-10957, -10900, -14610, -18262, -21915)):
        rows[30 + i].update(days_birth=days)
    rows[40].update(
        days_birth=-9000, name_housing_type="With parents", amt_annuity=60000, amt_income_total=150000
    )
    rows[41].update(days_birth=-23000, amt_income_total=400000, amt_annuity=20000)
    return rows


@pytest.fixture(scope="module")
def loans(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("lending") / "applications.csv"
    lines = [",".join(HEADER)]
    for row in applications():
        cells = ["x", *[str(row[f.name]) for f in lending.SCHEMA.fields], "y"]
        lines.append(",".join(f'"{c}"' if " " in c else c for c in cells))
    path.write_text("\n".join(lines) + "\n")
    return lending.load(spark, str(path)).cache()


@pytest.fixture(scope="module")
def cleaned(loans):
    return lending.clean(loans).cache()


def only(df):
    return df.collect()[0].asDict()


def test_lending_contract_holds(loans):
    bad = check_contract(loans, lending.SCHEMA, lending.KEY).filter("violations > 0")
    assert bad.count() == 0


def test_lending_observes_the_planted_gaps(loans):
    seen = only(lending.observe(loans))
    assert seen["records"] == 200
    assert (seen["null_amt_annuity"], seen["null_amt_goods_price"], seen["null_cnt_fam_members"]) == (1, 1, 1)
    assert (seen["null_own_car_age"], seen["null_ext_source_2"], seen["null_occupation_type"]) == (199, 1, 1)
    assert seen["default_rate"] == 8.0
    assert {"column_name": "code_gender", "value": "XNA"} in [r.asDict() for r in lending.categories(loans).collect()]
    assert only(lending.ranges(loans))["max_cnt_children"] == 11
    structural = only(lending.car_age_is_structural(loans))
    assert structural["null_without_condition"] == structural["value_despite_condition"] == 0


def test_lending_corrections(loans, cleaned):
    counted = profile.change_audit(loans, cleaned, lending.suspects())
    before, after = (r.asDict() for r in sorted(counted.collect(), key=lambda r: r.stage, reverse=True))
    assert (before["gender_sentinel"], after["gender_sentinel"]) == (1, 0)
    assert (before["family_sentinel"], after["family_sentinel"]) == (1, 0)
    assert before["many_children"] == after["many_children"] == 1
    assert before["high_income"] == after["high_income"] == 1
    assert (before["no_annuity"], after["no_annuity"]) == (1, 0)
    assert before["no_goods_price"] == after["no_goods_price"] == 1
    relaxed = check_contract(cleaned, lending.SCHEMA, lending.KEY, relax=lending.RELAXED)
    # The narrowed family size is the one intended change of type.
    assert [tuple(r) for r in relaxed.filter("violations > 0").collect()] == [("type", "cnt_fam_members", 1)]


def test_lending_rows_are_kept_and_cleaning_is_idempotent(loans, cleaned):
    assert cleaned.count() == loans.count()
    wide = cleaned.select(*loans.columns).withColumn("cnt_fam_members", F.col("cnt_fam_members").cast("decimal(5,1)"))
    again = lending.clean(wide).select(*cleaned.columns)
    assert again.exceptAll(cleaned).count() == 0


def test_lending_derived_values(cleaned):
    rows = {r.sk_id_curr: r for r in cleaned.collect()}
    annuities = sorted(float(a["amt_annuity"]) for a in applications() if a["amt_annuity"] != "")
    assert float(rows[7].amt_annuity) == round(annuities[99], 1)
    assert (rows[3].flag_suspect_children, rows[4].flag_suspect_children) == (0, 1)
    assert (rows[5].flag_income_outlier, rows[6].flag_income_outlier) == (0, 1)
    assert rows[8].ltv_ratio is None and rows[8].flag_no_goods_price == 1
    assert (rows[9].cnt_fam_members, rows[10].occupation_type) == (1, "Not Employed / Unknown")
    assert rows[11].flag_missing_ext3 == 1 and round(rows[11].ext_source_2, 4) == 0.5
    assert rows[12].employment_tenure_years is None and rows[12].is_unemployed_or_pensioner == 1
    tiers = [rows[21 + i].income_tier for i in range(6)]
    assert tiers == ["Low", "Mid", "Mid", "Upper-Mid", "Upper-Mid", "High"]
    assert [rows[31 + i].age_band for i in range(5)] == ["30s", "20s", "40s", "50s", "60 plus"]
    assert str(rows[1].dti_ratio) == "0.1333" and str(rows[1].ltv_ratio) == "1.1111"


def test_lending_reports(cleaned):
    total = cleaned.count()
    filtered = ("by_gender", "mean_ltv_by_target", "high_risk_profile", "low_risk_profile", "top_employers")
    for name in lending.REPORTS:
        out = lending.report(cleaned, name)
        if "volume" in out.columns and name not in filtered:
            assert out.agg(F.sum("volume")).collect()[0][0] == total, name
    assert only(lending.report(cleaned, "high_risk_profile"))["volume"] == 1
    assert only(lending.report(cleaned, "low_risk_profile"))["volume"] >= 1
    gender = {r[0] for r in lending.report(cleaned, "by_gender").collect()}
    assert gender == {"F", "M"}
    assert lending.report(cleaned, "top_employers").count() == 0
    wide = lending.Settings(min_employer_volume=99)
    assert lending.report(cleaned, "top_employers", wide).count() == 2
    high = lending.report(cleaned, "by_dti_and_ltv").filter("ltv_band = 'High LTV'")
    assert only(high.agg(F.sum("volume").alias("n")))["n"] == 1  # the revolving loan without LTV


# --- marketplace ---------------------------------------------------------------------------------


def _csv(path, header, rows):
    lines = [",".join(header), *[",".join("" if v is None else str(v) for v in r) for r in rows]]
    path.write_text("\n".join(lines) + "\n")
    return str(path)


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    """120 orders of two customers' states; sellers s0 to s5, where s4 is never paid and s5 never reviewed."""
    folder = tmp_path_factory.mktemp("marketplace")
    rng = random.Random(11)
    orders, items, payments, reviews = [], [], [], []
    for i in range(120):
        oid, status = f"o{i}", "delivered"
        delivered, carrier, approved = "2018-03-09 12:00:00", "2018-03-02 00:00:00", "2018-03-01 01:00:00"
        if i % 10 == 0:
            delivered = "2018-03-10 08:00:00"  # the promised day, after midnight
        if i % 15 == 1:
            delivered = "2018-03-20 08:00:00"
        if i == 5:
            status, delivered, carrier = "shipped", None, None
        if i == 6:
            status = "canceled"
        if i == 7:
            delivered = None
        if i == 8:
            approved = None
        bought = "2018-08-31 00:00:01" if i == 9 else "2018-08-31 00:00:00" if i == 12 else "2018-03-01 00:00:00"
        orders.append((oid, f"c{i % 4}", status, bought, approved, carrier, delivered, "2018-03-10 00:00:00"))
        seller = f"s{i % 4}" if i < 110 else ("s4" if i < 115 else "s5")
        for n in range(1 + i % 2):
            price = 0 if (i, n) == (20, 0) else 10 + i
            items.append((oid, n + 1, f"p{i % 8}", seller, "2018-03-02 00:00:00", price, 5 if i != 30 else 80))
        if seller != "s4":
            payments.append((oid, "not_defined" if i == 40 else "credit_card", 1, 15 + i))
            if i % 6 == 0:
                payments.append((oid, "voucher", 1, 5))
        if seller != "s5":
            reviews.append((oid, 1 + rng.randrange(5), "2018-03-12 00:00:00"))
    reviews += [("o1", 5, "2018-04-01 00:00:00"), ("o2", 5, "2018-03-12 00:00:00"), ("o2", 4, "2018-03-12 00:00:00")]
    products = [("p0", None, 100, 9, 8), ("p1", "cat1", 0, 9, 8), ("p2", "cat2", 100, 0, 0)]
    products += [(f"p{p}", f"cat{p}", 100, 9, 8) for p in (3, 4, 5)]
    products += [("p6", "pc_gamer", 100, 9, 8), ("p7", "portateis_cozinha_e_preparadores_de_alimentos", 100, 9, 8)]
    data = {
        "customers": [(f"c{c}", f"u{c % 2}", "SP" if c else "RJ") for c in range(4)],
        "sellers": [(f"s{s}", "town", "SP" if s % 2 else "PR") for s in range(6)],
        "products": products,
        "product_category": [(f"cat{p}", f"Category {p}") for p in range(1, 6)],
        "orders": orders,
        "order_items": items,
        "order_payments": payments,
        "order_reviews": reviews,
    }
    paths = {
        name: _csv(folder / f"{name}.csv", [f.name for f in c.schema.fields], data[name])
        for name, c in marketplace.CONTRACTS.items()
    }
    return data, marketplace.load(spark, paths)


@pytest.fixture(scope="module")
def market(landed):
    return marketplace.clean(landed[1])


def test_marketplace_contracts_hold(landed):
    for name, frame in landed[1].items():
        contract = marketplace.CONTRACTS[name]
        bad = check_contract(frame, contract.schema, contract.key).filter("violations > 0")
        assert bad.count() == 0, name


def test_marketplace_sizes_and_relations(landed, market):
    data, tables = landed
    sizes = {r.table_name: r.records for r in marketplace.table_sizes(tables).collect()}
    assert sizes == {name: len(rows) for name, rows in data.items()}
    for t in (tables, market):
        for r in marketplace.referential_audit(t).collect():
            assert r.orphan_rows == 0 and r.matched_rows == r.child_rows, r.relation


def test_marketplace_corrections(landed, market):
    products = marketplace.correction_audit(landed[1], market, "products").collect()
    before, after = (r.asDict() for r in sorted(products, key=lambda r: r.stage, reverse=True))
    assert (before["zero_weight"], after["zero_weight"], after["null_weight"]) == (1, 0, 1)
    assert (before["zero_length"], after["null_length"], after["null_height"]) == (1, 1, 1)
    assert before["null_category"] == after["null_category"] == 1  # the CSV reader already made it NULL
    payments = marketplace.correction_audit(landed[1], market, "order_payments").collect()
    assert {(r.stage, r.undefined_type, r.null_type) for r in payments} == {("before", 1, 0), ("after", 0, 1)}


def test_marketplace_verification(landed, market):
    data = landed[0]
    orders = only(marketplace.verify(market, "orders"))
    assert orders["null_order_delivered_customer_date"] == orders["no_outcome"] == orders["no_variance"] == 2
    assert orders["null_order_approved_at"] == 1
    late = sum(1 for o in data["orders"] if o[6] and o[6] > o[7])
    assert orders["late"] == late and orders["in_time"] == 120 - 2 - late
    products = only(marketplace.verify(market, "products"))
    assert (products["null_categories"], products["suspect_weights"], products["untranslated"]) == (1, 1, 0)
    items = only(marketplace.verify(market, "order_items"))
    assert (items["null_freight_ratio"], items["unfit_freight_ratio"]) == (1, 0)
    assert only(marketplace.review_duplicates(landed[1])) == {"duplicated_keys": 2, "surplus_rows": 3}
    assert only(marketplace.review_duplicates(market)) == {"duplicated_keys": 0, "surplus_rows": 0}
    kept = {r.order_id: r.review_score for r in market.order_reviews.collect()}
    assert kept["o1"] == 5 and kept["o2"] == max(r[1] for r in data["order_reviews"] if r[0] == "o2")
    assert only(marketplace.revenue_reconciliation(market))["difference"] == 0
    assert only(marketplace.revenue_gaps(market)) == {"missing_rows": 0}
    conform = only(marketplace.time_formats(landed[1]))
    assert conform["malformed_order_purchase_timestamp"] == 0


def test_seller_summary(landed, market):
    data = landed[0]
    mart = {r.seller_id: r for r in marketplace.seller_summary(market).collect()}
    assert set(mart) == {"s0", "s1", "s2", "s3", "s5"}  # the unpaid seller is absent
    assert mart["s5"].avg_review_score is None
    paid, fanned, once = {}, {}, {}
    for oid, _, _, value in data["order_payments"]:
        paid[oid] = paid.get(oid, 0) + value
    seen = set()
    for oid, _, _, seller, *_ in data["order_items"]:
        fanned[seller] = fanned.get(seller, 0) + paid.get(oid, 0)
        if (oid, seller) not in seen:
            seen.add((oid, seller))
            once[seller] = once.get(seller, 0) + paid.get(oid, 0)
    assert {s: r.total_revenue for s, r in mart.items()} == {s: fanned[s] for s in mart}
    single = marketplace.seller_summary(market, fan_out=False).collect()
    assert {r.seller_id: r.total_revenue for r in single} == {s: once[s] for s in mart}


def test_marketplace_reports(spark, market, tmp_path):
    mart = materialize(marketplace.seller_summary(market), str(tmp_path / "mart"))
    s = marketplace.Settings(min_volume=5)
    c = marketplace.context(market, mart, s)
    results = {name: [r.asDict() for r in marketplace.report(c, name).collect()] for name in marketplace.REPORTS}
    assert all(results.values())
    head = results["headline"][0]
    assert head["total"] == 118 and head["positives"] + head["negatives"] == 117
    # The order bought one second into the last day is outside; midnight is inside.
    assert sum(r["volume"] for r in results["monthly_trend"]) == 117
    assert abs(sum(r["share"] for r in results["variance_bands"]) - 100) < 0.1
    on_time = [r for r in results["variance_bands"] if r["variance_band"] == "On time"]
    assert on_time[0]["volume"] == 12
    assert sum(r["seller_count"] for r in results["performance_tiers"]) == 4
    assert {r["order_status"] for r in results["by_status"]} == {"delivered", "shipped", "canceled"}
    risk = results["revenue_at_risk"][0]
    assert risk["segment_rows"] == results["high_risk_sellers"][0]["high_risk_seller_count"]
    fixed = marketplace.context(market, mart, marketplace.Settings(min_volume=5, late_cut=1.0, score_cut=0.0))
    tiers = [r.performance_tier for r in marketplace.report(fixed, "performance_tiers").collect()]
    assert tiers == ["High reliability / High satisfaction"]


def test_results_do_not_depend_on_shuffle_partitions(spark, market):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        seen = []
        for n in ("1", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen.append(sorted(map(tuple, marketplace.seller_summary(market).collect())))
        assert seen[0] == seen[1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_read_csv_typed_is_the_loader(spark, tmp_path):
    with pytest.raises(ValueError):
        read_csv_typed(spark, _csv(tmp_path / "x.csv", ["order_id"], [("o1",)]), marketplace.CONTRACTS["orders"].schema)
