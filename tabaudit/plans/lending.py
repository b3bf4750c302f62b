"""Lending risk: one wide table of loan applications, from typed rows to ranked segments.

``observe`` profiles, ``clean`` corrects and derives, ``verify`` audits the result, and ``REPORTS`` holds every
segment query. Thresholds are parameters; the defaults are the fixed values of the domain.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabaudit.functions import columns as C
from tabaudit.operators import clean as fix
from tabaudit.operators import derive, profile, segment
from tabaudit.sources import read_csv_typed

_MONEY = T.DecimalType(15, 4)
_YEARS = T.DecimalType(5, 1)


def _field(name: str, kind: T.DataType, nullable: bool = False) -> T.StructField:
    return T.StructField(name, kind, nullable)


SCHEMA = T.StructType(
    [
        _field("sk_id_curr", T.IntegerType()),
        _field("target", T.IntegerType()),
        _field("name_contract_type", T.StringType()),
        _field("amt_credit", _MONEY),
        _field("amt_income_total", _MONEY),
        _field("amt_annuity", _MONEY, True),
        _field("amt_goods_price", _MONEY, True),
        _field("code_gender", T.StringType()),
        _field("days_birth", T.IntegerType()),
        _field("name_education_type", T.StringType()),
        _field("name_family_status", T.StringType()),
        _field("name_income_type", T.StringType()),
        _field("name_housing_type", T.StringType()),
        _field("cnt_children", T.ByteType()),
        _field("cnt_fam_members", _YEARS, True),
        _field("flag_own_car", T.StringType()),
        _field("flag_own_realty", T.StringType()),
        _field("own_car_age", _YEARS, True),
        _field("days_employed", T.IntegerType()),
        _field("occupation_type", T.StringType(), True),
        _field("organization_type", T.StringType()),
        _field("ext_source_2", T.FloatType(), True),
        _field("ext_source_3", T.FloatType(), True),
        _field("region_rating_client", T.ByteType()),
        _field("region_rating_client_w_city", T.ByteType()),
    ]
)
KEY = ("sk_id_curr",)
# Columns that may hold NULL once the sentinels are gone.
RELAXED = ("code_gender", "name_family_status")

NULL_COLUMNS = (
    "amt_annuity",
    "amt_goods_price",
    "cnt_fam_members",
    "own_car_age",
    "occupation_type",
    "ext_source_2",
    "ext_source_3",
)
CATEGORY_COLUMNS = (
    "name_contract_type",
    "code_gender",
    "name_education_type",
    "name_family_status",
    "name_income_type",
    "name_housing_type",
    "occupation_type",
    "organization_type",
    "flag_own_car",
    "flag_own_realty",
)
# Numeric columns with the digits their mean is shown in.
RANGE_COLUMNS = {
    "days_birth": 0,
    "days_employed": 0,
    "amt_income_total": 0,
    "amt_credit": 0,
    "amt_annuity": 0,
    "amt_goods_price": 0,
    "own_car_age": 0,
    "ext_source_2": 4,
    "ext_source_3": 4,
    "cnt_children": 2,
    "cnt_fam_members": 0,
}


@dataclass(frozen=True)
class Settings:
    """Fixed values of the domain."""

    gender_sentinel: str = "XNA"
    family_sentinel: str = "Unknown"
    max_children: int = 10
    max_income: int = 900_000
    family_default: int = 1
    occupation_label: str = "Not Employed / Unknown"
    not_employed_days: int = 365_243
    revolving: str = "Revolving loans"
    income_edges: tuple = (112_500, 202_500, 472_500)
    income_labels: tuple = ("Low", "Mid", "Upper-Mid", "High")
    age_edges: tuple = (30, 40, 50, 60)
    age_labels: tuple = ("20s", "30s", "40s", "50s", "60 plus")
    region_labels: tuple = ((1, "Low Risk"), (2, "Medium Risk"))
    region_default: str = "High Risk"
    dti_edges: tuple = (0.1, 0.2, 0.3, 0.4)
    dti_labels: tuple = ("Under 0.1", "0.1 to 0.2", "0.2 to 0.3", "0.3 to 0.4", "Above 0.4")
    dti_cut: float = 0.3
    ltv_cut: float = 1.2
    min_employer_volume: int = 500
    top_employers: int = 5
    # Profiles: ages, income tiers, housing and a bound on debt to income.
    high_risk_ages: tuple = ("20s", "30s")
    high_risk_tiers: tuple = ("Low", "Mid")
    high_risk_housing: tuple = ("Rented apartment", "With parents")
    high_risk_dti_above: float = 0.2
    low_risk_ages: tuple = ("50s", "60 plus")
    low_risk_tiers: tuple = ("Upper-Mid", "High")
    low_risk_housing: tuple = ("House / apartment",)
    low_risk_dti_below: float = 0.1


DEFAULTS = Settings()


def load(spark: SparkSession, path: str) -> DataFrame:
    """The 25 analysis columns of the application file, by name, in declared types."""
    return read_csv_typed(spark, path, SCHEMA)


# --- observe -------------------------------------------------------------------------------------


def observe(df: DataFrame) -> DataFrame:
    """Row count, NULLs and base default rate in one scan."""
    metrics = {"default_rate": segment.rate_expr("target")}
    return profile.audit(df, nulls=NULL_COLUMNS, metrics=metrics)


def categories(df: DataFrame) -> DataFrame:
    """Value sets of the ten category columns in one scan."""
    return profile.distinct_values_of(df, CATEGORY_COLUMNS)


def ranges(df: DataFrame, rounded: bool = True) -> DataFrame:
    """min, max, mean and NULLs of the eleven numeric columns in one scan."""
    return profile.numeric_profile(df, RANGE_COLUMNS if rounded else dict.fromkeys(RANGE_COLUMNS))


def suspects(s: Settings = DEFAULTS) -> dict:
    """Suspect values, counted before and after the corrections."""
    return {
        "gender_sentinel": F.col("code_gender") == s.gender_sentinel,
        "family_sentinel": F.col("name_family_status") == s.family_sentinel,
        "many_children": F.col("cnt_children") > s.max_children,
        "high_income": F.col("amt_income_total") > s.max_income,
        "no_annuity": F.col("amt_annuity").isNull(),
        "no_family_size": F.col("cnt_fam_members").isNull(),
        "no_ext_source_2": F.col("ext_source_2").isNull(),
        "no_goods_price": F.col("amt_goods_price").isNull(),
        "no_occupation": F.col("occupation_type").isNull(),
        "no_ext_source_3": F.col("ext_source_3").isNull(),
        "not_employed": F.col("days_employed") == s.not_employed_days,
        "revolving": F.col("name_contract_type") == s.revolving,
    }


def car_age_is_structural(df: DataFrame) -> DataFrame:
    return profile.structural_null_check(df, "own_car_age", F.col("flag_own_car") == "N")


# --- clean ---------------------------------------------------------------------------------------


def correct(df: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Invalid encodings to NULL, outliers flagged, before anything is imputed."""
    df = fix.sentinel_to_null(
        df, {"code_gender": [s.gender_sentinel], "name_family_status": [s.family_sentinel]}
    )
    df = fix.threshold_flag(df, "cnt_children", s.max_children, "flag_suspect_children")
    return fix.threshold_flag(df, "amt_income_total", s.max_income, "flag_income_outlier")


def impute(df: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Medians, a constant and a category of their own for missing values; flags for the rest.

    The medians of both columns share their scans of this frame, so hand in a stored table rather than a long plan.
    """
    df = fix.impute_medians(df, {"amt_annuity": 1, "ext_source_2": 4})
    df = fix.impute_constant(df, {"cnt_fam_members": s.family_default})
    df = fix.null_flag(df, "amt_goods_price", "flag_no_goods_price")
    df = fix.reclassify_null(df, "occupation_type", s.occupation_label)
    return fix.null_flag(df, "ext_source_3", "flag_missing_ext3")


def transform(df: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Ages, tenure, labels, ratios, tiers. One projection."""
    not_employed = F.col("days_employed") == s.not_employed_days
    no_ltv = (F.col("name_contract_type") == s.revolving) | F.col("amt_goods_price").isNull()
    region = C.code_to_label("region_rating_client", dict(s.region_labels), s.region_default)
    measured = df.withColumns(
        {
            "age_years": C.days_to_years("days_birth"),
            "employment_tenure_years": C.days_to_years("days_employed", null_when=not_employed),
            "is_unemployed_or_pensioner": C.value_flag("days_employed", s.not_employed_days),
            "cnt_fam_members": C.fitting_cast("cnt_fam_members", "tinyint", exact=True),
            "region_risk_label": region,
            "ltv_ratio": C.guarded_ratio("amt_credit", "amt_goods_price", null_when=no_ltv),
            "dti_ratio": C.guarded_ratio("amt_annuity", "amt_income_total"),
            "income_tier": C.band("amt_income_total", s.income_edges, s.income_labels),
        }
    )
    return derive.band(measured, "age_years", s.age_edges, s.age_labels, "age_band")


def clean(df: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    return transform(impute(correct(df, s), s), s)


def verify(df: DataFrame, rounded: bool = True) -> DataFrame:
    """Rows, remaining NULLs and plausibility of the derived columns, in one scan."""
    derived = {"age_years": 1, "employment_tenure_years": 1, "ltv_ratio": 4, "dti_ratio": 4, "cnt_fam_members": 0}
    nulls = [c for c in NULL_COLUMNS if c not in derived]
    return df.agg(F.count("*").alias("records"), *profile.null_counts(nulls), *profile.range_stats(derived if rounded else dict.fromkeys(derived)))


# --- segment -------------------------------------------------------------------------------------


def _in_segment(ages, tiers, housing, dti: Column) -> Column:
    return C.in_every(
        F.col("age_band").isin(list(ages)),
        F.col("income_tier").isin(list(tiers)),
        F.col("name_housing_type").isin(list(housing)),
        dti,
    )


def _high_risk(s: Settings) -> Column:
    over = F.col("dti_ratio") > s.high_risk_dti_above
    return _in_segment(s.high_risk_ages, s.high_risk_tiers, s.high_risk_housing, over)


def _low_risk(s: Settings) -> Column:
    under = F.col("dti_ratio") < s.low_risk_dti_below
    return _in_segment(s.low_risk_ages, s.low_risk_tiers, s.low_risk_housing, under)


def _profile_kpis(digits: Callable[[int], int | None]) -> dict:
    return {
        "default_rate": segment.rate_expr("target", digits(2)),
        "avg_dti": segment.mean_expr("dti_ratio", digits(4)),
        "volume": F.count("*"),
    }


Report = Callable[[DataFrame, Settings, Callable[[int], "int | None"]], DataFrame]


def _by(*dims: str) -> Report:
    return lambda df, s, digits: segment.rate_by(df, dims, "target", None, digits(2), "default_rate")


def _dti_range(dim: str) -> Report:
    return lambda df, s, digits: segment.range_by(df, dim, "dti_ratio", scale=digits(4))


def _dti_bands(df, s, digits):
    bands = {"dti_band": C.band("dti_ratio", s.dti_edges, s.dti_labels)}
    return segment.rate_by_band(df, bands, "target", scale=digits(2), rate="default_rate")


def _dti_ltv(df, s, digits):
    """NULL falls to the ELSE branch: a loan without LTV counts as high LTV."""
    bands = {
        "dti_band": C.band("dti_ratio", [s.dti_cut], ["Low DTI", "High DTI"]),
        "ltv_band": C.band("ltv_ratio", [s.ltv_cut], ["Low LTV", "High LTV"]),
    }
    return segment.rate_by_band(df, bands, "target", scale=digits(2), rate="default_rate")


def _mean_ltv(df, s, digits):
    return segment.mean_by(df, "target", "ltv_ratio", F.col("ltv_ratio").isNotNull(), digits(4))


def _one_profile(member: Callable[[Settings], Column]) -> Report:
    return lambda df, s, digits: segment.profile_metrics(df, [member(s)], _profile_kpis(digits))


def _profiles(df, s, digits):
    kpis = _profile_kpis(digits) | {"avg_ltv": segment.mean_expr("ltv_ratio", digits(4))}
    rules = [(_high_risk(s), "High Risk"), (_low_risk(s), "Low Risk")]
    return segment.compare_profiles(df, rules, "Standard", kpis, "risk_profile")


def _top_employers(df, s, digits):
    return segment.top_k_min_volume(
        df, "organization_type", "target", s.min_employer_volume, s.top_employers, digits(2)
    )


def _by_gender(df, s, digits):
    known = F.col("code_gender").isNotNull()
    return segment.rate_by(df, "code_gender", "target", known, digits(2), "default_rate")


REPORTS: dict[str, Report] = {
    "by_contract": _by("name_contract_type"),
    "by_gender": _by_gender,
    "by_education": _by("name_education_type"),
    "by_income_type": _by("name_income_type"),
    "by_housing": _by("name_housing_type"),
    "by_age_band": _by("age_band"),
    "by_income_tier": _by("income_tier"),
    "by_region_risk": _by("region_risk_label"),
    "by_education_and_income": _by("name_education_type", "income_tier"),
    "by_age_and_contract": _by("age_band", "name_contract_type"),
    "by_housing_and_employment": _by("name_housing_type", "is_unemployed_or_pensioner"),
    "by_income_and_age": _by("income_tier", "age_band"),
    "by_education_and_employment": _by("name_education_type", "is_unemployed_or_pensioner"),
    "by_region_and_contract": _by("region_risk_label", "name_contract_type"),
    "dti_range_by_target": _dti_range("target"),
    "dti_range_by_income_tier": _dti_range("income_tier"),
    "by_dti_band": _dti_bands,
    "mean_ltv_by_target": _mean_ltv,
    "by_dti_and_ltv": _dti_ltv,
    "high_risk_profile": _one_profile(_high_risk),
    "low_risk_profile": _one_profile(_low_risk),
    "risk_profiles": _profiles,
    "by_employment": _by("is_unemployed_or_pensioner"),
    "top_employers": _top_employers,
}


def report(df: DataFrame, name: str, s: Settings = DEFAULTS, rounded: bool = True) -> DataFrame:
    """One named report over the cleaned table; ``rounded=False`` keeps full precision."""
    return REPORTS[name](df, s, (lambda n: n) if rounded else (lambda n: None))
