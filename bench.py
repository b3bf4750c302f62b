"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [query ...]

Every query is computed in full into a sink that discards rows, twice; the better time counts. The session
is started, and the JVM warmed, before the clock runs.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from tabaudit.registry.catalog import REGISTRY
from tabaudit.session import build_session

HEADLINES = (
    "null_audit",
    "count_where",
    "distinct_values_of",
    "value_distributions",
    "numeric_profile",
    "audit",
    "format_conformance",
    "duplicate_key_count",
    "referential_matches",
    "referential_audit",
    "reconcile_total",
    "sentinel_to_null",
    "exact_median",
    "impute_median",
    "dedupe_latest",
    "dedupe_latest_limited",
    "guarded_ratio",
    "translate_lookup",
    "rollup_to_parent",
    "entity_summary",
    "bridged_summary",
    "rate_by",
    "rate_by_band",
    "top_k_min_volume",
    "joined_rate",
    "joined_mean",
    "joined_total",
    "joined_multi",
    "share_distribution",
    "outcome_headline",
    "monthly_trend",
    "tier_compare",
    "share_of_total",
    "supplier_revenue_at_risk",
    "lending_clean",
    "lending_risk_profiles",
    "lending_by_dti_and_ltv",
    "marketplace_clean_orders",
    "marketplace_seller_summary",
    "marketplace_category_risk",
    "marketplace_category_by_state",
    "marketplace_revenue_at_risk",
)


def run(spark, name: str, folder: str) -> float:
    started = time.perf_counter()
    REGISTRY[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session(
        "tabaudit-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    run(spark, "rate_by", folder)
    names = sys.argv[1:] or HEADLINES
    seconds = {name: round(min(run(spark, name, folder) for _ in range(2)), 3) for name in names}
    scale = re.search(r"sf([\d.]+)", folder)
    line = {
        "metric": "total seconds of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": float(scale.group(1)) if scale else None,
    }
    spark.stop()
    print(json.dumps(line))


if __name__ == "__main__":
    main()
