"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the number of local cores.
Each query is run in full: its result is written to the no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "a01_key_figures", "a02_district_report", "a05_risk_factor_report", "a06_median_imputation",
    "a09_suppressed_communities", "a11_metric_source", "a13_average_precision", "a17_task_completeness",
    "j01_matching_rules", "j02_prevalence_cutoff", "j03_missing_parts", "j07_scenario_comparison",
    "m01_stratified_split", "m12_graded_residents", "p06_contract_projection", "p11_record_validation",
    "p27_keyed_pseudonym", "s07_population_summary", "t02_top_follow_ups", "u04_first_parts",
    "w01_latest_records", "w03_combined_factors", "w06_action_plan", "w08_trend_series",
]

#: Dear queries, timed beside the headline and not part of its value.
DEAR = ["a07_chained_imputation", "st1_unique_ingest", "st1_watermark_ingest", "st2_running_report"]


def main() -> None:
    from pulsegrid.plans.catalog import QUERIES
    from pulsegrid.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["a02_district_report"](spark, sf_dir).count()  # starts the JVM's first tasks
    times = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    dear = {}
    for name in DEAR:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        dear[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({
        "metric": "headline_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "dear_queries": dear, "sf": os.path.basename(sf_dir.rstrip("/")), "cores": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
