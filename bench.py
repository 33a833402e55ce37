"""Headline timings: one JSON line.

Every query starts cold: the landed tables of the one before it are dropped
first, so a time includes everything from the base tables to the result unless
its name ends in ``_landed`` (these read the published panel or predictions,
as the downstream jobs do).
"""

from __future__ import annotations

import json
import os
import time

from chronopanel.plans import catalog
from chronopanel.session import local_session, release

COLD = [
    "staged_housing", "panel_joined", "target_columns", "panel_join_report", "feature_matrix", "quality_checks",
    "naive_predictions", "eda_prevalence_by_year",
]
LANDED = [
    "feature_matrix", "feature_availability", "quality_checks", "column_profile", "audit_publication", "split_accounting",
    "metrics_model_table", "metrics_by_tier", "bootstrap_intervals_entities", "eda_target_distribution", "eda_outliers",
    "eda_regime_shifts", "results_headline", "imputer_scaling", "bootstrap_poisson_weights", "bootstrap_median_error",
    "bootstrap_paired_median", "audit_replay", "ridge_alpha_scan", "logistic_c_scan", "learned_predictions", "family_ablation",
]


def timed(name, spark, folder):
    start = time.perf_counter()
    catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["staged_rate"](spark, folder).count()  # start the JVM's engines before the clock
    times = {}
    for name in COLD:
        release(spark)
        times[name] = timed(name, spark, folder)
    catalog.panel(spark, folder)
    catalog.features(spark, folder)
    catalog.predictions(spark, folder)
    for name in LANDED:
        times[f"{name}_landed"] = timed(name, spark, folder)
    print(json.dumps({
        "metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
