"""Time the headline queries: one JSON line on stdout.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8)
choose the data and the number of local threads; names on the command line
choose other queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = (
    "b2_in_observation", "b3_event_ordinals", "b5_at_least_two", "b7_distinct_concepts", "b8_group_any",
    "b9_nested_group", "b15_expression_limit_first", "b18_drug_eras", "b19_censor_dates", "b21_build_cohort",
    "b22_measurement_change", "c2_censor_cohorts", "cohort_drug_era_censored", "cohort_nested", "cohort_simple",
    "d5_drug_events", "e1_collapse_eras_180", "f2_feature_proportions", "k3_drug_groups", "k4_condition_groups",
    "k7_bulk_characteristics", "q7_compare_cohorts", "r2_covariate_values", "t3_t7_all_strata_at_once",
    "t8_stratify_with", "t9_stratify_without",
)


def main() -> None:
    from cohortry import session
    from contract import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", **{
        "spark.master": f"local[{cpus}]", "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
        "spark.driver.memory": "16g", "spark.log.level": "ERROR", "spark.ui.showConsoleProgress": "false",
    })
    # One untimed query writes the vocabulary that all others read.
    QUERIES["v4_codesets"](spark, sf_dir).collect()
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        begin = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, total wall time",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
