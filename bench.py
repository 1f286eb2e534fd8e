"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local threads. Every query is run to
the last row through a no-op sink; one untimed query warms the JVM up.
"""

from __future__ import annotations

import json
import os
import sys
import time

from checks import all_queries
from isoqt.session import build_session

HEADLINE = [
    "e01_hr_corr", "e03_spearman", "e07_population_weighted_r", "e10_poly_reference", "e11_poly_reference_degree6", "e13_hr_bin_reference",
    "e15_distribution", "e16_confusion", "e17_reclass_matrix", "e23_cascade", "e26_subgroup_report", "e28_table2", "e30_table8", "e31_sweep_k",
    "e33_bootstrap_weighted_r", "e35_hr_zone_report", "e38_population_report", "e43_zone_thresholds", "e48_concordance_by", "e51_roc", "e53_nnt_by",
    "e58_demographic_bias", "e59_stratum_profile", "e63_outcomes_by_record", "e66_table7_adjusted_odds", "e78_lodo", "e81_table3", "e84_headline",
    "d01_merge_features", "d08_evaluate_formulas", "f07_record_features", "b09_quality_funnel", "c21_superclass_of_codes", "c25_has_diagnosis",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
                          spark__ui__showConsoleProgress="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    all_queries.QUERIES["e01_hr_corr"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in only:
        start = time.perf_counter()
        all_queries.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
