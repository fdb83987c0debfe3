"""Times the headline queries and prints one JSON line.

Each query runs once to warm up and then ``BENCH_RUNS`` times; the best time
counts. Results go to a no-op sink, so all rows are computed and none is kept.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from scrubline.queries import QUERIES
from scrubline.session import build_session

HEADLINE = [
    "c1_dataset_level_texts", "c4_infer_all_types", "c8_outliers_lineitem", "c9_quality_report",
    "c14_describe_numeric", "c15_distribution_binned", "c17_correlation", "c20_column_statistics",
    "dt_convert_guess", "dt_diff_hours", "f2_drop_outliers", "f5_duplicate_probe",
    "m1_fill_mean", "m1_fill_median", "m2_fill_mode", "m6_fill_batch", "n1_round", "n3_scale_zscore",
    "n5_bin", "n8_outliers_median", "p5_calculated_column", "p6_split_column", "str_case_title",
    "str_regex", "str_special", "str_trim_batch", "w1_forward_fill", "w2_backward_fill",
    "w3_dedup_keep_first", "x2_count_changes", "x6_preview", "y1_to_numeric", "g1_clean_by_suggestions",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(min(times[1:]), 3)
    spark.stop()
    result = {
        "metric": "total_query_time",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
