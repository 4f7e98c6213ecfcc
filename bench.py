"""Times the headline queries: one warm-up run each, then one measured run. Prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "full_hourly_events",
    "detect_hourly_events",
    "quality_summary",
    "describe",
    "freq_infer_modal_gap",
    "infer_series_panel",
    "regularise_fill",
    "fill_linear",
    "rolling_features",
    "lag_linear_residual_norm",
    "wasserstein_window",
    "kmeans_scorer",
    "quantile_flag",
    "or_variables",
    "full_or_variables",
    "fit_then_score",
    "scorer_notes",
    "regularise_many",
    "complete_panel",
    "acf_period",
    "ljung_box",
    "adf_test",
    "stl_strength",
    "auc_roc_pr",
    "agreement",
    "explain_topn",
    "full_explain_topn",
    "iforest",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from tidepanel import build_session
    from tidepanel.plans.catalogue import QUERIES

    spark = build_session(
        "bench",
        **{
            "spark.master": f"local[{cpus}]",
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "12g",
            "spark.python.sql.dataFrameDebugging.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    chosen = sys.argv[1:] or HEADLINE
    seconds: dict[str, float] = {}
    for name in chosen:
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries, warm",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
