"""Times the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Every query runs twice. ``queries`` and ``value`` are the second runs, with
compiled code; ``first_run`` are the first, which also load and compile it.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from cohortloom.catalog import QUERIES
from cohortloom.session import build, release

HEADLINE = (
    "pipe_cohort_label",
    "pipe_x_agg",
    "pipe_x_temp",
    "pipe_x_temp_flat",
    "pipe_early_fusion",
    "pipe_genotype_prs",
    "pipe_risk_factors",
    "pipe_history_before_event",
    "pipe_obs_count_by_status",
    "pipe_overlap_report",
    "join_interval_map",
    "hierarchy_cohort",
    "split_stratified",
    "kfold_stratified",
    "metrics_binary",
    "win_row_number",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/orders.parquet").groupBy("o_custkey").count().write.format("noop").mode("overwrite").save()
    first: dict[str, float] = {}
    times: dict[str, float] = {}
    for name in HEADLINE:
        for target in (first, times):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            target[name] = round(time.perf_counter() - start, 3)
        print(name, first[name], times[name], file=sys.stderr, flush=True)
    release(spark)
    spark.stop()
    scale = Path(folder).name.removeprefix("sf")
    total = round(sum(times.values()), 3)
    report = {"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "first_run": first}
    print(json.dumps({**report, "sf": float(scale)}))


if __name__ == "__main__":
    main()
