"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
the data and the local cores.  Every query runs once to warm up; then it is
timed once, and fast ones BENCH_RUNS times (default 3, median).  Each run
computes all rows.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from voxquarry.plans import catalog  # noqa: E402
from voxquarry.session import local_session, stage_scope  # noqa: E402

HEADLINE = [
    "dice_score", "result_summary", "grouping_report", "runs_merge", "bbox2d_adaptive", "aux_labels",
    "parse_packet", "shorten_text", "slot_topk", "tfidf_topk", "cosine_topk", "otsu_threshold",
    "erode", "components", "largest_cc_2d", "pseudo_boxes", "slice_triplet", "training_rows",
    "ablation_sweep", "guided_report",
]


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    with stage_scope(spark):
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    shared = os.environ.get("BENCH_SHARED_DIR") or tempfile.mkdtemp(prefix="spark-shared-")
    spark = local_session(cpus, **{"spark.driver.memory": "16g", "spark.checkpoint.dir": shared})
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        run(spark, name, sf_dir)
        taken = [run(spark, name, sf_dir)]
        while len(taken) < runs and taken[0] < 3.0:
            taken.append(run(spark, name, sf_dir))
        times[name] = round(statistics.median(taken), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
