"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS
(default 3: the median after one warm-up), BENCH_ALL=1 for every registered query once."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from beatloom.plans import catalog  # noqa: E402
from beatloom.session import local_session  # noqa: E402

HEADLINE = [
    "token_sentences",
    "beat_join",
    "mlm_masking",
    "record_vote_multi",
    "class_auroc",
    "ensemble_probs",
    "patient_split",
    "stratified_split",
    "code_to_class",
    "code_assign",
    "code_update",
    "segment_waveforms",
    "mean_wave",
    "peaks",
    "best_epoch_gmean",
    "shard_manifest",
]


def run(fn, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    # The noop sink computes every row and column without collecting any.
    fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    every = os.environ.get("BENCH_ALL") == "1"
    runs = 1 if every else int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="bench")
    times = {}
    for name in list(catalog.QUERIES) if every else HEADLINE:
        fn = catalog.QUERIES[name][0]
        if not every:
            run(fn, spark, sf_dir)
        times[name] = round(statistics.median(run(fn, spark, sf_dir) for _ in range(runs)), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
