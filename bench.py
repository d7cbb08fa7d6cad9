"""Benchmark the headline queries; prints ONE JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 BENCH_RUNS=3 python bench.py

Each query is executed to completion with the ``noop`` sink (nothing is pulled to
the driver); the reported time is the median of ``BENCH_RUNS`` warm runs after one
warm-up run. ``value`` is the sum of the medians.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def _sf(path: str) -> float | str:
    name = os.path.basename(path)
    try:
        return float(name.replace("sf", ""))
    except ValueError:
        return name


def main() -> None:
    from ledgerkit.session import local_session

    spark = local_session(cores=CPUS, shuffle_partitions=int(CPUS) if CPUS.isdigit() else 8, app="ledgerkit-bench")
    from ledgerkit import queries as Q
    from ledgerkit.plans import profiles as P

    def all_cards(by: tuple[str, ...]):
        def run(s, d):
            return P.all_cards(Q.shared(s, d, "ledger_min", by, row_passes=True))

        return run

    headline = {
        "g04_amount_by_region": Q.QUERIES["g04_amount_by_region"],
        "b01_b14_shared_block": Q.QUERIES["b01_b14_shared_block"],
        "f01_f12_all_cards": all_cards(()),
        "f01_f12_all_cards_by_region": all_cards(("region_label",)),
        "f01_performance_cards_by_region": Q.QUERIES["f01_performance_cards_by_region"],
        "f10_fraud_cards_events": Q.QUERIES["f10_fraud_cards_events"],
        "i08_i12_content_scores": Q.QUERIES["i08_i12_content_scores"],
        "c09_clean_pipeline": Q.QUERIES["c09_clean_pipeline"],
        "w02_running_total_rows": Q.QUERIES["w02_running_total_rows"],
        "w06_mean_abs_diff": Q.QUERIES["w06_mean_abs_diff"],
        "g15_exact_quantile_whole_book": Q.QUERIES["g15_exact_quantile_whole_book"],
    }
    timings: dict[str, float] = {}
    for name, fn in headline.items():
        runs = []
        for i in range(RUNS + 1):
            t0 = time.perf_counter()
            fn(spark, SF_DIR).write.format("noop").mode("overwrite").save()
            if i > 0:
                runs.append(time.perf_counter() - t0)
        timings[name] = round(statistics.median(runs), 3)
    print(json.dumps({
        "metric": "headline_queries_total_median",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": _sf(SF_DIR),
        "cpus": CPUS,
        "runs": RUNS,
        "spark": spark.version,
    }))


if __name__ == "__main__":
    main()
