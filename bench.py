"""Benchmark: run the headline analyses at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``.

Prints one JSON line: {"metric", "value", "unit", "queries": {name: sec}, "sf"}.
Every query is built from scratch (fresh DataFrame, no result reuse) and
collected; the session is warmed with two untimed queries so the numbers
measure the plans, not JVM start-up and first-time code generation.
``value`` is the sum over the standalone queries; ``batch_all_eight_reports_sec``
times the eight analyses run together over one materialised experiment.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)

HEADLINE = [
    "tier_counts_raw", "balanced_group_sizes", "gender_split", "city_split", "engagement",
    "coupon_usage", "tier_profitability", "rollout_projection",
    "engagement_line", "coupon_usage_line",
    "uplift_summary", "projected_net_position", "scenario_table", "referrals_by_referrer",
    "balanced_users",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    from tierlift.session import local_session
    from tierlift.plans.catalog import QUERIES

    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "8")))
    for warm in ("tier_counts_raw", "engagement"):  # JVM / codegen warm-up, untimed
        QUERIES[warm](spark, sf_dir).collect()
    times, failed = {}, {}
    for name in names:
        t0 = time.perf_counter()
        try:
            QUERIES[name](spark, sf_dir).collect()
        except Exception as exc:  # keep measuring the others; report the failure
            failed[name] = f"{type(exc).__name__}: {str(exc)[:200]}"
            continue
        times[name] = round(time.perf_counter() - t0, 3)
    # Batch usage: the eight analyses over one experiment whose eligible
    # population, cohort and per-user facts are materialised once.
    from tierlift.plans.experiment import Experiment
    t0 = time.perf_counter()
    for df in Experiment.from_tpch(spark, sf_dir, materialize=True).reports().values():
        df.collect()
    batch = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else sf_dir,
                      "batch_all_eight_reports_sec": batch, **({"failed": failed} if failed else {})}))
    spark.stop()


if __name__ == "__main__":
    main()
