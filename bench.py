"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR picks the tables, BENCH_CPUS the local cores, BENCH_REPEATS the timed runs per query
(the median counts). A full warm-up run of each query comes first.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from dealflux.catalog import registry
from dealflux.session import local_session

HEADLINE = [
    # The six analyses of an event log: overview, nulls, time, sessions, sequences, place and device.
    "agg_overview", "agg_null_profile", "agg_categorical_profile", "agg_events_by_hour", "agg_events_by_day",
    "evt_session_stats", "evt_session_stats_summary", "evt_transitions", "win_first_event",
    "agg_country_metrics", "agg_region_by_country", "agg_device_usage",
    # Journeys and cleaning.
    "evt_sessionize", "evt_markov", "evt_ngrams", "evt_funnel", "evt_clean_pipeline", "agg_latency_by_geo",
    # Deals.
    "agg_yearly_trends", "agg_sector_growth_table", "agg_ecosystem_metrics", "agg_stage_sector_amount_share",
    "agg_investor_estimated_amounts", "agg_region_sector", "ml_company_features", "agg_monthly_returns",
    # Series.
    "win_yoy_12", "fc_acf", "fc_ar_forecast",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    registry.load()
    spark = local_session(cores, "bench", shuffle=int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        began = time.perf_counter()
        registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took = time.perf_counter() - began
        spark.catalog.clearCache()
        return took

    times = {}
    for name in sys.argv[1:] or HEADLINE:
        run(name)
        times[name] = round(statistics.median(run(name) for _ in range(repeats)), 3)
    print(json.dumps({
        "metric": "headline queries, total of medians", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")), "cpus": cores, "repeats": repeats,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
