"""Wall-clock of the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fieldtrace.catalog import all_queries  # noqa: E402
from fieldtrace.session import local_session  # noqa: E402
from fieldtrace.sources.fixtures import Tables  # noqa: E402

HEADLINE = [
    "timeline_gate", "dms_to_degrees", "sex_and_age_codes", "pair_consistency", "merge_known_first_record",
    "closest_to_midwinter", "exact_quantiles", "habitat_size_weights", "fuzzy_name_pairs", "points_in_polygons",
    "nearest_site", "water_system_clusters", "migration_distance", "weighted_histogram", "kernel_density",
    "weighted_draws", "weighted_winters", "entity_resolution", "build_dataset", "site_weights",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    only = sys.argv[1:] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    tables = Tables(spark, sf_dir)
    tables.events.count()  # start the executor threads before the clock runs
    seconds = {}
    for name in only:
        start = time.time()
        all_queries()[name].run(tables).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
