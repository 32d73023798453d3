"""Times the headline queries; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "speed_events", "length_pivot", "filament_table", "object_table", "rooted_labels", "violation_summary", "mutual_unique_links",
    "nway_match_counts", "nearest_neighbour", "label_contingency", "label_overlap_map", "region_maxima", "template_correlation",
    "best_split", "corrected_labels", "entity_components",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from tendril.plans import load
    from tendril.session import get_spark

    spark = get_spark(f"local[{cpus}]", shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    queries = load().QUERIES
    queries["several_steps"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm up
    times = {}
    for name in HEADLINE:
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
