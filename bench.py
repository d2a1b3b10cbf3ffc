"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from tessella.plans import catalog
from tessella.session import local_session

HEADLINE = (
    "change_points", "range_scan", "keyset_page", "pricing_summary", "state_transitions", "sessionize_gap", "interval_match", "mutual_unique_match",
    "gallery_top2_margin", "iou_pairs", "nms_frames", "box_match_global", "exact_dedup", "stratified_sample", "report_cube", "weekly_summary", "hist_quantile",
    "near_duplicate_pairs", "component_members", "tracker_replay", "face_owners", "search_newest",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, max(8, cpus), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = catalog.queries(), {}
    spark.range(1000).selectExpr("sum(id)").collect()  # the session's own start is not a query's time
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
