"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line.

Each query is timed once after a warm-up of the session; results go to Spark's no-op sink, so every
row and column is computed.
"""

from __future__ import annotations

import json
import os
import time

from framewright.plans.catalog import QUERIES
from framewright.session import local_session

HEADLINE = (
    "dataset_stats", "class_details", "qa_run", "qa_overlap", "label_pairs", "issue_summary",
    "split_stratified", "kfold", "merge", "voxel_mean", "sample_voxel_first", "octree_levels",
    "project_points", "box3d_project", "fusion_candidates", "fusion_match", "frustum_points",
    "lift_box", "nearest_time_sync", "hash_similarity_join", "cosine_similarity_join", "dup_groups",
    "radius_neighbors", "knn", "trigger_priority", "review_apply_edits", "read_yolo", "read_coco",
    "redact_points", "view_projection",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split() or list(HEADLINE)
    spark = local_session("bench", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["class_distribution"](spark, sf).write.format("noop").mode("overwrite").save()
    took: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
        if os.environ.get("BENCH_VERBOSE"):
            print(name, took[name], flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec",
        "queries": took, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"), "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
