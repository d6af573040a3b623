"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINES = (
    "sightings_camera", "sightings_file", "recording_stretches", "dedup_hits", "class_histogram", "merge_coverage", "uncovered_chunks",
    "motion_events", "event_manifest", "frame_lookup", "clip_classes", "nearest_px", "overlapping_boxes", "wall_match", "download_speed", "recent_rate", "stream_sightings",
)


def main() -> None:
    from weir import catalog
    from weir.session import build_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("weir-bench", cpus, 8)
    spark.sparkContext.setLogLevel("ERROR")
    known = catalog.queries()
    known["sightings_camera"](spark, sf).write.format("noop").mode("overwrite").save()  # starts the engine
    took, rows = {}, {}
    for name in HEADLINES:
        began = time.perf_counter()
        rows[name] = known[name](spark, sf).count() if name.startswith("stream") else None
        if rows[name] is None:
            known[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    events = spark.read.parquet(f"{sf}/events.parquet").count()
    per_s = {n: round(events / took[n]) for n in ("sightings_camera", "motion_events", "dedup_hits", "merge_coverage") if took[n]}
    print(json.dumps({"metric": "headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf.rstrip("/").rsplit("/", 1)[-1].removeprefix("sf"), "input_rows_per_s": per_s}))
    spark.stop()


if __name__ == "__main__":
    main()
