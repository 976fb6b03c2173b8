"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

BENCH_COPIES=n additionally repeats every drive n times under new drive ids for the detection queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F

from fileguard.operators import decisions, detectors, features
from fileguard.plans import adapters, detection, registry
from fileguard.plans.settings import PARAMS
from fileguard.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
COPIES = int(os.environ.get("BENCH_COPIES", "1"))


def events(spark):
    rows = adapters.file_events(spark, SF_DIR)
    if COPIES == 1:
        return rows
    copy = F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1)))
    return rows.withColumn("_copy", copy).withColumn("drive_id", F.col("drive_id") + 2 * F.col("_copy")).drop("_copy")


def headline(spark):
    yield "previous_title", lambda: features.previous_title(events(spark), PARAMS.scan)
    yield "file_features", lambda: features.file_features(events(spark), "/", PARAMS.scan)
    yield "high_velocity", lambda: detectors.high_velocity(events(spark), PARAMS.detector, PARAMS.scan)
    yield "systematic_rename", lambda: detectors.systematic_rename(events(spark), PARAMS.detector, PARAMS.scan)
    yield "recent_files_affected", lambda: detectors.recent_files_affected(events(spark), PARAMS.detector, PARAMS.scan)
    yield "scored_events", lambda: detection.scored_events(events(spark), PARAMS).drop("entropies")
    yield "batch_threat", lambda: decisions.batch_threat(
        detection.scored_events(events(spark), PARAMS), PARAMS.decision, PARAMS.scan
    )
    yield "alerts", lambda: detection.detect(events(spark), PARAMS)
    names = (
        "fused_scores hmm_state alert_cooldown snapshot_diff snapshot_paths snapshot_chain activity_baseline "
        "stratified_split roc_auc detector_sweep hmm_separability attack_sessions restore_points"
    ).split()
    for name in names if COPIES == 1 else []:
        yield name, lambda name=name: registry.QUERIES[name](spark, SF_DIR)


def main() -> None:
    spark = local_session(CPUS)
    adapters.table(spark, SF_DIR, "events").groupBy("event_type").count().collect()
    seconds = {}
    for name, build in headline(spark):
        start = time.time()
        build().write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "cpus": CPUS,
                "copies": COPIES,
            }
        )
    )


if __name__ == "__main__":
    main()
