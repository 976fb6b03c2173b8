"""Registered streams. Each lays the driver's rows out as arriving files, cut in awkward places, and runs a stream that is stopped
and started again from its checkpoint at every cut; what it has written is compared with the batch operator's SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from fileguard.operators import decisions
from fileguard.plans import adapters, detection
from fileguard.plans.settings import DELAY_SECONDS, PARAMS, PARTS, POLL_CUT
from fileguard.schemas import FILE_EVENTS
from fileguard.session import cut_lineage, keyed_state, working_folder
from fileguard.sources.alerts import append_alerts_once, commit_attempt, read_alerts_once, write_attempt
from fileguard.sources.snapshots import ITEMS
from fileguard.streaming.attacks import attacks_stream
from fileguard.streaming.intake import gate_counts, gate_stream, late_events
from fileguard.streaming.snapshots import snapshot_events_stream
from fileguard.streaming.windows import MEASURES, flags_stream

DELAY = f"{DELAY_SECONDS} seconds"
#: Far enough for the watermark to pass everything before it.
END_US = 1_000_000_000_000
#: Drive of the row that ends a stream; it is never released.
NOBODY = -1


def by_time(rows: DataFrame, jitter_us: int = 0) -> DataFrame:
    """``rows`` with ``part``, the file they arrive in: by time, each up to six ``jitter_us`` late."""
    low, high = rows.agg(F.min("ts_us"), F.max("ts_us")).first()
    arrival = F.col("ts_us") + F.col("id") % 7 * jitter_us
    part = F.floor((arrival - (low or 0)) * PARTS / ((high or 0) - (low or 0) + 1))
    return rows.withColumn("part", F.least(part, F.lit(PARTS - 1)).cast("int"))


def end_of(rows: DataFrame) -> DataFrame:
    """One more row, of no drive, long after all others, in the last part."""
    last = rows.agg(F.max("ts_us").alias("ts_us")).withColumn("ts_us", F.coalesce("ts_us", F.lit(0)) + END_US)
    known = {"drive_id": F.lit(NOBODY), "ts_us": F.col("ts_us"), "timestamp": F.col("ts_us") / 1_000_000.0, "id": F.lit(NOBODY), "part": F.lit(PARTS - 1)}
    return last.select(*(known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema.fields))


def replayed(spark: SparkSession, rows: DataFrame, name: str, started: Callable[[DataFrame, str], StreamingQuery], parts: int = PARTS) -> str:
    """Let ``rows`` (with ``part``) arrive part by part; ``started`` begins the stream over what is there, again and again from one
    checkpoint. Returns the folder it works in."""
    folder = working_folder(spark, name)
    laid = cut_lineage(rows)
    schema = laid.drop("part").schema
    for part in range(parts):
        laid.where(F.col("part") == part).drop("part").write.parquet(f"{folder}/in/{part}")
        with keyed_state(spark):
            running = started(spark.readStream.schema(schema).parquet(f"{folder}/in/*"), folder)
            running.awaitTermination()
    return folder


def to_files(rows: DataFrame, folder: str) -> StreamingQuery:
    """Start a query that writes each micro-batch to a folder of its own, which a repeated one replaces."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch_id={batch_id}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/query").trigger(availableNow=True).start()


def stream_flags(spark: SparkSession, d: str) -> DataFrame:
    events = by_time(adapters.file_events(spark, d), 1_500_000)
    folder = replayed(
        spark, events.unionByName(end_of(events)), "stream-flags",
        lambda arriving, to: to_files(flags_stream(arriving, PARAMS, DELAY), to),
    )
    kept = ("drive_id", "id", "ts_us", *MEASURES, "high_velocity", "systematic_rename")
    return spark.read.parquet(f"{folder}/out").select(*kept)


def stream_attacks(spark: SparkSession, d: str) -> DataFrame:
    scored = detection.scored_events(adapters.file_events(spark, d), PARAMS)
    rows = by_time(cut_lineage(scored.select("id", "drive_id", "ts_us", "stable_id", "fused", "malicious")), 1_500_000)
    folder = replayed(
        spark, rows.unionByName(end_of(rows)), "stream-attacks",
        lambda arriving, to: to_files(attacks_stream(arriving, PARAMS.decision, delay=DELAY), to),
    )
    return spark.read.parquet(f"{folder}/out").drop("batch_id").withColumn("peak_score", F.round("peak_score", 6))


def late_events_kept(spark: SparkSession, d: str) -> DataFrame:
    """Every 97th event arrives two parts late, every thousandth lacks its time."""
    events = by_time(adapters.file_events(spark, d))
    slow = F.when(F.col("id") % 97 == 0, F.least(F.col("part") + 2, F.lit(PARTS - 1))).otherwise(F.col("part"))
    rows = events.withColumn("part", slow).withColumn("timestamp", F.when(F.col("id") % 1000 != 7, F.col("timestamp")))
    named = [F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in FILE_EVENTS.fields]
    folder = replayed(
        spark, rows.select(*named, "part"), "late-events",
        lambda arriving, to: gate_stream(arriving, f"{to}/gate", f"{to}/query", DELAY_SECONDS, {"availableNow": True}),
    )
    totals = gate_counts(spark, f"{folder}/gate").drop("newest_us")
    return late_events(spark, f"{folder}/gate").select("id", "drive_id", "ts_us", "batch_id").join(F.broadcast(totals))


def stream_snapshot_events(spark: SparkSession, d: str) -> DataFrame:
    """The fifth poll finds both drives empty: nothing arrives but its mark. Cuts lie inside polls."""
    rows = adapters.snapshot_series(spark, d)
    polls = rows.select("drive_id", "snapshot_id", "snapshot_ts").distinct()
    marks = polls.withColumn("place", F.col("snapshot_id") * 10 + 9)
    items = rows.where("snapshot_id <> 5").withColumn("place", F.col("snapshot_id") * 10 + F.col("stable_id") % 10)
    both = items.unionByName(marks, allowMissingColumns=True).withColumn("part", F.floor(F.col("place") / POLL_CUT).cast("int"))
    shaped = both.select(*(F.col(f.name).cast(f.dataType) for f in ITEMS.fields), "part")
    folder = replayed(
        spark, shaped, "stream-snapshots", lambda arriving, to: to_files(snapshot_events_stream(arriving), to), 129 // POLL_CUT + 1
    )
    return spark.read.parquet(f"{folder}/out").drop("batch_id").withColumn("snapshot_ts", F.col("snapshot_ts").cast("bigint"))


def alert_log_replayed(spark: SparkSession, d: str) -> DataFrame:
    """Four micro-batches of alerts; one is cut off between files and mark, one after its mark, one after the marks of one drive."""
    found = cut_lineage(decisions.alerts(decisions.batch_threat(detection.scored_events(adapters.file_events(spark, d), PARAMS), PARAMS.decision, PARAMS.scan), PARAMS.decision))
    log = working_folder(spark, "alert-log")
    for batch_id in range(4):
        mine = found.where(F.col("batch") % 4 == batch_id)
        if batch_id == 1:
            write_attempt(mine, log, batch_id)
        if batch_id == 2:
            append_alerts_once(mine, log, batch_id)
        if batch_id == 3:
            commit_attempt(spark, log, batch_id, write_attempt(mine.where("drive_id = 0"), log, batch_id))
        append_alerts_once(mine, log, batch_id)
    return read_alerts_once(spark, log).select(
        "drive_id", "batch_id", "timestamp", "threat_level", F.round("probability", 6).alias("probability"), "affected_files_count", "sync_paused",
        F.col("triggering_event.id").alias("trigger_id"),
    )


QUERIES = {
    "stream_flags": stream_flags, "stream_attacks": stream_attacks, "late_events": late_events_kept,
    "stream_snapshot_events": stream_snapshot_events, "alert_log_replayed": alert_log_replayed,
}
