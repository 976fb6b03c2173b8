"""Continuous detection: the batch operators run on every slice of released events plus what they look back on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fileguard.operators.decisions import alerts, batch_threat
from fileguard.operators.snapshots import snapshot_chain
from fileguard.params import EngineParams
from fileguard.plans.detection import scored_with_context
from fileguard.session import folder_exists
from fileguard.sources.alerts import alert_log
from fileguard.streaming.ordered import ORDERED_EVENTS, ordered_events


class SlotTable:
    """A small table rewritten every micro-batch in two alternating folders: a repeated batch finds its input intact."""

    def __init__(self, path: str):
        self.path = path

    def read(self, spark: SparkSession, batch_id: int) -> DataFrame | None:
        """The table after the micro-batch before, None before the first. Every micro-batch writes it, so if it is not there it
        was lost, and going on without it would decide events as if they had no history."""
        if batch_id == 0:
            return None
        path = f"{self.path}/slot={(batch_id - 1) % 2}"
        if not folder_exists(spark, path):
            raise ValueError(f"{path} is missing: the stream's look-back is lost, start it with a new checkpoint")
        return spark.read.parquet(path)

    def write(self, rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/slot={batch_id % 2}")


def context_of(rows: DataFrame, params: EngineParams) -> DataFrame:
    """What later events of a drive look back on: its last window of time and its last sequence of ids.

    Bounded by one window's events per drive. Both filters are cut down before the rows are shuffled: the newest time
    is an aggregate, the newest ids a top-n.
    """
    last = rows.groupBy("drive_id").agg(F.max("ts_us").alias("_last"))
    recent = (
        rows.join(last, "drive_id").where(F.col("ts_us") >= F.col("_last") - params.detector.window_us).drop("_last")
    )
    newest = Window.partitionBy("drive_id").orderBy(F.desc("id"))
    tail = rows.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") < params.hmm.length).drop("_n")
    return recent.unionByName(tail.join(recent.select("drive_id", "id"), ["drive_id", "id"], "left_anti"))


def detection_stream(
    events: DataFrame,
    output: str,
    checkpoint: str,
    params: EngineParams = EngineParams(),
    sep: str = "/",
    model=None,
    delay: str = "10 seconds",
    title_ttl_ms: int | None = None,
    trigger: dict | None = None,
):
    """Start the query: scored events go to ``output/scored``, alerts to ``output/alerts``, one folder per micro-batch.

    Every event is decided once its poll interval lies behind the watermark, so the results equal the batch plan's
    whatever the micro-batches are. A repeated micro-batch overwrites its own folders, which makes the sinks
    idempotent. Look-back rows and each drive's last alert are kept in ``checkpoint/tables``.
    """
    context, last_alerts = SlotTable(f"{checkpoint}/tables/context"), SlotTable(f"{checkpoint}/tables/last_alerts")

    def decide(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = context.read(spark, batch_id)
        rows = batch.withColumn("_new", F.lit(True))
        if before is not None:
            rows = rows.unionByName(before.withColumn("_new", F.lit(False)))
        rows = rows.persist()
        try:
            scored = scored_with_context(rows, params, sep, model).where("_new").drop("_new", "entropies")
            scored_path = f"{output}/scored/batch_id={batch_id}"
            scored.write.mode("overwrite").parquet(scored_path)
            stored = spark.read.schema(scored.schema).parquet(scored_path)
            history = last_alerts.read(spark, batch_id)
            found = alerts(batch_threat(stored, params.decision, params.scan), params.decision, history)
            alert_path = f"{output}/alerts/batch_id={batch_id}"
            found.write.mode("overwrite").parquet(alert_path)
            kept = spark.read.schema(found.schema).parquet(alert_path)
            context.write(context_of(rows.drop("_new"), params).select(*ORDERED_EVENTS.fieldNames()), batch_id)
            paused = F.col("sync_paused") | F.col("threat_level").isin("HIGH", "CRITICAL")
            latest = kept.select("drive_id", "ts_us", paused.alias("paused"))
            latest = latest if history is None else latest.unionByName(history)
            last_alerts.write(
                latest.groupBy("drive_id").agg(F.max("ts_us").alias("ts_us"), F.bool_or("paused").alias("paused")),
                batch_id,
            )
        finally:
            rows.unpersist()

    released = ordered_events(events, delay, params.decision.poll_seconds, title_ttl_ms)
    writer = released.writeStream.foreachBatch(decide).option("checkpointLocation", f"{checkpoint}/query")
    return writer.trigger(**(trigger or {"processingTime": f"{params.decision.poll_seconds} seconds"})).start()


def read_scored(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.parquet(f"{output}/scored")


def read_stream_alerts(spark: SparkSession, output: str) -> DataFrame:
    return alert_log(spark.read.parquet(f"{output}/alerts"))


def snapshot_stream(snapshots: DataFrame, output: str, checkpoint: str, trigger: dict | None = None):
    """Start the query that turns arriving snapshots into events under ``output``, one folder per micro-batch.

    A drive's snapshot must arrive whole within one micro-batch. Its newest snapshot is kept as a table and starts
    the chain of the next micro-batch.
    """
    newest = SlotTable(f"{checkpoint}/tables/newest")

    def compare(batch: DataFrame, batch_id: int) -> None:
        before = newest.read(batch.sparkSession, batch_id)
        rows = batch if before is None else batch.unionByName(before)
        rows = rows.persist()
        try:
            snapshot_chain(rows).write.mode("overwrite").parquet(f"{output}/batch_id={batch_id}")
            last = rows.groupBy("drive_id").agg(F.max("snapshot_id").alias("snapshot_id"))
            newest.write(rows.join(last, ["drive_id", "snapshot_id"]).select(*batch.columns), batch_id)
        finally:
            rows.unpersist()

    writer = snapshots.writeStream.foreachBatch(compare).option("checkpointLocation", f"{checkpoint}/query")
    return writer.trigger(**(trigger or {"processingTime": "5 seconds"})).start()


def attack_session_stream(
    scored: DataFrame, alert: float = 0.5, gap: str = "60 seconds", delay: str = "10 seconds"
) -> DataFrame:
    """Attacks of a stream of scored events, each emitted once the watermark has passed its end plus the gap."""
    suspicious = scored.where((F.col("fused") >= alert) | F.coalesce(F.col("malicious"), F.lit(False)))
    timed = suspicious.withColumn("event_time", F.timestamp_micros("ts_us")).withWatermark("event_time", delay)
    sessions = timed.groupBy("drive_id", F.session_window("event_time", gap).alias("w")).agg(
        F.min("ts_us").alias("start_us"),
        F.max("ts_us").alias("end_us"),
        F.count("*").alias("events"),
        F.max("fused").alias("peak_score"),
    )
    return sessions.drop("w")
