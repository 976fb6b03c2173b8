"""What happens to events before a watermark sees them: late ones are kept and counted, quiet streams get a pulse."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fileguard.functions.time import with_event_time
from fileguard.schemas import FILE_EVENTS
from fileguard.session import folder_exists, move_folder
from fileguard.sources.events import missing_column

GATED = T.StructType([*FILE_EVENTS.fields, T.StructField("ts_us", T.LongType())])
ON_TIME, LATE, REJECTED = "on_time", "late", "rejected"
_MARK = "newest_us long, on_time long, late long, rejected long"


def gate_stream(events: DataFrame, folder: str, checkpoint: str, delay_seconds: float = 10, trigger: dict | None = None):
    """Start the query that sorts arriving events into ``folder/rows/batch_id=N/gate=on_time|late|rejected``.

    The rule is that of a watermark: late is what is at least ``delay_seconds`` older than the newest event of all earlier
    micro-batches; rejected is what lacks its id, time or drive. A micro-batch appears in one rename, and one that is repeated
    after a crash finds its rows and keeps them, so nothing is doubled. ``folder/marks`` holds the newest time and the
    cumulative counts after each micro-batch. ``gated_events`` reads the rows on time as a stream; its watermark of the same
    delay drops none of them.
    """
    delay_us = int(delay_seconds * 1_000_000)

    def sort(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = None
        if batch_id and folder_exists(spark, f"{folder}/marks/batch_id={batch_id - 1}"):
            before = spark.read.schema(_MARK).parquet(f"{folder}/marks/batch_id={batch_id - 1}").first()
        elif batch_id:
            raise ValueError(f"the mark of micro-batch {batch_id - 1} is missing in {folder}")
        target = f"{folder}/rows/batch_id={batch_id}"
        if not folder_exists(spark, target):
            newest = before["newest_us"] if before else None
            # A watermark counts whole milliseconds.
            limit = F.lit(None) if newest is None else F.lit((newest - delay_us) // 1000 * 1000)
            gate = F.when(missing_column().isNotNull(), REJECTED).when(F.col("ts_us") <= limit, LATE).otherwise(ON_TIME)
            attempt = f"{folder}/_attempts/{uuid.uuid4().hex}"
            with_event_time(batch).withColumn("gate", gate).select(*GATED.fieldNames(), "gate").write.partitionBy("gate").parquet(attempt)
            move_folder(spark, attempt, target)
        rows = spark.read.schema(T.StructType([*GATED.fields, T.StructField("gate", T.StringType())])).parquet(target)
        counts = rows.agg(
            F.max(F.when(F.col("gate") != REJECTED, F.col("ts_us"))).alias("newest_us"),
            *(F.count_if(F.col("gate") == g).alias(g) for g in (ON_TIME, LATE, REJECTED)),
        ).first()
        newest = max((x["newest_us"] for x in (before, counts) if x and x["newest_us"] is not None), default=None)
        total = [counts[g] + (before[g] if before else 0) for g in (ON_TIME, LATE, REJECTED)]
        spark.createDataFrame([(newest, *total)], _MARK).coalesce(1).write.mode("overwrite").parquet(f"{folder}/marks/batch_id={batch_id}")

    writer = events.writeStream.foreachBatch(sort).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "3 seconds"})).start()


def _rows(spark: SparkSession, folder: str, gate: str) -> DataFrame:
    fields = [*GATED.fields, T.StructField("batch_id", T.LongType()), T.StructField("gate", T.StringType())]
    return spark.read.schema(T.StructType(fields)).parquet(f"{folder}/rows").where(F.col("gate") == gate).drop("gate")


def late_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events that came too late, with the micro-batch that brought them."""
    return _rows(spark, folder, LATE)


def rejected_rows(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(spark, folder, REJECTED)


def gated_events(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """The events on time as a stream."""
    fields = [*GATED.fields, T.StructField("batch_id", T.LongType()), T.StructField("gate", T.StringType())]
    reader = spark.readStream.schema(T.StructType(fields))
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{folder}/rows").where(F.col("gate") == ON_TIME).select(*GATED.fieldNames())


def gate_counts(spark: SparkSession, folder: str) -> DataFrame:
    """newest_us and the numbers of events on time, late and rejected, over all micro-batches so far."""
    fields = [*T._parse_datatype_string(_MARK).fields, T.StructField("batch_id", T.LongType())]
    marks = spark.read.schema(T.StructType(fields)).parquet(f"{folder}/marks")
    return marks.orderBy(F.desc("batch_id")).limit(1).drop("batch_id")


def with_pulse(events: DataFrame, every_seconds: int = 1) -> DataFrame:
    """``events`` (a live stream) and one row each ``every_seconds`` that has the time of the clock and no id or drive.

    A watermark moves only when rows come. The pulse lets it follow the clock, so that the last events of a quiet stream are decided
    one delay and one poll after they happened. Order rule: the watermark is the newer of the newest event and the clock, less
    the delay; timers fire when it passes them, whichever of the two moved it. An event that arrives more than the delay
    after it happened is late, so ``delay`` has to cover the way from the source, and a replay of old events takes no pulse.
    """
    ticks = events.sparkSession.readStream.format("rate").option("rowsPerSecond", 1).load()
    ticks = ticks.where(F.pmod("value", F.lit(every_seconds)) == 0)
    seconds = F.unix_micros("timestamp") / F.lit(1_000_000.0)
    named = {f.name: seconds if f.name == "timestamp" else F.lit(None) for f in FILE_EVENTS.fields}
    pulse = ticks.select(*(named[f.name].cast(f.dataType).alias(f.name) for f in FILE_EVENTS.fields))
    return events.select(*FILE_EVENTS.fieldNames()).unionByName(pulse)
