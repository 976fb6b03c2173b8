"""Append-only alert log and the per-attack export."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fileguard.schemas import ALERT_LOG
from fileguard.session import folder_exists

#: Tasks that an attack's events are exported by, at most.
EXPORT_SHARES = 8
#: Marks of the log that is appended to by micro-batch.
COMMITTED = "drive_id long, attempt string, alerts long, at_us long, batch_id long"


def alert_log(alert_rows: DataFrame) -> DataFrame:
    """Alerts in the shape of the log."""
    event = F.col("triggering_event")
    trigger = F.when(
        event.isNotNull(),
        F.struct(
            *[event[f.name].cast(f.dataType).alias(f.name) for f in ALERT_LOG["triggering_event"].dataType.fields]
        ),
    )
    return alert_rows.withColumn("triggering_event", trigger).select(*ALERT_LOG.fieldNames())


def append_alerts(alert_rows: DataFrame, path: str, file_format: str = "json") -> None:
    """Add files to the log. Nothing that is already there is rewritten, so a failed write cannot lose history."""
    alert_log(alert_rows).write.mode("append").format(file_format).save(path)


def read_alerts(spark: SparkSession, path: str, file_format: str = "json", multi_line: bool = False) -> DataFrame:
    """Read the log; ``multi_line`` reads files that hold one JSON array."""
    reader = spark.read.schema(ALERT_LOG).format(file_format)
    return (reader.option("multiLine", True) if multi_line else reader).load(path)


def write_attempt(alert_rows: DataFrame, path: str, batch_id: int) -> str:
    """Write alerts (with ``drive_id``) of a micro-batch below ``path`` without committing them; returns the attempt's name."""
    attempt = uuid.uuid4().hex
    done = commits(alert_rows.sparkSession, path).where(F.col("batch_id") == batch_id).select("drive_id")
    left = alert_rows.join(done, "drive_id", "left_anti")
    alert_log(left).write.parquet(f"{path}/rows/batch_id={batch_id}/attempt={attempt}")
    return attempt


def commit_attempt(spark: SparkSession, path: str, batch_id: int, attempt: str) -> None:
    """Commit what an attempt has written: one mark for each drive and micro-batch. A mark is a row, so it is there or not."""
    rows = spark.read.schema(ALERT_LOG).parquet(f"{path}/rows/batch_id={batch_id}/attempt={attempt}")
    marks = rows.groupBy("drive_id").agg(F.count("*").alias("alerts"))
    marks.select("drive_id", F.lit(attempt).alias("attempt"), "alerts", F.unix_micros(F.current_timestamp()).alias("at_us")).write.mode(
        "overwrite"
    ).parquet(f"{path}/commits/batch_id={batch_id}/try={attempt}")


def append_alerts_once(alert_rows: DataFrame, path: str, batch_id: int) -> None:
    """Append the alerts of a micro-batch. Repeating it, whenever it was cut off, neither loses nor doubles an alert: rows count
    only with a mark for their drive and micro-batch, and a marked drive is not written again."""
    commit_attempt(alert_rows.sparkSession, path, batch_id, write_attempt(alert_rows, path, batch_id))


def commits(spark: SparkSession, path: str) -> DataFrame:
    """(drive_id, batch_id, attempt, alerts): the first mark of each drive and micro-batch."""
    empty = spark.createDataFrame([], COMMITTED)
    if not folder_exists(spark, f"{path}/commits"):
        return empty.select("drive_id", "batch_id", "attempt", "alerts")
    marks = spark.read.schema(COMMITTED).parquet(f"{path}/commits")
    first = F.min(F.struct("at_us", "attempt", "alerts")).alias("m")
    return marks.groupBy("drive_id", "batch_id").agg(first).select("drive_id", "batch_id", "m.attempt", "m.alerts")


def read_alerts_once(spark: SparkSession, path: str) -> DataFrame:
    """The committed alerts, each once: the columns of the log and ``batch_id``."""
    fields = [*ALERT_LOG.fields, T.StructField("batch_id", T.LongType()), T.StructField("attempt", T.StringType())]
    if not folder_exists(spark, f"{path}/rows"):
        return spark.createDataFrame([], T.StructType(fields)).drop("attempt")
    rows = spark.read.schema(T.StructType(fields)).parquet(f"{path}/rows")
    return rows.join(commits(spark, path).drop("alerts"), ["drive_id", "batch_id", "attempt"], "left_semi").drop("attempt")


def append_audit(audited: DataFrame, path: str) -> None:
    """Append the audit trail, one folder per event day; forensics read it back by day."""
    day = F.date_format(F.timestamp_micros("ts_us"), "yyyy-MM-dd")
    audited.withColumn("event_day", day).write.mode("append").partitionBy("event_day").parquet(path)


def export_attacks(events: DataFrame, path: str) -> None:
    """One CSV folder per drive and attack with the attack's events. Rows are dealt by attack first, a large one to several tasks, so
    that a task writes to few folders."""
    flat = [name for name, kind in events.dtypes if not kind.startswith(("array", "struct", "map"))]
    dealt = events.select(*flat).repartition("drive_id", "attack_no", F.pmod(F.xxhash64("id"), F.lit(EXPORT_SHARES)))
    dealt.write.mode("overwrite").partitionBy("drive_id", "attack_no").csv(path, header=True)
