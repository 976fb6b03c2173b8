"""File-event tables: incremental reads and append-only writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fileguard.schemas import FILE_EVENTS


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILE_EVENTS).parquet(path)


def stream_events(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(FILE_EVENTS)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def _day(seconds: Column) -> Column:
    return F.date_format(F.timestamp_micros((seconds * 1_000_000).cast("bigint")), "yyyy-MM-dd")


def append_events(events: DataFrame, path: str) -> None:
    """Append rows, one folder per event day, so that reads of a recent period skip the other days."""
    events.withColumn("event_day", _day(F.col("timestamp"))).write.mode("append").partitionBy("event_day").parquet(path)


def missing_column() -> Column:
    """The first of the columns that place an event which is NULL, or NULL if it has them all."""
    placed = ("id", "timestamp", "drive_id")
    return F.coalesce(*[F.when(F.col(c).isNull(), c) for c in placed])


def accepted_events(events: DataFrame) -> DataFrame:
    """Events with an id, a time and a drive; the ordered scans need all three."""
    return events.where(missing_column().isNull())


def rejected_events(events: DataFrame) -> DataFrame:
    """How many events ``accepted_events`` leaves out, by drive and the first column that is missing."""
    return events.groupBy("drive_id", missing_column().alias("missing")).agg(F.count("*").alias("n")).where("missing is not null")


def events_since(events: DataFrame, last_id: int) -> DataFrame:
    """Events after a high-water id. Order matters only inside windows, so no global sort."""
    return events.where(F.col("id") > last_id)


def events_recent(events: DataFrame, now: float | Column, days: float = 7) -> DataFrame:
    """Events of the last ``days`` days before ``now`` (epoch seconds). A table written by ``append_events`` also gives the
    day, so that older folders are not opened."""
    since = now - days * 86_400
    recent = events.where(F.col("timestamp") >= since)
    if "event_day" not in events.columns:
        return recent
    return recent.where(F.col("event_day") >= _day(since if isinstance(since, Column) else F.lit(since)))
