"""Column functions over event times. Times are compared as whole microseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fileguard.params import MICROS


def micros(seconds: Column) -> Column:
    return F.round(seconds * F.lit(float(MICROS))).cast("bigint")


def with_event_time(events: DataFrame) -> DataFrame:
    """Add ``ts_us``, the epoch seconds of ``timestamp`` as integer microseconds."""
    return events if "ts_us" in events.columns else events.withColumn("ts_us", micros(F.col("timestamp")))


def slot(ts_us: Column, width_us: int) -> Column:
    """Number of the fixed-width slot a time falls in."""
    return F.floor(ts_us / F.lit(width_us)).cast("bigint")


def minute_of(seconds: Column) -> Column:
    return F.floor(seconds / F.lit(60.0)).cast("bigint")


def behind_watermark(condition: Column) -> Column:
    """``condition`` as a filter that stays behind ``withWatermark``: the optimizer moves only deterministic ones in front of it, and
    rows that are filtered there do not move the watermark."""
    return F.when(F.spark_partition_id() >= 0, condition)
