"""Trailing-window detectors. An event sees every event of its drive in the closed window that ends at its time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fileguard.functions import text
from fileguard.functions.time import slot, with_event_time
from fileguard.operators.scans import trailing_counts
from fileguard.params import DecisionParams, DetectorParams, ScanParams


def _is_rename() -> Column:
    return F.col("event_type") == "RENAMED"


def _rename_token() -> Column:
    return text.last_token(F.coalesce(F.col("local_title"), F.lit("")))


def window_measures(
    events: DataFrame, detector: DetectorParams = DetectorParams(), scan: ScanParams = ScanParams(), files: bool = True
) -> DataFrame:
    """Add the window's write count, rename count, number of distinct rename extensions and of distinct files."""
    distinct = {"rename_extensions": (_is_rename(), _rename_token())}
    if files:
        distinct["recent_files"] = (F.lit(True), F.col("stable_id"))
    return trailing_counts(
        with_event_time(events),
        counts={"recent_writes": F.col("event_type").isin(*detector.write_types), "recent_renames": _is_rename()},
        distinct=distinct,
        window_us=detector.window_us,
        chunk_us=scan.chunk_us,
        rows_per_piece=scan.rows_per_piece,
    )


def flag_columns(detector: DetectorParams = DetectorParams()) -> dict[str, Column]:
    """Both flags over the window measures. Deletions are not writes, so bulk deletion alone never trips velocity."""
    return {
        "high_velocity": F.col("recent_writes") > detector.velocity_threshold,
        "systematic_rename": (F.col("recent_renames") >= detector.rename_threshold)
        & (F.col("rename_extensions") == 1),
    }


def detector_flags(
    events: DataFrame, detector: DetectorParams = DetectorParams(), scan: ScanParams = ScanParams(), files: bool = True
) -> DataFrame:
    return window_measures(events, detector, scan, files).withColumns(flag_columns(detector))


def high_velocity(
    events: DataFrame, detector: DetectorParams = DetectorParams(), scan: ScanParams = ScanParams()
) -> DataFrame:
    """Add ``recent_writes`` and ``high_velocity``."""
    counted = trailing_counts(
        with_event_time(events),
        counts={"recent_writes": F.col("event_type").isin(*detector.write_types)},
        window_us=detector.window_us,
        chunk_us=scan.chunk_us,
        rows_per_piece=scan.rows_per_piece,
    )
    return counted.withColumn("high_velocity", flag_columns(detector)["high_velocity"])


def systematic_rename(
    events: DataFrame, detector: DetectorParams = DetectorParams(), scan: ScanParams = ScanParams()
) -> DataFrame:
    """Add ``recent_renames``, ``rename_extensions`` and ``systematic_rename``."""
    counted = trailing_counts(
        with_event_time(events),
        counts={"recent_renames": _is_rename()},
        distinct={"rename_extensions": (_is_rename(), _rename_token())},
        window_us=detector.window_us,
        chunk_us=scan.chunk_us,
        rows_per_piece=scan.rows_per_piece,
    )
    return counted.withColumn("systematic_rename", flag_columns(detector)["systematic_rename"])


def recent_files_affected(
    events: DataFrame, detector: DetectorParams = DetectorParams(), scan: ScanParams = ScanParams()
) -> DataFrame:
    """Add ``recent_files``, the number of distinct files touched in the window."""
    return trailing_counts(
        with_event_time(events),
        distinct={"recent_files": (F.lit(True), F.col("stable_id"))},
        window_us=detector.window_us,
        chunk_us=scan.chunk_us,
        rows_per_piece=scan.rows_per_piece,
    )


def with_batch(events: DataFrame, decision: DecisionParams = DecisionParams()) -> DataFrame:
    """Add ``batch``, the poll interval the event falls in."""
    return with_event_time(events).withColumn("batch", slot(F.col("ts_us"), decision.poll_us))


def batch_flags(flagged: DataFrame, decision: DecisionParams = DecisionParams()) -> DataFrame:
    """Per poll batch, the flags every event of the batch shares: those at the batch's last event time."""
    last = F.struct("ts_us", "id")
    return (
        with_batch(flagged, decision)
        .groupBy("drive_id", "batch")
        .agg(
            F.count("*").alias("events"),
            F.max_by("high_velocity", last).alias("high_velocity"),
            F.max_by("systematic_rename", last).alias("systematic_rename"),
        )
    )
