"""Attacks: runs of suspicious events, what happened inside them, and what to restore."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fileguard.functions import text
from fileguard.functions.time import slot, with_event_time
from fileguard.operators.decisions import threat_level
from fileguard.operators.scans import live_runs, previous_value
from fileguard.params import MICROS, DecisionParams, ScanParams

GAP_SECONDS = 60


def is_suspicious(decision: DecisionParams = DecisionParams()) -> Column:
    return (F.col("fused") >= decision.alert) | F.coalesce(F.col("malicious"), F.lit(False))


def attack_slots(
    scored: DataFrame, decision: DecisionParams = DecisionParams(), gap_seconds: int = GAP_SECONDS
) -> DataFrame:
    """(drive, slot) rows with ``attack_no`` and the attack's ``start_us`` and ``end_us``.

    Attacks are maximal runs of suspicious events with gaps of at most ``gap_seconds``, numbered per drive. Every
    slot of that width inside an attack has a suspicious event, so joining on (drive, slot) finds the attack of any
    event without a range join.
    """
    runs = live_runs(
        with_event_time(scored).where(is_suspicious(decision)), ["drive_id"], "ts_us", gap_seconds * MICROS
    )
    return runs.select(
        "drive_id",
        "slot",
        F.col("run_no").cast("bigint").alias("attack_no"),
        F.col("run_start").alias("start_us"),
        F.col("run_end").alias("end_us"),
    )


def attack_events(
    scored: DataFrame,
    decision: DecisionParams = DecisionParams(),
    gap_seconds: int = GAP_SECONDS,
    slots: DataFrame | None = None,
) -> DataFrame:
    """Every event inside an attack's time span on its drive, with ``attack_no``, ``start_us`` and ``end_us``.

    ``scored`` is read twice; start from a stored table such as the audit trail. ``slots`` lets a caller reuse a
    stored attack table. Rows of one drive are spread over its slots by the join.
    """
    found = attack_slots(scored, decision, gap_seconds) if slots is None else slots
    placed = with_event_time(scored).withColumn("slot", slot(F.col("ts_us"), gap_seconds * MICROS))
    return placed.join(found, ["drive_id", "slot"]).where("ts_us between start_us and end_us").drop("slot")


def attack_sessions(events: DataFrame, decision: DecisionParams = DecisionParams()) -> DataFrame:
    """One row per attack from its events: times, duration, suspicious events, their files and the peak score.

    Distinct files are counted after a first reduction to (attack, file), so a busy attack is not one task.
    """
    keys = ["drive_id", "attack_no"]
    per_file = (
        events.where(is_suspicious(decision))
        .groupBy(*keys, "stable_id")
        .agg(
            F.first("start_us").alias("start_us"),
            F.first("end_us").alias("end_us"),
            F.count("*").alias("n"),
            F.max("fused").alias("peak"),
        )
    )
    return (
        per_file.groupBy(*keys)
        .agg(
            F.min("start_us").alias("start_us"),
            F.max("end_us").alias("end_us"),
            F.sum("n").alias("events"),
            F.count("*").alias("files"),
            F.max("peak").alias("peak_score"),
        )
        .withColumn("duration_us", F.col("end_us") - F.col("start_us"))
    )


def attack_timeline(events: DataFrame) -> DataFrame:
    """Second-by-second counts per event type inside each attack."""
    second = F.floor(F.col("ts_us") / F.lit(MICROS)).cast("bigint")
    return events.groupBy("drive_id", "attack_no", second.alias("second"), "event_type").agg(F.count("*").alias("n"))


def attack_rate(events: DataFrame) -> DataFrame:
    """Files changed per second of each attack: the peak second, and the mean over the seconds the attack lasted."""
    keys = ["drive_id", "attack_no"]
    second = F.floor(F.col("ts_us") / F.lit(MICROS)).cast("bigint").alias("second")
    changes = events.select(*keys, "start_us", "end_us", "stable_id", second).groupBy(*keys, "second", "stable_id").agg(
        F.first("start_us").alias("start_us"), F.first("end_us").alias("end_us")
    )
    per_second = changes.groupBy(*keys, "second").agg(
        F.count("*").alias("files"), F.first("start_us").alias("start_us"), F.first("end_us").alias("end_us")
    )
    seconds = F.greatest((F.max("end_us") - F.min("start_us")) / F.lit(float(MICROS)), F.lit(1.0))
    return per_second.groupBy(*keys).agg(
        F.max("files").alias("peak_per_second"), (F.sum("files") / seconds).alias("mean_per_second")
    )


def attack_folders(events: DataFrame) -> DataFrame:
    """Folders touched in each attack with event and file counts."""
    folder = text.folder_of(F.coalesce(F.col("full_path"), F.lit("")))
    per_file = events.groupBy("drive_id", "attack_no", folder.alias("folder"), "stable_id").agg(F.count("*").alias("n"))
    return per_file.groupBy("drive_id", "attack_no", "folder").agg(
        F.sum("n").alias("events"), F.count("*").alias("files")
    )


def attack_extensions(events: DataFrame) -> DataFrame:
    """Renames in each attack by old and new extension; the old one is that of the file's previous title."""
    renames = events.where("event_type = 'RENAMED'")
    return renames.groupBy(
        "drive_id",
        "attack_no",
        text.extension(F.coalesce(F.col("previous_title"), F.lit(""))).alias("old_extension"),
        text.extension(F.coalesce(F.col("local_title"), F.lit(""))).alias("new_extension"),
    ).agg(F.count("*").alias("n"))


def attack_profile(events: DataFrame) -> DataFrame:
    """Per attack: events per second, share of renames, mean name entropy and commonest extension."""
    keys = ["drive_id", "attack_no"]
    ext = text.extension(F.coalesce(F.col("local_title"), F.lit("")))
    by_ext = events.groupBy(*keys, ext.alias("extension")).agg(
        F.count("*").alias("n"),
        F.sum((F.col("event_type") == "RENAMED").cast("bigint")).alias("renames"),
        F.sum("file_name_entropy").alias("entropy"),
        F.first("start_us").alias("start_us"),
        F.first("end_us").alias("end_us"),
    )
    seconds = F.greatest((F.max("end_us") - F.min("start_us")) / F.lit(float(MICROS)), F.lit(1.0))
    total = F.sum("n").cast("double")
    return by_ext.groupBy(*keys).agg(
        (total / seconds).alias("events_per_second"),
        (F.sum("renames") / total).alias("rename_share"),
        (F.sum("entropy") / total).alias("mean_entropy"),
        F.min_by("extension", F.struct(-F.col("n"), F.col("extension"))).alias("dominant_extension"),
    )


def restore_points(
    events: DataFrame, attacked: DataFrame, scan: ScanParams = ScanParams(), seconds_per_chunk: int = 86_400
) -> DataFrame:
    """For each attack and each file with an event inside it: the file's last event before the attack began.

    ``attacked`` is the output of ``attack_events``. Attack starts are put among the file's events as question rows
    and answered by one ordered scan, so no file is joined with all of its events. Files without an earlier event
    get NULLs.
    """
    keys = ["drive_id", "stable_id"]
    asked = attacked.groupBy("drive_id", "attack_no", "stable_id").agg(F.first("start_us").alias("at_us"))
    fields = ("id", "ts_us", "event_type", "local_title", "full_path")
    history = with_event_time(events).select(
        *keys, F.col("ts_us").alias("at_us"), F.col("id").alias("_id"), F.struct(*fields).alias("event")
    )
    # At equal times the question sorts first: only strictly earlier events answer it.
    rows = history.unionByName(asked.withColumn("_id", F.lit(-1).cast("bigint")), allowMissingColumns=True)
    found = previous_value(
        rows,
        keys,
        ["at_us", "_id"],
        "at_us",
        F.col("event"),
        "last",
        seconds_per_chunk * MICROS,
        skip_nulls=True,
        busy_rows=scan.rows_per_chunk,
    )
    return found.where("attack_no is not null").select(
        "drive_id",
        "attack_no",
        "stable_id",
        F.col("at_us").alias("start_us"),
        *[F.col(f"last.{f}").alias(f"restore_{f}") for f in fields],
    )


def audit_trail(scored: DataFrame, decision: DecisionParams = DecisionParams()) -> DataFrame:
    """Every event with its features, scores, flags and the level its own score would give."""
    level = threat_level(F.col("fused"), decision)
    return scored.withColumns({"threat_level": level, "suspicious": is_suspicious(decision)})


def recent_timeline(scored: DataFrame, n: int = 50, decision: DecisionParams = DecisionParams()) -> DataFrame:
    """Each drive's newest ``n`` events with score and level; the rank filter cuts rows before the shuffle."""
    newest = Window.partitionBy("drive_id").orderBy(F.desc("id"))
    return (
        scored.withColumn("rank", F.row_number().over(newest))
        .where(F.col("rank") <= n)
        .withColumn("threat_level", threat_level(F.col("fused"), decision))
    )
