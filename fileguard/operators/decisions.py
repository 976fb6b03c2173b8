"""From fused scores to alerts: batch decision, bands, gate, cooldown, alert records and response decisions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fileguard.functions.time import slot
from fileguard.operators.detectors import with_batch
from fileguard.operators.scans import live_runs
from fileguard.params import MICROS, DecisionParams, ScanParams
from fileguard.session import cut_lineage

TRIGGER = [
    "id",
    "timestamp",
    "stable_id",
    "event_type",
    "local_title",
    "file_size",
    "old_local_title",
    "full_path",
]


def _trigger(columns: list[str]) -> Column:
    """The event as a record; columns a source does not have are NULL."""
    kinds = {"file_size": "bigint", "old_local_title": "string"}
    return F.struct(
        *[F.col(c) if c in columns else F.lit(None).cast(kinds[c]).alias(c) for c in TRIGGER]
    )


def batch_threat(
    scored: DataFrame, decision: DecisionParams = DecisionParams(), scan: ScanParams = ScanParams()
) -> DataFrame:
    """Per drive and poll batch: ``threat``, ``hmm_hit``, event count, last time, affected files and ``trigger``.

    ``threat`` is the largest fused score, raised to ``hmm_boost`` when any event of the batch ends in the malicious
    state. ``trigger`` is the last event that set a strictly larger running maximum, where a hit raises that maximum
    but never triggers. Read from the end: when the largest score beats the boost, or nothing hits, it is the first
    event with the largest score; otherwise it is the first event with the largest score up to the first hit. That
    form needs no running state, so a batch is first reduced inside id chunks of bounded size and the few chunk rows
    are combined afterwards.
    """
    hit = F.coalesce(F.col("malicious"), F.lit(False))
    rows = with_batch(scored, decision).select(
        "drive_id",
        "batch",
        "ts_us",
        "id",
        F.floor(F.col("id") / F.lit(scan.rows_per_chunk)).cast("bigint").alias("part"),
        F.col("fused"),
        hit.alias("hit"),
        (F.col("recent_files") if "recent_files" in scored.columns else F.lit(None).cast("bigint")).alias("files"),
        _trigger(scored.columns).alias("event"),
    )
    in_part = Window.partitionBy("drive_id", "batch", "part")
    first_in_rank = F.struct(F.col("fused"), -F.col("id"))
    rows = rows.withColumn("first_hit", F.min(F.when(F.col("hit"), F.col("id"))).over(in_part))
    until_hit = F.col("first_hit").isNull() | (F.col("id") <= F.col("first_hit"))
    best = F.struct("fused", "id", "event")
    parts = rows.groupBy("drive_id", "batch", "part").agg(
        F.count("*").alias("events"),
        F.max(F.struct("ts_us", "id", "files")).alias("last"),
        F.min("first_hit").alias("first_hit"),
        F.max_by(best, first_in_rank).alias("best"),
        F.max_by(best, F.when(until_hit, first_in_rank)).alias("best_until_hit"),
    )
    in_batch = Window.partitionBy("drive_id", "batch")
    parts = parts.withColumn("batch_hit", F.min("first_hit").over(in_batch)).withColumn(
        "reachable",
        F.when(F.col("batch_hit").isNull(), F.col("best"))
        .when(F.col("first_hit").isNull() & (F.col("best.id") < F.col("batch_hit")), F.col("best"))
        .when(F.col("first_hit") == F.col("batch_hit"), F.col("best_until_hit")),
    )
    rank = lambda c: F.struct(F.col(f"{c}.fused"), -F.col(f"{c}.id"))
    batches = parts.groupBy("drive_id", "batch").agg(
        F.sum("events").alias("events"),
        F.max("last").alias("last"),
        F.min("batch_hit").isNotNull().alias("hmm_hit"),
        F.max_by("best", rank("best")).alias("best"),
        F.max_by("reachable", F.when(F.col("reachable").isNotNull(), rank("reachable"))).alias("reachable"),
    )
    boost = F.lit(decision.hmm_boost)
    setter = F.when(~F.col("hmm_hit") | (F.col("best.fused") > boost), F.col("best")).otherwise(F.col("reachable"))
    return batches.select(
        "drive_id",
        "batch",
        "events",
        F.col("last.ts_us").alias("ts_us"),
        F.col("last.files").alias("affected_files_count"),
        "hmm_hit",
        F.greatest(F.col("best.fused"), F.when(F.col("hmm_hit"), boost)).alias("threat"),
        F.when(setter["fused"] > 0, setter["event"]).alias("trigger"),
    )


def threat_level(threat: Column, decision: DecisionParams = DecisionParams()) -> Column:
    """Bands are closed below and open above, the top one is closed; below the lowest band the level is LOW too."""
    return (
        F.when(threat >= decision.critical, F.lit("CRITICAL"))
        .when(threat >= decision.pause, F.lit("HIGH"))
        .when(threat >= decision.alert, F.lit("MEDIUM"))
        .otherwise(F.lit("LOW"))
    )


def alert_gate(batches: DataFrame, decision: DecisionParams = DecisionParams()) -> DataFrame:
    return batches.where(F.col("threat") >= decision.alert)


def _orbit_ends(ts: np.ndarray, gap: int) -> np.ndarray:
    """For every start in sorted ``ts``, the last kept time when each keep skips what is less than ``gap`` later."""
    n = len(ts)
    hop = np.append(np.searchsorted(ts, ts + gap, side="left"), n)
    last = np.arange(n + 1)
    while True:
        target = np.where(hop[:n] < n, last[hop[:n]], last[:n])
        if np.array_equal(target, last[:n]):
            return ts[last[:n]]
        last[:n] = target
        hop[:n] = hop[hop[:n]]


def alert_cooldown(
    candidates: DataFrame,
    ts: str = "ts_us",
    decision: DecisionParams = DecisionParams(),
    chunk_seconds: int = 86_400,
    order: str = "id",
) -> DataFrame:
    """Keep a drive's first candidate, then always the next one at least the cooldown later.

    Candidates less than the cooldown apart form runs, and a run's first candidate is always kept; runs shorter than
    the cooldown keep nothing else. So only long runs need the sequential choice (see ``_choose_in_long_runs``).
    Candidates of one drive and time are told apart by ``order``. ``candidates`` is read more than once: materialize
    it first when it is costly.
    """
    gap = decision.cooldown_us
    runs = live_runs(candidates.select("drive_id", ts), ["drive_id"], ts, gap - 1)
    placed = (
        candidates.withColumn("slot", slot(F.col(ts), gap - 1))
        .join(runs.drop("run_no"), ["drive_id", "slot"])
        .drop("slot")
    )
    is_start = F.col(ts) == F.col("run_start")
    is_long = F.col("run_end") - F.col("run_start") >= gap
    later = _choose_in_long_runs(placed.where(is_long).select("drive_id", F.col(ts).alias("t")), gap, chunk_seconds)
    chosen = placed.join(later, (F.col("drive_id") == F.col("_drive")) & (F.col(ts) == F.col("_kept")), "left").where(
        is_start | F.col("_kept").isNotNull()
    )
    once = Window.partitionBy("drive_id", ts).orderBy(order)
    return (
        chosen.withColumn("_first", F.row_number().over(once)).where("_first = 1").select(*candidates.columns)
    )


def _choose_in_long_runs(times: DataFrame, gap: int, chunk_seconds: int) -> DataFrame:
    """(_drive, _kept): the kept times among (drive_id, t), exact and without putting a drive into one task.

    Every choice depends on the one before it, yet a chunk of time only needs the last kept time on entry. Each chunk
    first works out, for every possible entry, the last time it would keep (most entries meet quickly, so the table
    is short); a drive then walks its chunks once over these small tables; and last, every chunk keeps its times
    knowing its entry.
    """
    ts, width = "t", chunk_seconds * MICROS
    rows = times.withColumn("_chunk", slot(F.col(ts), width))

    def exits(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        drive, chunk = key
        t = np.unique(pdf[ts].to_numpy())
        end = _orbit_ends(t, gap)
        # Entered at or before ``upto`` the chunk ends with ``exit``. Later entries than one gap into the chunk occur
        # only as the chunk's first candidate, so the table stops there.
        stop = min(int(np.searchsorted(t, chunk * width + gap, side="left")) + 1, len(t))
        keep = np.append(end[: stop - 1] != end[1:stop], True)
        return pd.DataFrame({"drive_id": drive, "_chunk": chunk, "upto": t[:stop][keep], "exit": end[:stop][keep]})

    tables = rows.groupBy("drive_id", "_chunk").applyInPandas(
        exits, "drive_id bigint, _chunk bigint, upto bigint, exit bigint"
    )

    def entries(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_chunk", "upto"])
        chunks, upto, exit_ = (pdf[c].to_numpy() for c in ("_chunk", "upto", "exit"))
        bounds = np.append(np.flatnonzero(np.append(True, chunks[1:] != chunks[:-1])), len(chunks))
        ready, out = None, []
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            out.append((chunks[lo], ready))
            at = lo if ready is None else lo + int(np.searchsorted(upto[lo:hi], ready, side="left"))
            if at < hi:
                ready = int(exit_[at]) + gap
        return pd.DataFrame(
            {
                "drive_id": key[0],
                "_chunk": [c for c, _ in out],
                "ready": pd.array([r for _, r in out], dtype="Int64"),
            }
        )

    ready = tables.groupBy("drive_id").applyInPandas(entries, "drive_id bigint, _chunk bigint, ready bigint")

    def choose(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        t = np.unique(left[ts].to_numpy())
        first = right["ready"].iloc[0] if len(right) else None
        at = 0 if pd.isna(first) else int(np.searchsorted(t, int(first), side="left"))
        kept = []
        while at < len(t):
            kept.append(t[at])
            at = int(np.searchsorted(t, t[at] + gap, side="left"))
        return pd.DataFrame({"_drive": key[0], "_kept": np.array(kept, dtype="int64")})

    return (
        rows.groupBy("drive_id", "_chunk")
        .cogroup(ready.groupBy("drive_id", "_chunk"))
        .applyInPandas(choose, "_drive bigint, _kept bigint")
    )


def _iso_time(ts_us: Column) -> Column:
    return F.date_format(F.timestamp_micros(ts_us), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def alerts(
    batches: DataFrame, decision: DecisionParams = DecisionParams(), history: DataFrame | None = None
) -> DataFrame:
    """Alert records: gate, cooldown, level, affected files, triggering event and whether sync was already paused.

    Sync counts as paused once an earlier alert of the drive reached HIGH; alerts are at least one cooldown apart, so
    the window holds at most span / cooldown rows per drive. The gated batches (at most one row per drive and poll)
    are checkpointed, because the cooldown reads them several times. ``history`` (drive_id, ts_us, paused) holds each
    drive's last earlier alert when the batches continue an earlier run.
    """
    gated = alert_gate(batches, decision).withColumns({"_old": F.lit(False), "_paused": F.lit(False)})
    if history is not None:
        earlier_rows = history.select("drive_id", "ts_us", F.lit(True).alias("_old"), F.col("paused").alias("_paused"))
        gated = gated.unionByName(earlier_rows, allowMissingColumns=True)
    kept = alert_cooldown(cut_lineage(gated), "ts_us", decision, order="batch")
    leveled = kept.withColumn("threat_level", threat_level(F.col("threat"), decision))
    earlier = Window.partitionBy("drive_id").orderBy("ts_us").rowsBetween(Window.unboundedPreceding, -1)
    pauses = F.col("_paused") | F.col("threat_level").isin("HIGH", "CRITICAL")
    marked = leveled.withColumn("sync_paused", F.coalesce(F.bool_or(pauses).over(earlier), F.lit(False)))
    return marked.where(~F.col("_old")).select(
        "drive_id",
        "batch",
        "ts_us",
        _iso_time(F.col("ts_us")).alias("timestamp"),
        "threat_level",
        F.col("threat").alias("probability"),
        "affected_files_count",
        F.col("trigger").alias("triggering_event"),
        "sync_paused",
    )


# What each level asks for.
ACTIONS = {
    "LOW": (True, False, False, False),
    "MEDIUM": (True, False, False, False),
    "HIGH": (True, True, False, False),
    "CRITICAL": (True, True, True, True),
}
ACTION_COLUMNS = ("notify", "pause_sync", "quarantine", "recovery_report")


def response_plan(alert_rows: DataFrame) -> DataFrame:
    """Alerts plus the intended actions; nothing is carried out. Quarantine names the trigger's path when it has one."""
    table = F.create_map(
        *[
            item
            for level, flags in ACTIONS.items()
            for item in (
                F.lit(level),
                F.struct(*[F.lit(flag).alias(name) for name, flag in zip(ACTION_COLUMNS, flags)]),
            )
        ]
    )
    planned = alert_rows.withColumn("_plan", F.element_at(table, F.col("threat_level")))
    path = F.col("triggering_event.full_path")
    return planned.select(
        *alert_rows.columns,
        *[F.col(f"_plan.{name}").alias(name) for name in ACTION_COLUMNS if name != "quarantine"],
        F.when(F.col("_plan.quarantine") & (path != ""), path).alias("quarantine_path"),
    )


# Title and text per level, filled with the score in percent and the number of files.
TITLES = {
    "LOW": "Drive under watch",
    "MEDIUM": "Changes look like encryption",
    "HIGH": "Sync on hold",
    "CRITICAL": "Sync stopped, act now",
}
MESSAGES = {
    "LOW": "Some changes are out of the ordinary (score {confidence} of 100).",
    "MEDIUM": "The pattern fits encryption of files: {files} so far (score {confidence} of 100).",
    "HIGH": "Uploads wait until someone has looked at {files} changed files (score {confidence} of 100).",
    "CRITICAL": "Files are being rewritten in bulk, {files} by now; nothing is uploaded (score {confidence} of 100).",
}


def alert_messages(alert_rows: DataFrame) -> DataFrame:
    """Alerts plus notification ``title`` and ``message``."""
    level = F.col("threat_level")
    confidence = F.format_string("%.1f", F.round(F.col("probability") * 100, 1))
    files = F.coalesce(F.col("affected_files_count"), F.lit(0)).cast("string")

    def pick(texts: dict[str, str]) -> Column:
        out = F.lit(texts["LOW"])
        for name, words in texts.items():
            out = F.when(level == name, F.lit(words)).otherwise(out)
        return out

    message = F.replace(F.replace(pick(MESSAGES), F.lit("{files}"), files), F.lit("{confidence}"), confidence)
    return alert_rows.withColumns({"title": pick(TITLES), "message": message})


def latest_alert(alert_rows: DataFrame) -> DataFrame:
    """Per drive, the newest alert's time, level, confidence and file count."""
    return (
        alert_rows.groupBy("drive_id")
        .agg(
            F.max_by(
                F.struct("timestamp", "threat_level", "probability", "affected_files_count"), F.col("timestamp")
            ).alias("a")
        )
        .select("drive_id", "a.*")
    )
