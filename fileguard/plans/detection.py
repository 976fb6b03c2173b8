"""The detection plan: events to features, flags, scores and model states, and on to alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fileguard.functions.time import with_event_time
from fileguard.operators.decisions import alerts, batch_threat, threat_level
from fileguard.operators.detectors import batch_flags, detector_flags, with_batch
from fileguard.operators.features import feature_columns, file_features
from fileguard.operators.fusion import event_scores, fused_scores
from fileguard.operators.hmm import entropy_sequence, hmm_state
from fileguard.operators.models import classifier_scores
from fileguard.params import EngineParams
from fileguard.sources.events import accepted_events


def flagged_features(
    events: DataFrame, params: EngineParams = EngineParams(), sep: str = "/", files: bool = True
) -> DataFrame:
    """Events with window measures, flags and features. Summaries of the feature scan read the raw events."""
    base = with_event_time(events)
    return file_features(detector_flags(base, params.detector, params.scan, files), sep, params.scan, base=base)


def with_scores(
    features: DataFrame, params: EngineParams = EngineParams(), model=None, poll_flags: DataFrame | None = None
) -> DataFrame:
    """Add ``score`` (scorecard, or a trained ``model``) and ``fused``.

    With ``poll_flags`` the events of a poll batch share the flags of the batch's last event instead of their own.
    """
    scored = event_scores(features, params.scorecard) if model is None else classifier_scores(model, features)
    if poll_flags is not None:
        flags = list(params.fusion.ratios)
        shared = poll_flags.select("drive_id", "batch", *flags)
        scored = with_batch(scored.drop(*flags), params.decision).join(shared, ["drive_id", "batch"]).drop("batch")
    return fused_scores(scored, params.fusion)


def scored_events(
    events: DataFrame,
    params: EngineParams = EngineParams(),
    sep: str = "/",
    model=None,
    mode: str = "event",
) -> DataFrame:
    """Events with everything the decision needs: features, flags, ``score``, ``fused``, ``state``, ``malicious``.

    Three shuffles of the event rows: by drive and time chunk for the windows, by file for the previous title, and by
    drive and id chunk for the entropy sequence. ``mode`` is 'event' (every event has its own window) or 'poll'. Events
    without id, time or drive have no place in any order: they are left out here, and ``sources.events.rejected_events`` counts them.
    """
    if mode not in ("event", "poll"):
        raise ValueError(f"unknown mode {mode!r}")
    base = with_event_time(accepted_events(events))
    shared = None
    if mode == "poll":
        shared = batch_flags(detector_flags(base, params.detector, params.scan, files=False), params.decision)
    fused = with_scores(flagged_features(base, params, sep), params, model, shared)
    sequences = entropy_sequence(fused, params.hmm.length, params.scan, base=base)
    return hmm_state(sequences, params.hmm)


def detect(
    events: DataFrame, params: EngineParams = EngineParams(), sep: str = "/", model=None, mode: str = "event"
) -> DataFrame:
    """Events to alert records."""
    scored = scored_events(events, params, sep, model, mode)
    return alerts(batch_threat(scored, params.decision, params.scan), params.decision)


def scored_with_context(
    rows: DataFrame, params: EngineParams = EngineParams(), sep: str = "/", model=None
) -> DataFrame:
    """Like ``scored_events`` for rows that already carry ``previous_title``: a slice of events and what precedes it."""
    base = with_event_time(rows)
    features = detector_flags(base, params.detector, params.scan).withColumns(feature_columns(sep))
    fused = with_scores(features, params, model)
    return hmm_state(entropy_sequence(fused, params.hmm.length, params.scan, base=base), params.hmm)


def level_counts(events: DataFrame, params: EngineParams = EngineParams(), sep: str = "/") -> DataFrame:
    """Per drive and threat level of the poll batches: batches, events, model hits and largest threat."""
    batches = batch_threat(scored_events(events, params, sep), params.decision, params.scan)
    return (
        batches.withColumn("threat_level", threat_level(F.col("threat"), params.decision))
        .groupBy("drive_id", "threat_level")
        .agg(
            F.count("*").alias("batches"),
            F.sum("events").alias("events"),
            F.sum(F.col("hmm_hit").cast("bigint")).alias("hmm_hits"),
            F.max("threat").alias("max_threat"),
        )
    )
