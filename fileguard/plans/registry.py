"""One named query per operator over the driver's tables; ``oracles`` holds the SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fileguard.functions import text
from fileguard.operators import (
    decisions,
    detectors,
    features,
    forensics,
    fusion,
    hmm,
    metrics,
    models,
    parameters,
    snapshots,
    tuning,
)
from fileguard.plans import adapters, detection
from fileguard.params import ScanParams
from fileguard.plans.settings import BURST_US, PARAMS, SINCE_ID
from fileguard.schemas import FEATURES
from fileguard.session import cut_lineage, working_folder
from fileguard.sources import events as event_source
from fileguard.sources.events import events_recent, events_since

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(name: str, places: int = 6):
    return F.round(F.col(name), places).alias(name)


def _in_thousandths(name: str):
    return F.array_join(F.transform(name, lambda x: F.round(x * 1000).cast("bigint").cast("string")), ",").alias(name)


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return detection.scored_events(adapters.file_events(spark, d), PARAMS)


def _fused(spark: SparkSession, d: str) -> DataFrame:
    return detection.with_scores(
        detection.flagged_features(adapters.file_events(spark, d), PARAMS, files=False), PARAMS
    )


def _batches(spark: SparkSession, d: str) -> DataFrame:
    return decisions.batch_threat(_scored(spark, d), PARAMS.decision, PARAMS.scan)


def _alerts(spark: SparkSession, d: str) -> DataFrame:
    return decisions.alerts(_batches(spark, d), PARAMS.decision)


def _attacked(spark: SparkSession, d: str) -> DataFrame:
    """Forensics read the scored events twice, so they start from a stored copy with the columns they use."""
    kept = ("id", "ts_us", "drive_id", "stable_id", "event_type", "local_title", "full_path", "previous_title")
    stored = cut_lineage(_scored(spark, d).select(*kept, "file_name_entropy", "fused", "malicious"))
    return forensics.attack_events(stored, PARAMS.decision)


def _guessed(spark: SparkSession, d: str) -> DataFrame:
    """Labelled rows with a plain score, so that the metrics have an exact counterpart in SQL."""
    rows = adapters.labelled_features(spark, d)
    return rows.withColumns(
        {
            "score": F.col("file_name_entropy") / F.lit(8.0),
            "prediction": (F.col("file_name_entropy") >= 3.0).cast("int"),
        }
    )


def _labelled_flags(spark: SparkSession, d: str) -> DataFrame:
    """Detector output with the attacked drive's events as the malicious class."""
    flags = detectors.detector_flags(adapters.file_events(spark, d), PARAMS.detector, PARAMS.scan, files=False)
    return flags.withColumn("label", (F.col("drive_id") == 0).cast("int"))


@query
def level_counts(spark, d):
    out = detection.level_counts(adapters.file_events(spark, d), PARAMS)
    return out.withColumn("max_threat", F.round("max_threat", 6))


@query
def events_since_id(spark, d):
    rows = events_since(adapters.file_events(spark, d), SINCE_ID)
    return rows.select("id", "drive_id", "stable_id", "event_type", "local_title")


@query
def events_recent_days(spark, d):
    events = adapters.file_events(spark, d)
    now = events.agg(F.max("timestamp")).scalar()
    return events_recent(events, now, 7).select("id", "drive_id", "event_type", "ts_us")


@query
def snapshot_files(spark, d):
    return snapshots.snapshot_files(*adapters.items_and_parents(spark, d))


@query
def dedupe_parents(spark, d):
    return snapshots.dedupe_parents(snapshot_files(spark, d))


@query
def snapshot_paths(spark, d):
    items, parents = adapters.items_and_parents(spark, d)
    return snapshots.snapshot_table(items, parents).select("drive_id", "stable_id", "parent_stable_id", "full_path")


@query
def snapshot_diff(spark, d):
    return snapshots.snapshot_diff(*adapters.snapshots(spark, d))


@query
def id_sets(spark, d):
    return snapshots.id_sets(*adapters.snapshots(spark, d))


@query
def snapshot_chain(spark, d):
    return snapshots.snapshot_chain(adapters.snapshot_series(spark, d))


@query
def snapshot_chain_emptied(spark, d):
    """The fifth poll finds both drives empty: it has no rows, but it is in the list of polls."""
    rows = adapters.snapshot_series(spark, d)
    polls = rows.select("drive_id", "snapshot_id", "snapshot_ts").distinct()
    return snapshots.snapshot_chain(rows.where("snapshot_id <> 5"), polls)


@query
def rejected_events(spark, d):
    """Every thousandth event lacks its time, its drive or its id."""
    rows, place = adapters.file_events(spark, d), F.col("id") % 1000
    gaps = {c: F.when(place == k, None).otherwise(F.col(c)) for k, c in ((7, "timestamp"), (8, "drive_id"), (9, "id"))}
    return event_source.rejected_events(rows.withColumns(gaps))


@query
def text_functions(spark, d):
    names = adapters.file_events(spark, d).select("full_path", "local_title").distinct()
    title, path = F.col("local_title"), F.col("full_path")
    return names.select(
        "full_path",
        "local_title",
        text.extension(path).alias("extension"),
        text.last_token(title).alias("last_token"),
        text.separator_count(path, "/").alias("separators"),
        text.folder_of(path).alias("folder"),
        F.length(title).alias("name_length"),
        F.round(text.name_entropy(title), 6).alias("entropy"),
        text.join_path(F.when(F.length(title) % 2 == 0, "parent"), title).alias("joined"),
    )


@query
def previous_title(spark, d):
    rows = features.previous_title(adapters.file_events(spark, d), PARAMS.scan)
    return rows.select("id", "drive_id", "stable_id", "previous_title")


#: Cuts so small that every busy key has many chunks at the test sizes: the twins below prove the carries between chunks.
CHUNKED = replace(PARAMS, scan=ScanParams(chunk_seconds=45, rows_per_chunk=300))


@query
def parameters_as_of(spark, d):
    """From the middle of the time on, other thresholds and multipliers hold, and one more word is suspicious."""
    events = adapters.file_events(spark, d)
    low, high = events.agg(F.min("ts_us"), F.max("ts_us")).first()
    middle = ((low or 0) + (high or 0)) // 2
    versions = parameters.first_version(spark, PARAMS).unionByName(spark.createDataFrame([(middle, 20, 3, 2.0, 6.0)], parameters.VERSIONS))
    words = parameters.default_words(spark).unionByName(
        spark.createDataFrame([("suspicious_path", parameters.PATH, parameters.ANYWHERE, "Photos", middle, None)], parameters.WORDS)
    )
    lists = ["suspicious_path", "process_related", "system_executable"]
    rows = parameters.flags_as_of(detectors.window_measures(events, PARAMS.detector, PARAMS.scan, files=False), versions)
    return parameters.word_flags(rows, words, lists).select("id", "high_velocity", "systematic_rename", "evidence", *lists)


@query
def scored_events_accepted(spark, d):
    """Every thousandth event lacks its time, its drive or its id; the others are scored as if it were not there."""
    rows, place = adapters.file_events(spark, d).drop("ts_us"), F.col("id") % 1000
    gaps = {c: F.when(place == k, None).otherwise(F.col(c)) for k, c in ((7, "timestamp"), (8, "drive_id"), (9, "id"))}
    scored = detection.scored_events(rows.withColumns(gaps), PARAMS)
    return scored.select("id", "drive_id", "previous_title", rounded("score"), rounded("fused"), "state")


@query
def window_measures_in_pieces(spark, d):
    """Nine of ten events of a drive fall into one second; pieces hold 200 steps."""
    events = adapters.file_events(spark, d)
    squeezed = F.when(F.col("id") % 10 != 0, F.lit(BURST_US) + F.col("ts_us") % 1_000_000).otherwise(F.col("ts_us"))
    rows = detectors.detector_flags(events.withColumn("ts_us", squeezed), PARAMS.detector, ScanParams(rows_per_piece=200))
    return rows.select("id", "drive_id", "ts_us", "recent_writes", "recent_renames", "rename_extensions", "recent_files", "high_velocity", "systematic_rename")


@query
def previous_title_chunked(spark, d):
    rows = features.previous_title(adapters.file_events(spark, d), CHUNKED.scan)
    return rows.select("id", "drive_id", "stable_id", "previous_title")


@query
def batch_threat_chunked(spark, d):
    scored = detection.scored_events(adapters.file_events(spark, d), CHUNKED)
    rows = decisions.batch_threat(scored, CHUNKED.decision, CHUNKED.scan)
    return rows.select("drive_id", "batch", rounded("threat"), "events")


@query
def restore_points_chunked(spark, d):
    return forensics.restore_points(adapters.file_events(spark, d), _attacked(spark, d), CHUNKED.scan)


@query
def file_features(spark, d):
    rows = features.file_features(adapters.file_events(spark, d), "/", PARAMS.scan)
    real = {"extension_similarity", "file_name_entropy"}
    return rows.select("id", "drive_id", "stable_id", *[rounded(f) if f in real else f for f in FEATURES])


@query
def high_velocity(spark, d):
    rows = detectors.high_velocity(adapters.file_events(spark, d), PARAMS.detector, PARAMS.scan)
    return rows.select("id", "drive_id", "recent_writes", "high_velocity")


@query
def systematic_rename(spark, d):
    rows = detectors.systematic_rename(adapters.file_events(spark, d), PARAMS.detector, PARAMS.scan)
    return rows.select("id", "drive_id", "recent_renames", "rename_extensions", "systematic_rename")


@query
def recent_files_affected(spark, d):
    rows = detectors.recent_files_affected(adapters.file_events(spark, d), PARAMS.detector, PARAMS.scan)
    return rows.select("id", "drive_id", "recent_files")


@query
def entropy_sequence(spark, d):
    rows = hmm.entropy_sequence(adapters.file_events(spark, d), PARAMS.hmm.length, PARAMS.scan)
    return rows.select("id", "drive_id", _in_thousandths("entropies"))


@query
def batch_flags(spark, d):
    events = adapters.file_events(spark, d)
    return detectors.batch_flags(detectors.detector_flags(events, PARAMS.detector, PARAMS.scan, files=False), PARAMS.decision)


@query
def event_scores(spark, d):
    rows = fusion.event_scores(features.file_features(adapters.file_events(spark, d), "/", PARAMS.scan), PARAMS.scorecard)
    return rows.select("id", "drive_id", rounded("score"))


@query
def fused_scores(spark, d):
    return _fused(spark, d).select(
        "id", "drive_id", rounded("score"), "high_velocity", "systematic_rename", rounded("fused")
    )


@query
def poll_scores(spark, d):
    rows = detection.scored_events(adapters.file_events(spark, d), PARAMS, mode="poll")
    return rows.select("id", "drive_id", "high_velocity", "systematic_rename", rounded("fused"))


@query
def hmm_state(spark, d):
    events = adapters.file_events(spark, d)
    rows = hmm.hmm_state(hmm.entropy_sequence(events, PARAMS.hmm.length, PARAMS.scan), PARAMS.hmm)
    return rows.select("id", "drive_id", "state", "malicious")


@query
def hmm_path(spark, d):
    events = adapters.file_events(spark, d)
    rows = hmm.hmm_path(hmm.entropy_sequence(events, PARAMS.hmm.length, PARAMS.scan), PARAMS.hmm)
    path = F.array_join(F.transform("path", lambda s: s.cast("string")), "").alias("path")
    return rows.where("path is not null").select("id", "drive_id", path)


@query
def state_alignment(spark, d):
    lang = adapters.table(spark, d, "documents").select(F.col("doc_id").alias("row_id"), F.col("lang").alias("model_id"))
    mean = lambda k: F.avg(F.when(F.col("label") == k, F.col("file_name_entropy")))
    fitted = (
        adapters.labelled_features(spark, d)
        .join(lang, "row_id")
        .groupBy("model_id")
        .agg(F.array(mean(0), mean(1)).alias("mu"))
        .where("mu[0] is not null and mu[1] is not null")
    )
    return hmm.entropy_state_means(fitted).withColumn("mean", F.round("mean", 6))


@query
def batch_threat(spark, d):
    return _batches(spark, d).select(
        "drive_id", "batch", "events", "ts_us", "affected_files_count", "hmm_hit", rounded("threat")
    )


@query
def trigger_event(spark, d):
    return _batches(spark, d).select(
        "drive_id",
        "batch",
        F.col("trigger.id").alias("trigger_id"),
        F.col("trigger.event_type").alias("trigger_type"),
        F.col("trigger.full_path").alias("trigger_path"),
    )


@query
def threat_level(spark, d):
    level = decisions.threat_level(F.col("threat"), PARAMS.decision)
    return _batches(spark, d).select("drive_id", "batch", level.alias("threat_level"))


@query
def alert_gate(spark, d):
    return decisions.alert_gate(_batches(spark, d), PARAMS.decision).select("drive_id", "batch", rounded("threat"))


@query
def alert_cooldown(spark, d):
    gated = cut_lineage(decisions.alert_gate(_batches(spark, d), PARAMS.decision).select("drive_id", "batch", "ts_us"))
    kept = decisions.alert_cooldown(gated, "ts_us", PARAMS.decision, order="batch")
    return kept.select("drive_id", "batch", "ts_us")


@query
def alerts(spark, d):
    return _alerts(spark, d).select(
        "drive_id",
        "batch",
        "ts_us",
        "timestamp",
        "threat_level",
        rounded("probability"),
        "affected_files_count",
        "sync_paused",
        F.col("triggering_event.id").alias("trigger_id"),
        F.col("triggering_event.event_type").alias("trigger_type"),
        F.col("triggering_event.full_path").alias("trigger_path"),
    )


@query
def response_plan(spark, d):
    return decisions.response_plan(_alerts(spark, d)).select(
        "drive_id", "batch", "threat_level", "notify", "pause_sync", "recovery_report", "quarantine_path"
    )


@query
def alert_messages(spark, d):
    return decisions.alert_messages(_alerts(spark, d)).select("drive_id", "batch", "title", "message")


@query
def latest_alert(spark, d):
    return decisions.latest_alert(_alerts(spark, d)).withColumn("probability", F.round("probability", 6))


@query
def activity_baseline(spark, d):
    rows = metrics.activity_baseline(adapters.file_events(spark, d))
    return rows.select(
        "drive_id",
        "events",
        rounded("event_rate"),
        rounded("typical_burst_size"),
        F.array_join("common_extensions", ",").alias("common_extensions"),
    )


@query
def top_extensions(spark, d):
    return metrics.top_extensions(adapters.file_events(spark, d))


@query
def events_per_minute(spark, d):
    return metrics.events_per_minute(adapters.file_events(spark, d))


@query
def training_prepare(spark, d):
    rows = models.training_prepare(adapters.training_raw(spark, d))
    return rows.withColumns(
        {c: F.round(c, 6) for c in ("extension_similarity", "file_name_entropy")}
    )


@query
def rejected_labels(spark, d):
    return models.rejected_labels(adapters.training_raw(spark, d))


@query
def class_split(spark, d):
    benign, malicious = models.class_split(adapters.labelled_features(spark, d).select("row_id", "label"))
    named = lambda rows, name: rows.select(F.lit(name).alias("subset"), "row_id", "label")
    return named(benign, "benign").unionByName(named(malicious, "malicious"))


@query
def class_counts(spark, d):
    return metrics.class_counts(adapters.labelled_features(spark, d))


@query
def seeded_sample(spark, d):
    return models.seeded_sample(adapters.labelled_features(spark, d), 100).select("row_id", "label")


@query
def stratified_split(spark, d):
    return models.stratified_split(adapters.labelled_features(spark, d)).select("row_id", "label", "split")


@query
def confusion_matrix(spark, d):
    return metrics.confusion_matrix(_guessed(spark, d))


@query
def precision_recall_f1(spark, d):
    rows = metrics.precision_recall_f1(_guessed(spark, d))
    return rows.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query
def classification_report(spark, d):
    rows = metrics.classification_report(_guessed(spark, d))
    return rows.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query
def roc_auc(spark, d):
    return metrics.roc_auc(_guessed(spark, d)).withColumn("auc", F.round("auc", 6))


@query
def ks_statistic(spark, d):
    return tuning.ks_statistic(_guessed(spark, d)).withColumn("ks", F.round("ks", 6))


@query
def hmm_sequences(spark, d):
    rows = models.hmm_sequences(adapters.labelled_features(spark, d))
    return rows.select("label", "seq", _in_thousandths("sequence"))


@query
def likelihood_ratios(spark, d):
    return tuning.likelihood_ratios(_labelled_flags(spark, d)).withColumn("ratio", F.round("ratio", 6))


@query
def likelihood_sweep(spark, d):
    rows = tuning.likelihood_sweep(_fused(spark, d).withColumn("label", (F.col("drive_id") == 0).cast("int")))
    return rows.withColumns({c: F.round(c, 6) for c in ("f1", "auc")})


@query
def tuning_config(spark, d):
    """Sweeps to fronts to best trials to one configuration."""
    def best(rows: DataFrame, params: list[str], f1: str, f2: str) -> DataFrame:
        trials = rows.select(*params, F.col(f1).alias("f1"), F.col(f2).alias("f2"))
        return tuning.best_trial(tuning.pareto_front(cut_lineage(trials)), params)

    ratios = best(likelihood_sweep(spark, d), ["velocity_ratio", "rename_ratio"], "f1", "auc")
    named = F.array(*(F.struct(F.lit(p).alias("pattern"), F.col(c).alias("ratio")) for p, c in (("high_velocity", "velocity_ratio"), ("systematic_rename", "rename_ratio"))))
    config = tuning.tuning_config(
        ratios.select(F.explode(named).alias("p")).select("p.*"),
        best(micropattern_sweep(spark, d), ["velocity_threshold", "rename_threshold"], "f1", "precision"),
        best(alert_threshold_sweep(spark, d), ["alert_pct", "pause_pct", "critical_pct"], "f1", "recall"),
        best(hmm_separability(spark, d), ["sequence_length", "n_sequences"], "ks", "cohens_d"),
        adapters.labelled_features(spark, d).count(), adapters.file_events(spark, d).count(), "2024-01-01T00:00:00",
    )
    return tuning.config_frame(spark, config).select(
        F.col("likelihood_ratios.high_velocity").alias("velocity_ratio"), F.col("likelihood_ratios.systematic_rename").alias("rename_ratio"),
        F.col("micropattern_thresholds.high_velocity.threshold").alias("velocity_threshold"),
        F.col("micropattern_thresholds.systematic_rename.threshold").alias("rename_threshold"),
        F.col("alert_thresholds.alert").alias("alert"), F.col("alert_thresholds.pause").alias("pause"), F.col("alert_thresholds.critical").alias("critical"),
        "hmm_parameters.sequence_length", F.col("hmm_parameters.n_sequences_per_class").alias("n_sequences"),
        "metadata.training_samples", "metadata.user_events",
    )


@query
def micropattern_sweep(spark, d):
    """The penalty's bound is the busiest drive's measured busy minute; created files count from 0 to 2 a row."""
    burst = metrics.activity_baseline(adapters.file_events(spark, d)).agg(F.max("typical_burst_size")).scalar()
    rows = tuning.micropattern_sweep(
        adapters.labelled_features(spark, d).withColumn("file_created", (F.col("row_id") % 3).cast("int")), user_burst=burst
    )
    return rows.withColumns({c: F.round(c, 6) for c in ("f1", "precision")})


@query
def detector_sweep(spark, d):
    rows = tuning.detector_sweep(_labelled_flags(spark, d), list(range(15, 101, 5)), list(range(3, 21)))
    return rows.withColumns({c: F.round(c, 6) for c in ("f1", "precision", "recall")})


@query
def alert_threshold_sweep(spark, d):
    rows = tuning.alert_threshold_sweep(_guessed(spark, d))
    return rows.withColumns({c: F.round(c, 6) for c in ("f1", "recall")})


@query
def hmm_separability(spark, d):
    rows = tuning.hmm_separability(adapters.labelled_features(spark, d), whole=False)
    return rows.withColumns({"ks": F.round("ks", 6), "cohens_d": F.round("cohens_d", 4)})


@query
def hmm_separability_all_chunks(spark, d):
    rows = tuning.separability_of_all(adapters.labelled_features(spark, d), list(range(10, 36, 5)))
    return rows.withColumns({"ks": F.round("ks", 6), "cohens_d": F.round("cohens_d", 4)})


@query
def pareto_front(spark, d):
    return tuning.pareto_front(adapters.trials(spark, d)).select("trial", "f1", "f2")


@query
def best_trial(spark, d):
    return tuning.best_trial(adapters.trials(spark, d), ["trial"])


@query
def new_trials(spark, d):
    planned = adapters.trials(spark, d)
    done = tuning.as_trials(planned.where("trial % 3 = 0"), "demo", ["trial"], "f1", "f2")
    return tuning.new_trials(planned.select("trial"), done, ["trial"], "demo")


@query
def attack_sessions(spark, d):
    rows = forensics.attack_sessions(_attacked(spark, d), PARAMS.decision)
    return rows.withColumn("peak_score", F.round("peak_score", 6))


@query
def attack_timeline(spark, d):
    return forensics.attack_timeline(_attacked(spark, d))


@query
def attack_rate(spark, d):
    rows = forensics.attack_rate(_attacked(spark, d))
    return rows.withColumn("mean_per_second", F.round("mean_per_second", 6))


@query
def attack_folders(spark, d):
    return forensics.attack_folders(_attacked(spark, d))


@query
def attack_extensions(spark, d):
    return forensics.attack_extensions(_attacked(spark, d))


@query
def attack_profile(spark, d):
    rows = forensics.attack_profile(_attacked(spark, d))
    return rows.withColumns({c: F.round(c, 6) for c in ("events_per_second", "rename_share", "mean_entropy")})


@query
def restore_points(spark, d):
    return forensics.restore_points(adapters.file_events(spark, d), _attacked(spark, d), PARAMS.scan)


@query
def audit_trail(spark, d):
    rows = forensics.audit_trail(_scored(spark, d), PARAMS.decision)
    return rows.select(
        "id",
        "drive_id",
        "event_type",
        rounded("score"),
        "high_velocity",
        "systematic_rename",
        rounded("fused"),
        "malicious",
        "threat_level",
        "suspicious",
    )


@query
def recent_timeline(spark, d):
    rows = forensics.recent_timeline(_fused(spark, d), 50, PARAMS.decision)
    return rows.select("drive_id", "rank", "id", "event_type", "full_path", rounded("fused"), "threat_level")


@query
def stream_events_per_minute(spark, d):
    """The same counts from a stream over the events file, read once the stream has taken in everything."""
    folder = working_folder(spark, "minutes")
    events = adapters.file_events_from(
        spark.readStream.schema(adapters.table(spark, d, "events").schema).parquet(f"{d}/events.parq*")
    )
    running = (
        metrics.events_per_minute(events)
        .writeStream.outputMode("complete")
        .option("checkpointLocation", f"{folder}/query")
        .foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(f"{folder}/counts"))
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    return spark.read.parquet(f"{folder}/counts")


# Renamed here because the functions behind them carry the plain names.
QUERIES["events_since"] = QUERIES.pop("events_since_id")
QUERIES["events_recent"] = QUERIES.pop("events_recent_days")


#: Labelled rows that the classifier is fitted on at most, by seeded order; rounds and depth are the operator's own.
FIT_ROWS = 20_000
F1_FLOOR = 0.8


def _fitted(spark: SparkSession, d: str):
    """The classifier fitted on the training split, and the held-out rows. The label shows in one feature, whose values of the
    two classes overlap a little. Two queries use the same fit, so it is kept for the session."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _FITS:
        _FITS.clear()
        _FITS[key] = _fit(spark, d)
    return _FITS[key]


_FITS: dict[tuple[str, str], tuple] = {}


def _fit(spark: SparkSession, d: str):
    told = (F.col("row_id") % 97).cast("double") * F.lit(1.05 / 97) + F.col("label")
    rows = adapters.labelled_features(spark, d).withColumn("file_name_entropy", told)
    rows = cut_lineage(models.stratified_split(rows))
    train = cut_lineage(models.seeded_sample(rows.where("split = 'train'"), FIT_ROWS).drop("split").coalesce(1))
    return models.train_classifier(train), rows.where("split = 'test'").drop("split")


@query
def train_classifier(spark, d):
    """All rounds at full depth on the training split; held-out support of each class, and whether its F1 reaches the floor."""
    model, test = _fitted(spark, d)
    report = metrics.classification_report(models.classifier_scores(model, test))
    return report.where("row in ('good', 'ransom')").select("row", "support", (F.col("f1") >= F1_FLOOR).alias("f1_reached"))


@query
def feature_attribution(spark, d):
    """The full model on all held-out rows: a constant feature moves no score, and the one that holds the label moves it most."""
    model, test = _fitted(spark, d)
    found = models.feature_attribution(model, test)
    first = F.max_by("feature", "attribution").over(Window.partitionBy())
    constant = F.col("feature").isin(FEATURES[3:5])
    return found.select(
        "feature", (constant & (F.col("attribution") > 0)).alias("constant_moves"), (F.col("feature") == first).alias("strongest")
    )


#: The row without any sign of malice that contributions are measured from.
BACKGROUND = {f: 1.0 if f == "extension_similarity" else 0.0 for f in FEATURES}


@query
def shapley_contributions(spark, d):
    """Contributions to the scorecard's score, every labelled row; they sum to the score less that of the background."""
    rows = adapters.labelled_features(spark, d)
    found = models.sampled_shapley(rows, lambda x: fusion.event_scores(x, PARAMS.scorecard), BACKGROUND, chains=4)
    total = sum((F.col(f"phi_{f}") for f in FEATURES), F.lit(0.0))
    sums = F.abs(total - (F.col("prediction") - F.col("base"))) < 1e-9
    return found.select("row_id", sums.alias("sums"), *(F.round(f"phi_{f}", 6).alias(f"phi_{f}") for f in FEATURES))


@query
def burst_sketches(spark, d):
    """Hourly sketches, stored; odd and even hours merged apart and then together, and all at once."""
    sketch = cut_lineage(metrics.burst_sketch(adapters.file_events(spark, d)))
    halves = [metrics.merge_sketches(sketch.where(F.col("hour") % 2 == k)) for k in (0, 1)]
    whole = metrics.sketch_quantile(sketch)
    return whole.join(metrics.sketch_quantile(metrics.merge_sketches(*halves)).select("drive_id", F.col("typical_burst_size").alias("merged")), "drive_id")


@query
def train_hmm(spark, d):
    """Steps until the tolerance or the limit: the likelihood never falls and the states come out in the order of entropy."""
    drawn = models.hmm_sequences(adapters.labelled_features(spark, d)).select("sequence")
    sequences = cut_lineage(drawn.coalesce(1))  # 500 sequences a class, whatever the size of the table
    params, history = hmm.train_hmm(sequences)
    rises = all(b >= a - 1e-6 for a, b in zip(history, history[1:]))
    settled = len(history) == 100 or history[-1] - history[-2] < 1e-2
    fitted = hmm.load_model(hmm.model_frame(spark, params, "labelled"), "labelled")
    values = (rises, settled, fitted.mu[0] < fitted.mu[1], fitted.length)
    return spark.createDataFrame([values], "rises boolean, settled boolean, ordered boolean, length int")
