import json

import pytest
from pyspark.sql import functions as F

from fileguard.operators import decisions, hmm, metrics, models, tuning
from fileguard.schemas import FEATURES, LABEL_COLUMN, TRAINING_COLUMNS
from fileguard.sources import alerts as alert_source
from fileguard.sources import config, events, training


def test_training_roundtrip(spark, tmp_path):
    header = ",".join([LABEL_COLUMN, *TRAINING_COLUMNS])
    (tmp_path / "raw.csv").write_text(f"{header}\ngood,0,1,0,1,1,0,0,40,2,20,0.5,3.25\nransom,1,0,0,1,1,1,0,9,1,5,1.0,2.0\nodd,1,0,0,1,1,1,0,9,1,5,1.0,2.0\n")
    rows = models.training_prepare(training.read_training_csv(spark, str(tmp_path / "raw.csv")))
    assert rows.columns == ["label", *FEATURES]
    training.write_training(rows, str(tmp_path / "t"))
    back = training.read_training(spark, str(tmp_path / "t"), ["label", "file_name_entropy"])
    assert sorted(tuple(r) for r in back.collect() if r[0] is not None) == [(0, 3.25), (1, 2.0)]
    assert back.where("label is null").count() == 1


def test_config_roundtrip(spark, tmp_path):
    cfg = {
        "likelihood_ratios": {"high_velocity": 2.25, "systematic_rename": 9.5},
        "micropattern_thresholds": {
            "high_velocity": {"threshold": 64, "window_seconds": 45},
            "systematic_rename": {"threshold": 11, "window_seconds": 45},
        },
        "alert_thresholds": {"alert": 0.2, "pause": 0.4, "critical": 0.8},
        "hmm_parameters": {"sequence_length": 21, "n_states": 2, "n_sequences_per_class": 350},
        "metadata": {"generated_at": "2031-02-03T04:05:06", "training_samples": 12, "user_events": 3,
                     "optimization_method": "sweep", "version": "1"},
    }
    config.write_config(spark, cfg, str(tmp_path / "c"))
    assert config.read_config(spark, str(tmp_path / "c")) == cfg
    (tmp_path / "spread.json").write_text(json.dumps(cfg, indent=2))
    assert config.read_config(spark, str(tmp_path / "spread.json")) == cfg


def test_alert_log(spark, tmp_path):
    trigger = "struct<id:bigint,timestamp:double,stable_id:bigint,event_type:string,local_title:string,file_size:bigint,old_local_title:string,full_path:string>"
    rows = spark.createDataFrame(
        [(4, "2031-02-03T04:05:06.000001", "HIGH", 0.8, 21, (3, 2.5, 90, "MODIFIED", "d", 12, "", "p/d"), False),
         (4, "2031-02-03T04:06:07.000002", "MEDIUM", 0.55, 33, None, True)],
        f"drive_id bigint, timestamp string, threat_level string, probability double, affected_files_count bigint, triggering_event {trigger}, sync_paused boolean",
    )
    for fmt in ("json", "parquet"):
        path = str(tmp_path / fmt)
        alert_source.append_alerts(rows, path, fmt)
        alert_source.append_alerts(rows.limit(0), path, fmt)
        back = alert_source.read_alerts(spark, path, fmt)
        assert back.count() == 2
        last = decisions.latest_alert(back).first()
        assert (last.threat_level, last.affected_files_count) == ("MEDIUM", 33)
    assert back.where("threat_level = 'HIGH'").first().triggering_event.full_path == "p/d"


def test_event_sink(spark, tmp_path):
    rows = spark.createDataFrame(
        [(1, 86_399.0, 0, 1, "CREATED", "a", 1, "", "a"), (2, 86_400.0, 0, 1, "DELETED", "a", 0, "", "a")],
        events.FILE_EVENTS,
    )
    events.append_events(rows, str(tmp_path / "e"))
    events.append_events(rows.where("id = 2").withColumn("id", F.lit(3).cast("bigint")), str(tmp_path / "e"))
    back = events.read_events(spark, str(tmp_path / "e"))
    assert sorted(r.id for r in back.collect()) == [1, 2, 3]
    assert {p.name for p in (tmp_path / "e").iterdir() if p.is_dir()} == {"event_day=1970-01-01", "event_day=1970-01-02"}
    recent = events.events_recent(back, 2 * 86_400.0, 1)
    assert [r.id for r in recent.where("id < 3").collect()] == [2]
    assert "event_day" in recent._jdf.queryExecution().executedPlan().toString().split("PartitionFilters:")[1].split("]")[0]
    plan = events.events_since(back, 1)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,1)" in plan


def test_trials_resume(spark, tmp_path):
    trials = spark.createDataFrame([(15, 3, 0.5, 0.6), (20, 4, 0.7, 0.2)], "v int, r int, f1 double, p double")
    config.append_trials(tuning.as_trials(trials, "s1", ["v", "r"], "f1", "p"), str(tmp_path / "t"))
    done = config.read_trials(spark, str(tmp_path / "t"), "s1")
    planned = spark.createDataFrame([(15, 3), (25, 5)], "v int, r int")
    assert [tuple(r) for r in tuning.new_trials(planned, done, ["v", "r"], "s1").collect()] == [(25.0, 5.0)]


def test_hmm_training(spark, tmp_path):
    import random

    rnd = random.Random(0)
    seqs = [[rnd.gauss(2.0 if i % 2 else 4.5, 0.3) for _ in range(15)] for i in range(120)]
    df = spark.createDataFrame([(s,) for s in seqs], "sequence array<double>").repartition(3)
    params, history = hmm.train_hmm(df, max_steps=30)
    assert all(b >= a - 1e-6 for a, b in zip(history, history[1:]))
    assert sorted(params.mu) == pytest.approx([2.0, 4.5], abs=0.1)
    config.write_hmm(spark, params, str(tmp_path / "m"))
    assert config.read_hmm(spark, str(tmp_path / "m")) == params
    longer, _ = hmm.train_hmm(df, length=35, max_steps=1)
    assert hmm.load_model(hmm.model_frame(spark, longer)).length == 35
    means = {r.role: r["mean"] for r in hmm.entropy_state_means(hmm.model_frame(spark, params)).collect()}
    assert means["malicious"] > means["benign"]


def test_classifier(spark, tmp_path):
    base = spark.range(2000).select(F.col("id").alias("row_id"), (F.col("id") % 2).cast("int").alias("label"))
    noise = lambda k: F.pmod(F.xxhash64("row_id", F.lit(k)), F.lit(100)) / 100
    rows = base.select("*", *[noise(k).alias(f) for k, f in enumerate(FEATURES[:-1])],
                       (noise(99) + F.col("label") * 0.8).alias(FEATURES[-1]))
    split = models.stratified_split(rows)
    model = models.train_classifier(split.where("split = 'train'"), rounds=5, depth=3)
    scored = models.classifier_scores(model, split.where("split = 'test'"))
    report = {r.row: r for r in metrics.classification_report(scored).collect()}
    assert report["ransom"].f1 > 0.8 and report["ransom"].support == 200
    ranked = models.feature_attribution(model, rows, sample=200).collect()
    assert ranked[0].feature == FEATURES[-1] and len(ranked) == 12
    config.write_classifier(model, str(tmp_path / "m"))
    again = models.classifier_scores(config.read_classifier(str(tmp_path / "m")), rows.limit(50))
    assert again.where("score between 0 and 1").count() == 50
    assert models.feature_importances(model)[0][0] == FEATURES[-1]


def test_tuning_config(spark):
    ratios = spark.createDataFrame([("high_velocity", 3.456), ("systematic_rename", 8.0)], "pattern string, ratio double")
    patterns = spark.createDataFrame([(50, 8)], "velocity_threshold int, rename_threshold int")
    thresholds = spark.createDataFrame([(30, 45, 70)], "alert_pct int, pause_pct int, critical_pct int")
    best = spark.createDataFrame([(35, 600)], "sequence_length int, n_sequences int")
    cfg = tuning.tuning_config(ratios, patterns, thresholds, best, 10, 5, "2025-01-01T00:00:00")
    assert cfg["likelihood_ratios"] == {"high_velocity": 3.46, "systematic_rename": 8.0}
    assert tuning.config_frame(spark, cfg).first().alert_thresholds.pause == 0.45


def test_audit_and_attack_export(spark, tmp_path):
    from fileguard.operators import forensics

    base = 1_700_000_000_000_000
    rows = [(i, base + t * 1_000_000, 0, i, "RENAMED", "a.enc", "p/a.enc", "a.doc", 2.0, p, False)
            for i, (t, p) in enumerate([(0, 0.9), (30, 0.1), (60, 0.8), (500, 0.7), (900, 0.2)])]
    scored = spark.createDataFrame(rows, """id bigint, ts_us bigint, drive_id bigint, stable_id bigint, event_type string,
        local_title string, full_path string, previous_title string, file_name_entropy double, fused double,
        malicious boolean""")
    alert_source.append_audit(forensics.audit_trail(scored), str(tmp_path / "audit"))
    stored = spark.read.parquet(str(tmp_path / "audit"))
    assert stored.where("suspicious").count() == 3
    inside = forensics.attack_events(stored)
    assert sorted((r.attack_no, r.id) for r in inside.collect()) == [(1, 0), (1, 1), (1, 2), (2, 3)]
    alert_source.export_attacks(inside, str(tmp_path / "csv"))
    back = spark.read.csv(str(tmp_path / "csv"), header=True, inferSchema=True)
    assert {(r.drive_id, r.attack_no, r.id) for r in back.collect()} == {(0, 1, 0), (0, 1, 1), (0, 1, 2), (0, 2, 3)}
    extensions = forensics.attack_extensions(inside).where("attack_no = 1").first()
    assert (extensions.old_extension, extensions.new_extension, extensions.n) == (".doc", ".enc", 3)
