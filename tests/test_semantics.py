import pytest
from pyspark.sql import functions as F

from fileguard.operators import decisions, detectors, features, fusion, metrics, snapshots, tuning
from fileguard.params import EngineParams
from fileguard.schemas import FEATURES

COLUMNS = """id bigint, timestamp double, drive_id bigint, stable_id bigint, event_type string, local_title string,
    full_path string"""


def flags(spark, rows):
    df = spark.createDataFrame([(i, t, 0, i % 90, k, n, n) for i, (t, k, n) in enumerate(rows)], COLUMNS)
    return [r for r in detectors.detector_flags(df).orderBy("id").collect()]


def test_rename_features_golden(spark):
    path = "MyProject\\SubFolder\\mydocument.encrypted"
    rows = [
        (1, 1.0, 0, 1234, "CREATED", "mydocument.docx", "mydocument.docx"),
        (2, 2.0, 0, 1234, "RENAMED", "mydocument.encrypted", path),
        (3, 3.0, 0, 77, "RENAMED", "mydocument.encrypted", path),
    ]
    got = {r.id: r for r in features.file_features(spark.createDataFrame(rows, COLUMNS), sep="\\").collect()}
    values = [got[2][f] for f in FEATURES]
    assert values == pytest.approx([0, 0, 0, 1, 1, 0, 0, 40, 2, 20, 0.266667, 3.484184], abs=1e-6)
    assert got[3].extension_similarity == 1.0


def test_null_title_and_path(spark):
    rows = [(1, 1.0, 0, 5, "RENAMED", None, None), (2, 2.0, 0, 5, "RENAMED", "a.txt", None)]
    got = {r.id: r for r in features.file_features(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert got[1].file_name_entropy == 0 and got[2].extension_similarity == 1.0 and got[2].path_length == 0


def test_burst_golden(spark):
    rows = [(4900.0, "CREATED", "start.txt"), *((4980 + i / 4, "RENAMED", f"n{i}.locked") for i in range(72))]
    last = flags(spark, rows)[-1]
    assert (last.high_velocity, last.systematic_rename, last.recent_writes) == (True, True, 72)


def test_window_edge(spark):
    got = flags(spark, [(t, "CREATED", "x") for t in (0.0, 10.5, 60.0, 60.001, 70.5)])
    assert [r.recent_writes for r in got] == [1, 2, 3, 3, 4]


def test_thresholds_and_case(spark):
    got = flags(spark, [(i * 0.1, "CREATED", "x") for i in range(51)])
    assert [r.high_velocity for r in got[-2:]] == [False, True]
    got = flags(spark, [(float(i), "RENAMED", "a.enc") for i in range(5)])
    assert [r.systematic_rename for r in got] == [False] * 4 + [True]
    mixed = flags(spark, [(float(i), "RENAMED", "A.ENC" if i == 2 else "a.enc") for i in range(6)])
    assert not any(r.systematic_rename for r in mixed)


def test_scenarios(spark):
    deletes = [(i * 0.05, "CREATED", f"f{i}.docx") for i in range(30)] + [
        (2.5 + i * 0.1, "DELETED", f"f{i}.docx") for i in range(30)
    ]
    assert not any(r.high_velocity or r.systematic_rename for r in flags(spark, deletes))
    fast = [(i * 0.05, "CREATED", f"f{i}.docx") for i in range(50)] + [
        (4.5 + i * 0.1, "RENAMED", f"f{i}.docx.encrypted") for i in range(50)
    ]
    last = flags(spark, fast)[-1]
    assert last.high_velocity and last.systematic_rename
    calm = [(i * 3.5, "CREATED" if i % 2 else "MODIFIED", f"n{i}.txt") for i in range(8)]
    assert not any(r.high_velocity or r.systematic_rename for r in flags(spark, calm))


# Fixed values of the scoring rule: they must come out as they are.
def test_fusion_goldens(spark):
    rows = [(0.60, True, True), (0.05, False, False), (1.0, True, True)]
    df = spark.createDataFrame(rows, "score double, high_velocity boolean, systematic_rename boolean")
    got = [r.fused for r in fusion.fused_scores(df).collect()]
    assert got == pytest.approx([18 / 19, 0.05, 0.99999999992], abs=1e-9)
    single = df.withColumn("score", F.col("score").cast("float"))
    assert max(r.fused for r in fusion.fused_scores(single).collect()) < 1


def test_bands(spark):
    cases = {0.35: "LOW", 0.65: "MEDIUM", 0.82: "HIGH", 0.3: "LOW", 0.5: "MEDIUM", 0.75: "HIGH", 0.9: "CRITICAL",
             1.0: "CRITICAL", 0.1: "LOW"}
    df = spark.createDataFrame([(k,) for k in cases], "p double")
    got = {r.p: r.level for r in df.select("p", decisions.threat_level(F.col("p")).alias("level")).collect()}
    assert got == cases


def test_learned_config_applies():
    config = {
        "likelihood_ratios": {"high_velocity": 2.25, "systematic_rename": 9.5},
        "micropattern_thresholds": {
            "high_velocity": {"threshold": 64, "window_seconds": 45},
            "systematic_rename": {"threshold": 11, "window_seconds": 45},
        },
        "alert_thresholds": {"alert": 0.2, "pause": 0.4, "critical": 0.8},
        "hmm_parameters": {"sequence_length": 21, "n_states": 2, "n_sequences_per_class": 350},
    }
    p = EngineParams().with_config(config)
    assert (p.detector.rename_threshold, p.decision.pause, p.hmm.length) == (11, 0.4, 21)
    assert p.fusion.ratios["systematic_rename"] == 9.5


SNAP = """drive_id bigint, stable_id bigint, local_title string, modified_date bigint, file_size bigint, trashed int,
    full_path string"""


def test_snapshot_precedence(spark):
    before = spark.createDataFrame(
        [(0, 1, "a", 1, 1, 0, "a"), (0, 2, "b", 1, None, 0, "b"), (0, 3, "c", 1, 1, 1, "c"), (0, 4, "d", 1, 1, 0, "d")],
        SNAP,
    )
    after = spark.createDataFrame(
        [(0, 1, "a2", 2, 9, 1, "a2"), (0, 2, "b", 1, None, 0, "b"), (0, 3, "c", 1, 1, 0, "c"),
         (0, 4, "d", 1, None, 1, "d"), (0, 5, None, 1, None, 0, "")],
        SNAP,
    )
    got = {r.stable_id: r for r in snapshots.snapshot_diff(before, after).collect()}
    assert {k: r.event_type for k, r in got.items()} == {1: "RENAMED", 4: "MODIFIED", 5: "CREATED"}
    assert got[1].old_local_title == "a" and got[4].file_size == 0 and got[5].file_size == 0


def test_missing_parent_gives_bare_title(spark):
    items = spark.createDataFrame(
        [(0, 1, "f.txt", 1, 1, 0, 0), (0, 2, "g.txt", 1, 1, 0, 0), (0, 9, "Photos", 1, None, 0, 1)],
        "drive_id bigint, stable_id bigint, local_title string, modified_date bigint, file_size bigint, trashed int, is_folder int",
    )
    parents = spark.createDataFrame([(0, 1, 9), (0, 2, 8)], "drive_id bigint, item_stable_id bigint, parent_stable_id bigint")
    rows = snapshots.snapshot_table(items, parents, sep="\\").collect()
    assert {r.stable_id: r.full_path for r in rows} == {1: "Photos\\f.txt", 2: "g.txt"}


def test_fusion_is_monotone(spark):
    grid = spark.range(101).select((F.col("id") / 100).alias("score")).withColumn(
        "high_velocity", F.explode(F.array(F.lit(False), F.lit(True)))
    ).withColumn("systematic_rename", F.explode(F.array(F.lit(False), F.lit(True))))
    rows = {(r.score, r.high_velocity, r.systematic_rename): r.fused for r in fusion.fused_scores(grid).collect()}
    scores = sorted({k[0] for k in rows})
    for v in (False, True):
        for w in (False, True):
            series = [rows[s, v, w] for s in scores]
            assert series == sorted(series)
            assert all(rows[s, True, w] >= rows[s, False, w] for s in scores)


def test_metrics_without_positives(spark):
    df = spark.createDataFrame([(0, 0, 0.1), (0, 1, 0.2)], "label int, prediction int, score double")
    r = metrics.precision_recall_f1(df).first()
    assert (r.precision, r.recall, r.f1) == (0.0, 0.0, 0.0)
    assert metrics.roc_auc(df).first().auc is None


def test_auc_against_library(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    df = spark.range(3000).select(
        (F.xxhash64("id") % 2 == 0).cast("double").alias("label"),
        (F.pmod(F.xxhash64(F.col("id") + 1), F.lit(50)) / 50 + F.when(F.xxhash64("id") % 2 == 0, 0.2).otherwise(0.0)).alias("score"),
    )
    library = BinaryClassificationEvaluator(rawPredictionCol="score").evaluate(df)
    assert metrics.roc_auc(df).first().auc == pytest.approx(library, abs=1e-9)


def test_pareto_front_random(spark):
    import random

    rnd = random.Random(8)
    rows = [(i, rnd.randrange(40) / 7, rnd.randrange(40) / 3) for i in range(300)]
    got = sorted(r.trial for r in tuning.pareto_front(spark.createDataFrame(rows, "trial int, f1 double, f2 double")).collect())
    beaten = lambda t: any(o[1] >= t[1] and o[2] >= t[2] and (o[1] > t[1] or o[2] > t[2]) for o in rows)
    assert got == sorted(t[0] for t in rows if not beaten(t))


def test_event_ids_per_poll(spark):
    rows = [(d, f, "CREATED") for d in (0, 1) for f in (5, 900, 17, 3)]
    diff = spark.createDataFrame(rows, "drive_id bigint, stable_id bigint, event_type string")
    got = snapshots.as_file_events(diff, F.lit(7.5), F.lit(100), ids_per_chunk=10).orderBy("drive_id", "id").collect()
    assert [(r.drive_id, r.id, r.stable_id) for r in got] == [
        (d, 100 + i, f) for d in (0, 1) for i, f in enumerate((3, 5, 17, 900))
    ]
    assert {r.timestamp for r in got} == {7.5}
