"""Parameter tables, contributions, sketches and the likelihood search on hand-made rows."""

import math

import pytest
from pyspark.sql import functions as F

from fileguard.operators import metrics, models, parameters, tuning
from fileguard.operators.fusion import fused_probability
from fileguard.params import FusionParams

WORDS = [
    ("bad", parameters.PATH, parameters.ANYWHERE, "Temp", None, None), ("bad", parameters.PATH, parameters.ANYWHERE, "new", 100, None),
    ("bad", parameters.PATH, parameters.ANYWHERE, "old", None, 100), ("bad", parameters.PATH, parameters.ANYWHERE, "", None, None),
    ("run", parameters.TITLE, parameters.AT_END, ".exe", None, None), ("run", parameters.TITLE, parameters.AT_END, "xe", 50, 60),
]


def test_words_change_exactly_the_rows_they_should(spark):
    rows = [
        (1, 0, "a.exe", "x/TEMPLATE"), (2, 0, "a.exe.txt", "new"), (3, 100, "A.EXE", "brand-New"), (4, 99, "b", "old"), (5, 100, "b", "old"),
        (6, 55, "fxe", None), (7, 60, "fxe", ""), (8, 0, None, "tem p"), (9, 0, ".exe", "temp" * 3),
    ]
    events = spark.createDataFrame(rows, "id long, ts_us long, local_title string, full_path string")
    words = spark.createDataFrame(WORDS, parameters.WORDS)
    got = {r["id"]: (r["bad"], r["run"]) for r in parameters.word_flags(events, words, ["bad", "run"]).collect()}
    assert got == {1: (1, 1), 2: (0, 0), 3: (1, 1), 4: (1, 0), 5: (0, 0), 6: (0, 1), 7: (0, 0), 8: (0, 0), 9: (1, 1)}
    none = parameters.word_flags(events, words.where("false"), ["bad"])
    assert none.agg(F.sum("bad")).first()[0] == 0


def test_versions_hold_from_their_time_on(spark):
    versions = [(10 * k, 10 * k, 5, 1.0 + k, 2.0) for k in range(1, 12)]
    table = spark.createDataFrame(versions, parameters.VERSIONS)
    events = spark.createDataFrame([(t,) for t in range(0, 130)], "ts_us long")
    got = {r["ts_us"]: r["v"] for r in parameters.as_of(events, table).select("ts_us", F.col("version.velocity_threshold").alias("v")).collect()}
    assert got == {t: (min(110, t // 10 * 10) or None) for t in range(130)}
    measured = events.withColumns({"recent_writes": F.lit(25), "recent_renames": F.lit(9), "rename_extensions": F.lit(1)})
    flags = {r["ts_us"]: (r["high_velocity"], r["systematic_rename"], r["evidence"]) for r in parameters.flags_as_of(measured, table).collect()}
    assert flags[5] == (False, False, 1.0) and flags[15] == (True, True, 4.0) and flags[29] == (True, True, 6.0) and flags[30] == (False, True, 2.0)
    assert parameters.as_of(events, table.where("false")).where("version is not null").isEmpty()
    with pytest.raises(ValueError):
        parameters.bounded(table, 5)


def test_contributions_sum_and_are_symmetric(spark):
    rows = spark.createDataFrame([(1, 1.0, 1.0, 5.0, 2.0), (2, 3.0, 3.0, 0.0, -1.0), (3, 0.0, 0.0, 0.0, 0.0)], "row_id long, a double, b double, c double, d double")
    # a and b stand for each other; c does nothing.
    scorer = lambda x: x.withColumn("score", F.col("a") * F.col("b") + F.col("d"))
    found = {r["row_id"]: r for r in models.sampled_shapley(rows, scorer, dict.fromkeys("abcd", 0.0), chains=64).collect()}
    for r in found.values():
        assert r["phi_a"] + r["phi_b"] + r["phi_c"] + r["phi_d"] == pytest.approx(r["prediction"] - r["base"])
        assert r["phi_c"] == 0
    assert found[1]["phi_d"] == pytest.approx(2.0) and found[2]["phi_d"] == pytest.approx(-1.0)
    assert abs(found[2]["phi_a"] - found[2]["phi_b"]) < 0.35 * 9 and found[3]["phi_a"] == 0
    orders = models.permutations(list("abcd"), 200, 1)
    assert all(sorted(o.values()) == [1, 2, 3, 4] for o in orders) and len({tuple(o.items()) for o in orders}) == 24


def test_merged_sketches_equal_the_whole_and_the_exact_quantile(spark):
    import random

    rng = random.Random(2)
    counts = {m: max(1, int(rng.lognormvariate(4, 1.2))) for m in range(400)}
    rows = [(m % 2, 60.0 * m + 0.01 * (i % 5000)) for m, n in counts.items() for i in range(n)]
    events = spark.createDataFrame(rows, "drive_id long, timestamp double")
    sketch = metrics.burst_sketch(events).persist()
    for q in (0.5, 0.95, 1.0):
        whole = {r["drive_id"]: r["typical_burst_size"] for r in metrics.sketch_quantile(sketch, q).collect()}
        parts = metrics.merge_sketches(metrics.merge_sketches(sketch.where("hour < 3")), sketch.where("hour >= 3"))
        assert {r["drive_id"]: r["typical_burst_size"] for r in metrics.sketch_quantile(parts, q).collect()} == whole
        for drive in (0, 1):
            own = sorted(n for m, n in counts.items() if m % 2 == drive)
            exact = own[math.ceil(q * len(own)) - 1]
            assert exact <= whole[drive] < exact * (1 + 1 / 64) + 1e-9
    assert max(r["n"] for r in sketch.groupBy("drive_id", "hour").agg(F.sum("minutes").alias("n")).collect()) <= 60


def test_likelihood_search_equals_scoring_every_row_again(spark):
    import random

    rng = random.Random(7)
    rows = []
    for _ in range(600):
        label = int(rng.random() < 0.4)
        # Scores in the middle of their steps, so that rounding to a step loses nothing of the order.
        at = round(rng.gauss(0.8 * label - 1.5, 1.0), 2) + 0.0005
        rows.append((label, 1 / (1 + math.exp(-at)), rng.random() < 0.2 + 0.4 * label, rng.random() < 0.1 + 0.3 * label))
    table = spark.createDataFrame(rows, "label int, score double, high_velocity boolean, systematic_rename boolean")
    found = {(r["velocity_ratio"], r["rename_ratio"]): r for r in tuning.likelihood_sweep(table, [1.5, 4.0], [2.0, 11.0]).collect()}
    assert len(found) == 4
    for (v, w), r in found.items():
        params = FusionParams(ratios={"high_velocity": v, "systematic_rename": w})
        fused = [(x["label"], round(x["f"], 12)) for x in table.select("label", fused_probability(F.col("score"), params).alias("f")).collect()]
        tp, fp = sum(y and f >= 0.5 for y, f in fused), sum(not y and f >= 0.5 for y, f in fused)
        pos, neg = [f for y, f in fused if y], [f for y, f in fused if not y]
        area = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
        assert r["f1"] == pytest.approx(2 * tp / (tp + fp + len(pos)), abs=2e-3)
        assert r["auc"] == pytest.approx(area, abs=2e-3)
