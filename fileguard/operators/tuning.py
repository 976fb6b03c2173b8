"""Parameter tuning as sweeps: a small parameter grid is evaluated against tables reduced to a few counts first."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fileguard.operators.metrics import place_in_ranges, ratio, score_counts, with_totals_below
from fileguard.operators.models import class_rows
from fileguard.params import FusionParams
from fileguard.session import cut_lineage


def likelihood_ratios(flagged: DataFrame, flags: tuple[str, ...] = ("high_velocity", "systematic_rename")) -> DataFrame:
    """Measured evidence multipliers: P(flag | malicious) / P(flag | benign), one added to every count."""
    counted = flagged.groupBy("label").agg(
        F.count("*").alias("n"), *[F.sum(F.col(f).cast("bigint")).alias(f) for f in flags]
    )
    share = {f: (F.col(f) + F.lit(1.0)) / (F.col("n") + F.lit(2.0)) for f in flags}
    one_row = counted.agg(
        *[
            (F.max(F.when(F.col("label") == 1, share[f])) / F.max(F.when(F.col("label") == 0, share[f]))).alias(f)
            for f in flags
        ]
    )
    pairs = F.array(*[F.struct(F.lit(f).alias("pattern"), F.col(f).alias("ratio")) for f in flags])
    return one_row.select(F.explode(pairs).alias("p")).select("p.*")


#: Scores are told apart to this step of their log odds; it bounds the summary, whatever the number of rows.
ODDS_STEP = 0.001
LEAST_SCORE = 1e-12


def likelihood_sweep(
    scored: DataFrame,
    velocity: list[float] = [1.5 + 0.5 * k for k in range(18)],
    rename: list[float] = [2.0 + k for k in range(14)],
    fusion: FusionParams = FusionParams(),
    step: float = ODDS_STEP,
) -> DataFrame:
    """Trials (velocity_ratio, rename_ratio, f1, auc) of the fused score over a grid of evidence multipliers.

    A multiplier shifts the log odds of all events with one pattern of flags. So the rows (``label``, ``score`` and both flags)
    are reduced once to positives and negatives by pattern and step of log odds: at most four tables of some 50,000 steps. A
    trial shifts the four tables and merges them; no row is scored again. F1 is that of fused odds of at least 1.
    """
    p = F.col("score").cast("double")
    odds = F.log(F.greatest(p, F.lit(LEAST_SCORE))) - F.log(F.lit(1.0) - p + F.lit(fusion.epsilon))
    flags = [F.coalesce(F.col(f), F.lit(False)) for f in ("high_velocity", "systematic_rename")]
    cells = scored.groupBy(flags[0].alias("v"), flags[1].alias("r"), F.floor(odds / F.lit(step)).cast("bigint").alias("at")).agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")
    )
    table = cells.toPandas()
    spark = scored.sparkSession
    shared = spark.sparkContext.broadcast({c: table[c].to_numpy() for c in table.columns})

    def tried(grids: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for grid in grids:
            rated = [_merged(known, step, v, r) for v, r in zip(grid["velocity_ratio"], grid["rename_ratio"], strict=True)]
            yield grid.assign(f1=[x[0] for x in rated], auc=[x[1] for x in rated])

    grid = spark.createDataFrame([(v, r) for v in velocity for r in rename], "velocity_ratio double, rename_ratio double")
    return grid.repartition(spark.sparkContext.defaultParallelism).mapInPandas(tried, "velocity_ratio double, rename_ratio double, f1 double, auc double")


def _merged(known: dict[str, np.ndarray], step: float, velocity: float, rename: float) -> tuple[float, float | None]:
    """F1 and area of the four tables under the shifts of one trial; a tie counts half."""
    shift = np.where(known["v"], np.log(velocity), 0.0) + np.where(known["r"], np.log(rename), 0.0)
    value, of = np.unique(known["at"] * step + shift, return_inverse=True)
    pos, neg = (np.bincount(of, weights=known[c], minlength=len(value)) for c in ("pos", "neg"))
    above = value >= 0
    tp, fp, all_pos = pos[above].sum(), neg[above].sum(), pos.sum()
    precision, recall = tp / (tp + fp) if tp + fp else 0.0, tp / all_pos if all_pos else 0.0
    f1 = 2 * precision * recall / (precision + recall) if precision + recall else 0.0
    pairs = all_pos * neg.sum()
    area = (pos * (np.cumsum(neg) - neg / 2)).sum()
    return float(f1), float(area / pairs) if pairs else None


def _value_grid(source: DataFrame, axes: dict[str, list[float] | list[int]]) -> DataFrame:
    """All combinations of fixed parameter values beside each row of ``source``; exploded, so no join is needed."""
    out = source
    for name, values in axes.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r == 0, F.lit(0.0)).otherwise(F.lit(2.0) * p * r / (p + r))


def micropattern_sweep(labelled: DataFrame, user_burst: float | Column | None = None) -> DataFrame:
    """Trials (velocity_threshold, rename_threshold, f1, precision) over 15..100 step 5 and 3..20.

    Uses the proxies the thresholds were tuned with: a created file counts 60 writes, so a row trips the velocity pattern
    when 60 times its value reaches the threshold, and a class trips the rename pattern when enough of its rows changed
    extension. A velocity threshold below ``user_burst`` (measured by ``activity_baseline``) costs 0.1 of F1. The
    training table is reduced to one count for each velocity step and class before the grid is laid out.
    """
    velocities, renames = list(range(15, 101, 5)), list(range(3, 21))
    trips = lambda v: F.col("file_created") * 60 >= v
    counts = labelled.agg(
        *[
            F.coalesce(F.sum(F.when((F.col("label") == k) & test, 1).otherwise(0)), F.lit(0)).cast("bigint").alias(n + s)
            for k, s in ((0, "_ben"), (1, "_mal"))
            for n, test in (
                ("n", F.lit(True)),
                ("changed", F.col("extension_similarity") < 0.5),
                *((f"created{v}", trips(v)) for v in velocities),
            )
        ]
    )
    grid = _value_grid(counts, {"velocity_threshold": velocities, "rename_threshold": renames})

    def triggers(s: str) -> Column:
        velocity = F.get(
            F.array(*[F.col(f"created{v}{s}") for v in velocities]),
            ((F.col("velocity_threshold") - velocities[0]) / 5).cast("int"),
        )
        return velocity + (F.col(f"changed{s}") >= F.col("rename_threshold")).cast("bigint")

    tp, fp = triggers("_mal"), triggers("_ben")
    rated = grid.select(
        "velocity_threshold",
        "rename_threshold",
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, F.col("n_mal")).alias("recall"),
    )
    below = F.lit(False) if user_burst is None else F.col("velocity_threshold") < F.lit(user_burst)
    penalty = F.when(below, 0.1).otherwise(0.0)
    return rated.select(
        "velocity_threshold",
        "rename_threshold",
        (_f1(F.col("precision"), F.col("recall")) - penalty).alias("f1"),
        "precision",
    )


def detector_sweep(measured: DataFrame, velocity: list[int], rename: list[int]) -> DataFrame:
    """Trials over real detector counts: an event is predicted malicious when either flag would be set.

    ``measured`` has ``label`` and the window measures. Counts above the largest threshold behave alike, so rows are
    first reduced to (label, capped writes, capped single-extension renames), a table bounded by the grid's limits.
    """
    writes = F.least(F.col("recent_writes"), F.lit(max(velocity) + 1))
    renames = F.when(F.col("rename_extensions") == 1, F.least(F.col("recent_renames"), F.lit(max(rename)))).otherwise(0)
    cells = measured.groupBy("label", writes.alias("w"), renames.alias("r")).agg(F.count("*").alias("n"))
    grid = _value_grid(cells, {"velocity_threshold": velocity, "rename_threshold": rename})
    hit = (F.col("w") > F.col("velocity_threshold")) | (F.col("r") >= F.col("rename_threshold"))
    cell = lambda k, test: F.sum(F.when((F.col("label") == k) & test, F.col("n")).otherwise(0))
    rated = grid.groupBy("velocity_threshold", "rename_threshold").agg(
        cell(1, hit).alias("tp"), cell(0, hit).alias("fp"), cell(1, ~hit).alias("fn")
    )
    tp = F.col("tp")
    rated = rated.withColumns(
        {"precision": ratio(tp, tp + F.col("fp")), "recall": ratio(tp, tp + F.col("fn"))}
    )
    return rated.select(
        "velocity_threshold",
        "rename_threshold",
        _f1(F.col("precision"), F.col("recall")).alias("f1"),
        "precision",
        "recall",
    )


def alert_threshold_sweep(scored: DataFrame) -> DataFrame:
    """Trials (alert, pause, critical, f1, recall) in steps of 5 percent, thresholds rising by at least 5 percent.

    F1 at the pause threshold plus a bonus of up to 0.05 for spacing. Scores are reduced to one count per 5-percent
    step, so the sweep never touches the rows again. Thresholds are kept in percent to stay exact.
    """
    # The highest of the thresholds 0.05, 0.10, ... that the score reaches, compared with the thresholds themselves.
    reached = F.filter(F.array(*[F.lit(k / 100) for k in range(5, 101, 5)]), lambda bound: bound <= F.col("score"))
    step = F.size(reached) * 5
    cells = scored.groupBy(step.alias("percent")).agg(
        F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col("label") == 0, 1).otherwise(0)).alias("neg"),
    )
    at_pause = _value_grid(cells, {"pause_pct": list(range(35, 86, 5))})
    above = F.col("percent") >= F.col("pause_pct")
    rated = at_pause.groupBy("pause_pct").agg(
        F.sum(F.when(above, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(above, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum("pos").alias("p"),
    )
    rated = rated.select(
        "pause_pct",
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        ratio(F.col("tp"), F.col("p")).alias("recall"),
    )
    grid = _value_grid(rated, {"alert_pct": list(range(30, 66, 5)), "critical_pct": list(range(40, 96, 5))}).where(
        (F.col("alert_pct") + 5 <= F.col("pause_pct")) & (F.col("pause_pct") + 5 <= F.col("critical_pct"))
    )
    spacing = (F.col("critical_pct") - F.col("alert_pct")) / F.lit(100.0)
    bonus = F.least(spacing / F.lit(0.4), F.lit(1.0)) * F.lit(0.05)
    return grid.select(
        "alert_pct",
        "pause_pct",
        "critical_pct",
        (_f1(F.col("precision"), F.col("recall")) + bonus).alias("f1"),
        "recall",
    )


def chunk_means(
    labelled: DataFrame,
    lengths: list[int],
    per_class: int | None,
    value: str = "file_name_entropy",
    row_id: str = "row_id",
) -> DataFrame:
    """(length, label, chunk, mean) over each class's first ``per_class`` consecutive full chunks of every length;
    over all of them if ``per_class`` is None.

    Rows no chunk of any length can reach are left out before they are repeated per length.
    """
    rows = class_rows(labelled, value, row_id)
    if per_class is not None:
        rows = rows.where(F.col("pos") < per_class * max(lengths))
    rows = _value_grid(rows, {"length": lengths})
    if per_class is not None:
        rows = rows.where(F.col("pos") < F.col("length") * per_class)
    return (
        rows.groupBy("length", "label", F.floor(F.col("pos") / F.col("length")).cast("bigint").alias("chunk"))
        .agg(F.avg(value).alias("mean"), F.count("*").alias("_n"))
        .where("_n = length")
        .drop("_n")
    )


def hmm_separability(
    labelled: DataFrame,
    lengths: list[int] = list(range(10, 36, 5)),
    n_sequences: list[int] = list(range(300, 1501, 100)),
    value: str = "file_name_entropy",
    row_id: str = "row_id",
    whole: bool = True,
) -> DataFrame:
    """Trials (sequence_length, n_sequences, ks, cohens_d): how far the classes' chunk means lie apart.

    With ``whole``, each length has one more trial over all full chunks, whose ``n_sequences`` is null. Every other trial uses at most ``n_sequences`` chunks per class, so after the chunk means the data is bounded by the
    grid: lengths x the largest number of sequences x 2 rows.
    """
    means = chunk_means(labelled, lengths, max(n_sequences), value, row_id)
    trials = _value_grid(means, {"n_sequences": n_sequences}).where("chunk < n_sequences")
    keys = ["length", "n_sequences"]
    is_mal = F.col("label") == 1
    stats = trials.groupBy(*keys).agg(
        F.sum((~is_mal).cast("bigint")).alias("n0"),
        F.sum(is_mal.cast("bigint")).alias("n1"),
        F.avg(F.when(is_mal, F.col("mean"))).alias("m1"),
        F.avg(F.when(~is_mal, F.col("mean"))).alias("m0"),
        F.var_pop(F.when(is_mal, F.col("mean"))).alias("v1"),
        F.var_pop(F.when(~is_mal, F.col("mean"))).alias("v0"),
    )
    values = trials.groupBy(*keys, "mean").agg(
        F.sum((~is_mal).cast("bigint")).alias("c0"), F.sum(is_mal.cast("bigint")).alias("c1")
    )
    along = Window.partitionBy(*keys).orderBy("mean")
    steps = values.select(*keys, F.sum("c0").over(along).alias("c0"), F.sum("c1").over(along).alias("c1"))
    gaps = steps.join(stats, keys).where("n0 > 0 and n1 > 0")
    ks = gaps.groupBy(*keys).agg(F.max(F.abs(F.col("c0") / F.col("n0") - F.col("c1") / F.col("n1"))).alias("ks"))
    pooled = F.sqrt((F.col("v0") + F.col("v1")) / F.lit(2.0)) + F.lit(1e-10)
    both = F.col("ks").isNotNull()
    bounded = stats.join(ks, keys, "left").select(
        F.col("length").alias("sequence_length"),
        "n_sequences",
        F.coalesce("ks", F.lit(0.0)).alias("ks"),
        F.when(both, (F.col("m1") - F.col("m0")) / pooled).otherwise(0.0).alias("cohens_d"),
    )
    return bounded.unionByName(separability_of_all(labelled, lengths, value, row_id)) if whole else bounded


def separability_of_all(
    labelled: DataFrame, lengths: list[int], value: str = "file_name_entropy", row_id: str = "row_id"
) -> DataFrame:
    """The trial over all full chunks for every length, with a null ``n_sequences``; no length is ordered in one task."""
    means = cut_lineage(chunk_means(labelled, lengths, None, value, row_id))
    is_mal = F.col("label") == 1
    trials = []
    for length in lengths:
        own = means.where(F.col("length") == length)
        stats = own.agg(
            F.count_if(~is_mal).alias("n0"),
            F.count_if(is_mal).alias("n1"),
            F.avg(F.when(is_mal, F.col("mean"))).alias("m1"),
            F.avg(F.when(~is_mal, F.col("mean"))).alias("m0"),
            F.var_pop(F.when(is_mal, F.col("mean"))).alias("v1"),
            F.var_pop(F.when(~is_mal, F.col("mean"))).alias("v0"),
        ).where("n0 + n1 > 0")
        values = own.groupBy("mean").agg(F.count_if(~is_mal).alias("c0"), F.count_if(is_mal).alias("c1"))
        steps = with_totals_below(values, "mean", ["c0", "c1"]).crossJoin(stats.select("n0", "n1")).where("n0 > 0 and n1 > 0")
        gap = (F.col("c0_below") + F.col("c0")) / F.col("n0") - (F.col("c1_below") + F.col("c1")) / F.col("n1")
        pooled = F.sqrt((F.col("v0") + F.col("v1")) / F.lit(2.0)) + F.lit(1e-10)
        trials.append(stats.crossJoin(steps.agg(F.max(F.abs(gap)).alias("ks"))).select(
            F.lit(length).alias("sequence_length"),
            F.lit(None).cast("int").alias("n_sequences"),
            F.coalesce("ks", F.lit(0.0)).alias("ks"),
            F.when(F.col("ks").isNotNull(), (F.col("m1") - F.col("m0")) / pooled).otherwise(0.0).alias("cohens_d"),
        ))
    out = trials[0]
    for trial in trials[1:]:
        out = out.unionByName(trial)
    return out


def ks_statistic(scored: DataFrame, score: str = "score") -> DataFrame:
    """Largest gap between the classes' score distributions over a table of any size."""
    counts = with_totals_below(score_counts(scored, score), "score", ["pos", "neg"])
    pos, neg = counts.agg(F.sum("pos")).scalar(), counts.agg(F.sum("neg")).scalar()
    gap = (F.col("pos_below") + F.col("pos")) / pos - (F.col("neg_below") + F.col("neg")) / neg
    return counts.agg(F.max(F.abs(gap)).alias("ks"))


def pareto_front(trials: DataFrame) -> DataFrame:
    """Trials no other trial beats in one objective without losing the other; both ``f1`` and ``f2`` are maximised.

    Trials with equal objectives stand or fall together. A trial can only be beaten by the best ``f2`` among larger
    ``f1`` or equal ``f1``, so the table is first reduced to the best ``f2`` of every distinct ``f1``.
    """
    best = trials.groupBy("f1").agg(F.max("f2").alias("f2"))
    return trials.join(_front_of_levels(best), ["f1", "f2"], "left_semi")


def _front_of_levels(best: DataFrame, ranges: int = 256) -> DataFrame:
    """Rows (f1, f2) whose f2 exceeds every f2 at larger f1, taken range by range of f1: a row must exceed the best f2
    of all higher ranges (at most ``ranges`` numbers) and of the higher rows inside its own range."""
    placed = place_in_ranges(best, "f1", ranges)
    higher = Window.partitionBy(F.lit(0)).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    bars = placed.groupBy("_range").agg(F.max("f2").alias("m")).select("_range", F.max("m").over(higher).alias("_bar"))
    alive = placed.join(F.broadcast(bars), "_range").where("_bar is null or f2 > _bar")
    within = Window.partitionBy("_range").orderBy(F.desc("f1")).rowsBetween(Window.unboundedPreceding, -1)
    return (
        alive.withColumn("_higher", F.max("f2").over(within)).where("_higher is null or f2 > _higher").select("f1", "f2")
    )


def best_trial(trials: DataFrame, params: list[str]) -> DataFrame:
    """The front member with the largest first objective: largest f1, then largest f2, then smallest parameters."""
    order = F.struct("f1", "f2", *[-F.col(p) for p in params])
    return trials.agg(F.max_by(F.struct(*params, "f1", "f2"), order).alias("t")).select("t.*")


def new_trials(planned: DataFrame, done: DataFrame, params: list[str], study: str) -> DataFrame:
    """Planned parameter rows of a study that its stored trials do not cover yet."""
    mine = done.where(F.col("study") == study).select(*[F.col(f"params.{p}").cast("double").alias(p) for p in params])
    return planned.withColumns({p: F.col(p).cast("double") for p in params}).join(mine, params, "left_anti")


def as_trials(results: DataFrame, study: str, params: list[str], f1: str, f2: str) -> DataFrame:
    """Results in the shape of the trial history: study, params, f1, f2."""
    entries = F.create_map(*[x for p in params for x in (F.lit(p), F.col(p).cast("double"))])
    return results.select(
        F.lit(study).alias("study"), entries.alias("params"), F.col(f1).alias("f1"), F.col(f2).alias("f2")
    )


def tuning_config(
    ratios: DataFrame,
    patterns: DataFrame,
    thresholds: DataFrame,
    hmm: DataFrame,
    training_samples: int,
    user_events: int,
    generated_at: str,
    window_seconds: int = 60,
) -> dict:
    """Assemble the learned configuration from the four one-row (or two-row) results of the sweeps."""
    measured = {r["pattern"]: round(r["ratio"], 2) for r in ratios.collect()}
    p, t, h = patterns.first(), thresholds.first(), hmm.first()
    return {
        "likelihood_ratios": measured,
        "micropattern_thresholds": {
            "high_velocity": {"threshold": p["velocity_threshold"], "window_seconds": window_seconds},
            "systematic_rename": {"threshold": p["rename_threshold"], "window_seconds": window_seconds},
        },
        "alert_thresholds": {k: t[f"{k}_pct"] / 100 for k in ("alert", "pause", "critical")},
        "hmm_parameters": {
            "sequence_length": h["sequence_length"],
            "n_states": 2,
            "n_sequences_per_class": h["n_sequences"],
        },
        "metadata": {
            "generated_at": generated_at,
            "training_samples": training_samples,
            "user_events": user_events,
            "optimization_method": "grid_sweep",
            "version": "2.0",
        },
    }


def config_frame(spark: SparkSession, config: dict) -> DataFrame:
    from fileguard.schemas import LEARNED_CONFIG

    return spark.createDataFrame([json.dumps(config)], "string").select(
        F.from_json("value", LEARNED_CONFIG).alias("c")
    ).select("c.*")
