"""Scoring and odds-form fusion of the score with the detector flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fileguard.params import FusionParams, ScorecardParams


def scorecard_score(params: ScorecardParams = ScorecardParams()) -> Column:
    total = F.lit(params.intercept)
    for name, weight in params.weights.items():
        total = total + F.lit(weight) * F.col(name).cast("double")
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def event_scores(features: DataFrame, params: ScorecardParams = ScorecardParams()) -> DataFrame:
    """Add ``score``, the linear scorecard's probability of malice. ``models.classifier_scores`` is the trained twin."""
    return features.withColumn("score", scorecard_score(params))


def fused_probability(score: Column, params: FusionParams = FusionParams()) -> Column:
    """Turn a probability into odds, multiply by the ratio of every true flag, turn back. All in double."""
    p = score.cast("double")
    odds = p / (F.lit(1.0) - p + F.lit(params.epsilon))
    for flag, ratio in params.ratios.items():
        odds = odds * F.when(F.col(flag), F.lit(float(ratio))).otherwise(F.lit(1.0))
    return odds / (F.lit(1.0) + odds)


def fused_scores(scored: DataFrame, params: FusionParams = FusionParams()) -> DataFrame:
    """Add ``fused`` from ``score`` and the flag columns."""
    out = scored.withColumn("_score", F.col("score").cast("double"))
    return out.withColumn("fused", fused_probability(F.col("_score"), params)).drop("_score")
