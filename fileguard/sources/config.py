"""Learned configuration, trial history and model parameters on disk."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fileguard.operators.hmm import load_model, model_frame
from fileguard.operators.tuning import config_frame
from fileguard.params import HmmParams
from fileguard.schemas import LEARNED_CONFIG


def write_config(spark: SparkSession, config: dict, path: str) -> None:
    config_frame(spark, config).coalesce(1).write.mode("overwrite").json(path)


def read_config(spark: SparkSession, path: str) -> dict:
    """The configuration as nested dictionaries; one row, whether on one line or spread over many."""
    row = spark.read.schema(LEARNED_CONFIG).option("multiLine", True).json(path).first()
    if row is None:
        raise ValueError(f"no configuration at {path}")
    return row.asDict(recursive=True)


def append_trials(trials: DataFrame, path: str) -> None:
    trials.write.mode("append").partitionBy("study").parquet(path)


def read_trials(spark: SparkSession, path: str, study: str | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows if study is None else rows.where(F.col("study") == study)


def write_hmm(spark: SparkSession, params: HmmParams, path: str, model_id: str = "default") -> None:
    model_frame(spark, params, model_id).write.mode("overwrite").parquet(path)


def read_hmm(spark: SparkSession, path: str, model_id: str = "default") -> HmmParams:
    return load_model(spark.read.parquet(path), model_id)


def write_classifier(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def read_classifier(path: str) -> PipelineModel:
    return PipelineModel.load(path)
