"""Training tables: raw CSV in, prepared Parquet out and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fileguard.schemas import TRAINING_RAW


def read_training_csv(spark: SparkSession, path: str) -> DataFrame:
    """Comma-separated rows with a header. The schema is given, so there is no pass over the file to infer it."""
    return spark.read.csv(path, header=True, schema=TRAINING_RAW, enforceSchema=False)


def write_training(prepared: DataFrame, path: str) -> None:
    prepared.write.mode("overwrite").parquet(path)


def read_training(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The prepared table, or only some of its columns; the scan then reads no others."""
    rows = spark.read.parquet(path)
    return rows.select(*columns) if columns else rows
