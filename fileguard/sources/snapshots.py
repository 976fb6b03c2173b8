"""Snapshot tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

ITEMS = T.StructType(
    [
        T.StructField("drive_id", T.LongType()),
        T.StructField("snapshot_id", T.LongType()),
        T.StructField("snapshot_ts", T.DoubleType()),
        T.StructField("stable_id", T.LongType()),
        T.StructField("local_title", T.StringType()),
        T.StructField("modified_date", T.LongType()),
        T.StructField("file_size", T.LongType()),
        T.StructField("trashed", T.IntegerType()),
        T.StructField("full_path", T.StringType()),
    ]
)


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ITEMS).parquet(path)


def stream_snapshots(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(ITEMS).option("maxFilesPerTrigger", files_per_batch).parquet(path)
