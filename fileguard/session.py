"""Session settings the operators rely on."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Safe to set on a running session: times are epoch-based and must not shift with the local zone.
RUNTIME = {"spark.sql.session.timeZone": "UTC"}

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def configure(spark: SparkSession) -> SparkSession:
    for name, value in RUNTIME.items():
        spark.conf.set(name, value)
    return spark


def local_session(cpus: int | str = "*", memory: str = "12g", partitions: int | None = None) -> SparkSession:
    """A single-machine session for tests and the bench; a cluster brings its own."""
    count = partitions or (os.cpu_count() or 8 if cpus == "*" else int(cpus))
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("fileguard")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(count))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = configure(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``. Only a local session without one gets a folder of its own; on a
    cluster a missing folder is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="fileguard-"))
    return context.getCheckpointDir()


def working_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the checkpoint folder now and go on from there: later readers do not repeat its plan and
    read only the columns and row groups they need."""
    path = working_folder(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def folder_exists(spark: SparkSession, path: str) -> bool:
    """Asked of the file system that ``path`` lies in."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def move_folder(spark: SparkSession, source: str, target: str) -> None:
    """Rename a folder: afterwards it is there whole, before not at all."""
    jvm = spark.sparkContext._jvm
    old, new = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    files = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(new.getParent())
    if not files.rename(old, new):
        raise OSError(f"could not move {source} to {target}")


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside use the state store that keeps several states of an operator."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, STATE_STORE)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
