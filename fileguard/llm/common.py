"""Shared pieces of the text operators: typed inputs, stored steps, byte arithmetic on Arrow columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that a Python task turns into arrays at once.
PIECE_BYTES = 1 << 20
#: Characters of a text by which rows of one id are put in order before they are dealt out.
HEAD = 256


def documents(df: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` (long) and ``text`` (null becomes empty) of a table of documents, and the columns named in ``more``."""
    return df.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Only a local session without one gets a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="llm-"))
    return spark.sparkContext.getCheckpointDir()


def stored(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """``df`` written as Parquet below the shared folder and read back: later steps start from the files."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> None:
    """Lets the driver notice that shuffle files of finished steps have no reader left, so that Spark deletes them."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def numbered(df: DataFrame) -> DataFrame:
    """``df`` (doc_id, text and others) with ``row``: doc_id itself where it names each row. Otherwise rows with equal doc_id
    and text become one (with the smallest of the other columns) and ``row`` is the place in the order of doc_id (null
    first) and text."""
    clash = df.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null")
    if clash.isEmpty():
        return df.withColumn("row", F.col("doc_id"))
    others = [c for c in df.columns if c not in ("doc_id", "text")]
    distinct = df.groupBy("doc_id", "text").agg(F.min(F.struct(F.lit(0).alias("_"), *others)).alias("others"))
    # Ranges of (doc_id, beginning of the text) are in order and split an id that many rows share; each is numbered by itself,
    # and the ranges before it are counted.
    head = F.substring("text", F.lit(1), F.lit(HEAD))
    ranged = distinct.repartitionByRange(F.col("doc_id").asc_nulls_first(), head).withColumn("range", F.spark_partition_id())
    ranged = stored(ranged, "numbered-ranges")
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(F.col("doc_id").asc_nulls_first(), "text")) - 1
    rows = ranged.withColumn("place", place).join(F.broadcast(before), "range")
    flat = rows.select("doc_id", "text", *(f"others.{c}" for c in others), (F.col("place") + F.col("before")).cast("long").alias("row"))
    return stored(flat.select(*df.columns, "row"), "numbered")


def buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column one after the other, and the offsets (n + 1) of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.large_binary()
    column = column.cast(wide) if column.type != wide else column
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, text: str = "text", size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``size`` bytes of text; a longer row is a slice by itself."""
    _, offsets = buffer(batch.column(text))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + size, side="right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def record(schema: str, **columns: Iterable) -> pa.RecordBatch:
    """A batch with the columns in the order of a DDL schema."""
    names = [part.split()[0] for part in schema.split(",")]
    return pa.RecordBatch.from_arrays([c if isinstance(c := columns[n], pa.Array) else pa.array(c) for n in names], names=names)


MIX = np.uint64(0xBF58476D1CE4E5B9)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * MIX
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASES[0]) -> np.ndarray:
    """A 64-bit hash of each span [start, end) of ``raw``; equal bytes have equal hashes wherever they stand.

    The powers are made anew each time: what a task keeps in a module's globals stays in its worker until the garbage of
    cycles is collected, since functions are shipped by value.
    """
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(base, len(raw)), out=sums[1:])
    values = sums[ends] - sums[starts]
    del sums
    values *= powers(pow(base, -1, 1 << 64), len(raw) + 1)[starts]
    return mixed(values + (ends - starts).astype(np.uint64))


def powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of an odd number modulo 2^64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, out=out)


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word (bytes other than space and 9 to 13) and the first word of each row (n + 1 numbers)."""
    blank = np.ones(len(raw) + 2, bool)
    blank[1:-1] = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    starts, ends = edges[::2], edges[1::2]
    # A word does not go on into the next row.
    cuts = np.unique(offsets[1:-1])
    inside = np.searchsorted(starts, cuts, side="left") - 1
    crossing = (inside >= 0) & (ends[np.maximum(inside, 0)] > cuts) & (starts[np.maximum(inside, 0)] < cuts) if len(starts) else np.zeros(len(cuts), bool)
    if crossing.any():
        at = cuts[crossing]
        starts, ends = np.sort(np.r_[starts, at]), np.sort(np.r_[ends, at])
    return starts, ends, np.searchsorted(starts, offsets, side="left")


def lowered(raw: np.ndarray) -> np.ndarray:
    """A-Z to a-z, other bytes as they are."""
    return np.where((raw >= 65) & (raw <= 90), raw | 32, raw).astype(np.uint8)

