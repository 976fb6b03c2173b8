"""The text operators as one corpus pipeline: quality, near-duplicates, repeated passages, benchmark passages, packing.

Each stage takes all rows that the one before kept and returns the columns of ``documents``; the last one returns the packing
plan of what is left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fileguard.llm.common import read, stored
from fileguard.llm.decontamination import clean
from fileguard.llm.exact_substrings import remove_repeats
from fileguard.llm.near_duplicates import near_duplicates
from fileguard.llm.packing import pack
from fileguard.llm.quality_rules import passed

TOKENIZER = "word_bpe_49k.json"
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that no quality rule rejects, as they are."""
    return passed(docs.select(*COLUMNS))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates (five-word shingles, similarity 0.8)."""
    return near_duplicates(docs, carried=COLUMNS[1:]).where("kept").select(*COLUMNS)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the passages of 100 bytes or more that stand earlier, n_chars counted anew; a document of which
    nothing is left goes."""
    left = remove_repeats(docs, carried=("lang", "source")).where("n_removed < n_bytes or n_bytes = 0")
    return left.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of ``benchmark``."""
    return clean(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, batch and slot of each document that is left, by tokens of ``TOKENIZER``."""
    return pack(docs, tokenizer=TOKENIZER)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("near-duplicates", near_dedup),
    ("repeated substrings", substrings),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL can express neither the confirmed components nor the packing plan in reasonable time; tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what one returns is stored as Parquet in the shared folder and read by the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
