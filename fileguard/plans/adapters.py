"""Inputs derived from the driver's tables: file events, snapshots, labelled features and trials.

The same definitions are used as common table expressions in ``oracles``, so both engines read identical inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fileguard.functions.time import with_event_time
from fileguard.schemas import FEATURES
from fileguard.session import configure


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def file_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_events_from(table(spark, sf_dir, "events"))


def file_events_from(raw: DataFrame) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    b = raw.select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("et"),
        (us.cast("double") / F.lit(1000000.0)).alias("t"),
        (F.col("user_id") % 2).alias("drive_id"),
        (F.col("user_id") * 5 + F.col("event_id") % 5).alias("stable_id"),
    )
    c = b.withColumn("dy", F.floor(F.col("t") / 86400)).withColumn(
        "burst", (F.col("dy") - F.floor(F.col("dy") / 5) * 5) == 0
    )
    kinds = {"click": "MODIFIED", "view": "CREATED", "purchase": "RENAMED", "signup": "TRASHED"}
    kind = F.lit("DELETED")
    for source, target in kinds.items():
        kind = F.when(F.col("et") == source, F.lit(target)).otherwise(kind)
    packed = F.col("dy") * 86400 + (F.col("t") - F.col("dy") * 86400) / F.lit(1200.0)
    suffix = (
        F.when(F.col("burst") & (F.col("drive_id") == 0) & (F.col("et") == "purchase"), ".encrypted")
        .when(F.col("id") % 5 == 0, ".docx")
        .when(F.col("id") % 5 == 1, ".txt")
        .when(F.col("id") % 5 == 2, ".exe")
        .when(F.col("id") % 5 == 3, "")
        .otherwise(".tar.gz")
    )
    folder = (
        F.when(F.col("id") % 3 == 0, "MyProject/SubFolder/")
        .when(F.col("id") % 3 == 1, "Users/AppData/")
        .otherwise("Photos/")
    )
    e = c.select(
        "id",
        F.when(F.col("burst"), packed).otherwise(F.col("t")).alias("timestamp"),
        "drive_id",
        "stable_id",
        kind.alias("event_type"),
        F.concat(F.lit("document_"), F.col("stable_id").cast("string"), suffix).alias("local_title"),
        folder.alias("folder"),
    )
    full = e.withColumn("full_path", F.concat("folder", "local_title")).drop("folder")
    return with_event_time(full)


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Previous and current snapshot, one row per file, from ``part``; the folder name stands for the parent."""
    part = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    parent = F.when(k % 19 == 0, F.lit(None)).otherwise(F.col("p_brand"))
    size = F.when(k % 13 == 0, F.lit(None)).otherwise(F.col("p_size"))

    def shaped(rows: DataFrame, title, modified, file_size, trashed) -> DataFrame:
        return rows.select(
            F.lit(0).cast("bigint").alias("drive_id"),
            k.alias("stable_id"),
            title.alias("local_title"),
            modified.cast("bigint").alias("modified_date"),
            file_size.cast("bigint").alias("file_size"),
            trashed.cast("int").alias("trashed"),
            F.concat_ws("/", parent, title).alias("full_path"),
        )

    docx = F.concat("p_name", F.lit(".docx"))
    current = shaped(
        part.where(k % 23 != 1),
        F.when(k % 7 == 3, F.concat("p_name", F.lit(".encrypted"))).otherwise(docx),
        F.when(k % 5 == 2, 2).otherwise(1),
        size + F.when(k % 11 == 4, 1).otherwise(0),
        F.when(k % 17 == 5, 1).otherwise(0),
    )
    previous = shaped(part.where(k % 29 != 2), docx, F.lit(1), size, F.lit(0))
    return previous, current


def items_and_parents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A raw snapshot from ``lineitem`` (files), ``supplier`` (folders) and their link (parents, sometimes several)."""
    line, supplier = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    files = line.select(
        (F.col("l_orderkey") % 3).cast("bigint").alias("drive_id"),
        key.cast("bigint").alias("stable_id"),
        F.concat(F.lit("file_"), key.cast("string"), F.lit(".docx")).alias("local_title"),
        F.col("l_partkey").cast("bigint").alias("modified_date"),
        F.when(key % 13 != 0, F.col("l_quantity").cast("bigint")).alias("file_size"),
        F.when(key % 17 == 5, 1).otherwise(0).alias("trashed"),
        F.lit(0).alias("is_folder"),
    )
    folders = supplier.select(
        F.explode(F.array(*[F.lit(d).cast("bigint") for d in range(3)])).alias("drive_id"),
        (-1 - F.col("s_suppkey")).cast("bigint").alias("stable_id"),
        F.col("s_name").alias("local_title"),
        F.lit(1).cast("bigint").alias("modified_date"),
        F.lit(None).cast("bigint").alias("file_size"),
        F.lit(0).alias("trashed"),
        F.lit(1).alias("is_folder"),
    )
    links = line.where(key % 19 != 0).select(
        (F.col("l_orderkey") % 3).cast("bigint").alias("drive_id"),
        key.cast("bigint").alias("item_stable_id"),
        F.explode(
            F.when(key % 5 == 0, F.array(-1 - F.col("l_suppkey"), -1 - F.col("l_suppkey") - F.col("l_linenumber")))
            .otherwise(F.array(-1 - F.col("l_suppkey")))
            .cast("array<bigint>")
        ).alias("parent_stable_id"),
    )
    return files.unionByName(folders), links


def snapshot_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve snapshots of the files in ``part``; files come and go, change and are renamed by rule."""
    part = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    s = F.col("snapshot_id")
    return (
        part.withColumn("snapshot_id", F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(1, 13)])))
        .where((k + s) % 7 != 3)
        .select(
            (k % 2).cast("bigint").alias("drive_id"),
            "snapshot_id",
            (s * 5).cast("bigint").alias("snapshot_ts"),
            k.alias("stable_id"),
            F.when((k % 11 == 4) & (s > 6), F.concat("p_name", F.lit(".encrypted")))
            .otherwise(F.concat("p_name", F.lit(".docx")))
            .alias("local_title"),
            F.when(k % 5 == 2, F.floor(s / 4)).otherwise(1).cast("bigint").alias("modified_date"),
            F.when(k % 13 != 0, F.col("p_size")).cast("bigint").alias("file_size"),
            F.when((k % 17 == 5) & (s >= 9), 1).otherwise(0).alias("trashed"),
        )
        .withColumn("full_path", F.col("local_title"))
    )


def labelled_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per labelled document: ``row_id``, ``label`` (= toxic) and the twelve features in order."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    doc = F.col("doc_id")
    joined = d.join(l.select("doc_id", "toxic"), "doc_id")
    values = [
        (doc % 7 == 0).cast("int"),
        (doc % 3 == 0).cast("int"),
        (F.col("lang") == "en").cast("int"),
        F.lit(1),
        F.lit(1),
        (doc % 4 == 0).cast("int"),
        (F.col("lang") == "de").cast("int"),
        F.length("text"),
        F.length("text") - F.length(F.replace(F.col("text"), F.lit(" "), F.lit(""))),
        F.length("source"),
        (doc % 11).cast("double") / F.lit(10.0),
        (F.col("n_chars") % 97).cast("double") / F.lit(20.0) + F.col("toxic").cast("double"),
    ]
    return joined.select(
        doc.alias("row_id"), F.col("toxic").cast("int").alias("label"), *[v.alias(n) for v, n in zip(values, FEATURES)]
    )


def training_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a raw training row; unlabelled documents have a class the encoder does not know."""
    from fileguard.schemas import LABEL_COLUMN, TRAINING_COLUMNS

    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    doc = F.col("doc_id")
    joined = d.join(l.select("doc_id", "toxic"), "doc_id", "left")
    kind = F.when(F.col("toxic") == 1, "ransom").when(F.col("toxic") == 0, "good").otherwise("unknown")
    values = [
        (doc % 7 == 0).cast("int"),
        (doc % 3 == 0).cast("int"),
        (F.col("lang") == "en").cast("int"),
        F.lit(1),
        F.lit(1),
        (doc % 4 == 0).cast("int"),
        (F.col("lang") == "de").cast("int"),
        F.length("text"),
        F.lit(2),
        F.length("source"),
        (doc % 11).cast("double") / F.lit(10.0),
        (F.col("n_chars") % 97).cast("double") / F.lit(20.0),
    ]
    return joined.select(
        doc.alias("row_id"), kind.alias(LABEL_COLUMN), *[v.alias(n) for v, n in zip(values, TRAINING_COLUMNS)]
    )


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("trial"),
        F.col("p_size").cast("double").alias("f1"),
        F.col("p_retailprice").cast("double").alias("f2"),
    )
