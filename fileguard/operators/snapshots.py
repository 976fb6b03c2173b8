"""Metadata snapshots: one row per file, paths, and the typed events between snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fileguard.functions.text import join_path
from fileguard.operators.scans import running_totals

_ATTRIBUTES = ["local_title", "modified_date", "file_size", "trashed"]


def snapshot_files(items: DataFrame, parents: DataFrame) -> DataFrame:
    """Files (folders removed), one row per file and parent, NULL parent when there is none."""
    files = items.where("is_folder = 0").select("drive_id", "stable_id", *_ATTRIBUTES)
    links = parents.select("drive_id", F.col("item_stable_id").alias("stable_id"), "parent_stable_id")
    return files.join(links, ["drive_id", "stable_id"], "left")


def dedupe_parents(files: DataFrame) -> DataFrame:
    """One row per file: first non-NULL value of every attribute and first parent, "first" by parent then value."""
    order = F.col("parent_stable_id")
    return files.groupBy("drive_id", "stable_id").agg(
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(order, F.col(c)))).alias(c) for c in _ATTRIBUTES],
        F.min("parent_stable_id").alias("parent_stable_id"),
    )


def snapshot_paths(files: DataFrame, folders: DataFrame, sep: str = "/") -> DataFrame:
    """Add ``full_path``: parent folder's name and title, or the bare title when the parent is missing.

    Folders are not assumed small: a store can hold as many folders as files, so the join strategy is left to the
    optimizer's size estimate instead of a broadcast hint.
    """
    names = folders.select(
        "drive_id", F.col("stable_id").alias("parent_stable_id"), F.col("local_title").alias("_folder")
    )
    named = files.join(names, ["drive_id", "parent_stable_id"], "left")
    path = join_path(F.col("_folder"), F.coalesce(F.col("local_title"), F.lit("")), sep)
    return named.withColumn("full_path", path).select(*files.columns, "full_path")


def folders_of(items: DataFrame) -> DataFrame:
    return items.where("is_folder = 1").select("drive_id", "stable_id", "local_title")


def snapshot_table(items: DataFrame, parents: DataFrame, sep: str = "/") -> DataFrame:
    """One snapshot, ready to be compared: one row per file with its path."""
    return snapshot_paths(dedupe_parents(snapshot_files(items, parents)), folders_of(items), sep)


def _change(old: dict[str, Column], new: dict[str, Column]) -> Column:
    """Event type of a file present in both snapshots; a rename hides a change, a change hides a trashing."""

    def differs(c: str) -> Column:
        return ~old[c].eqNullSafe(new[c])

    return (
        F.when(differs("local_title"), F.lit("RENAMED"))
        .when(differs("modified_date") | differs("file_size"), F.lit("MODIFIED"))
        .when((old["trashed"] == 0) & (new["trashed"] == 1), F.lit("TRASHED"))
    )


def snapshot_diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Typed events between two snapshots (one row per file each), at most one per file, unchanged files omitted."""
    keys = ["drive_id", "stable_id"]
    cols = [*_ATTRIBUTES, "full_path"]
    p = previous.select(*keys, F.struct(*cols).alias("p"))
    c = current.select(*keys, F.struct(*cols).alias("c"))
    both = p.join(c, keys, "full_outer")
    return typed_changes(both, keys)


def typed_changes(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and the event columns of files before (``p``) and after (``c``), either of them NULL; unchanged files omitted."""
    cols = [*_ATTRIBUTES, "full_path"]
    kind = (
        F.when(F.col("p").isNull(), F.lit("CREATED"))
        .when(F.col("c").isNull(), F.lit("DELETED"))
        .otherwise(_change({x: F.col(f"p.{x}") for x in cols}, {x: F.col(f"c.{x}") for x in cols}))
    )
    return pairs.withColumn("event_type", kind).where("event_type is not null").select(*keys, *_event_columns())


def _event_columns() -> list[Column]:
    kind = F.col("event_type")
    sized = kind.isin("CREATED", "MODIFIED")
    return [
        kind,
        F.coalesce("c.local_title", "p.local_title").alias("local_title"),
        F.when(sized, F.coalesce("c.file_size", F.lit(0))).otherwise(0).cast("bigint").alias("file_size"),
        F.when(kind == "RENAMED", F.col("p.local_title")).otherwise("").alias("old_local_title"),
        F.coalesce("c.full_path", "p.full_path").alias("full_path"),
    ]


def id_sets(previous: DataFrame, current: DataFrame) -> DataFrame:
    """File ids only in the current snapshot, only in the previous one, or in both."""
    keys = ["drive_id", "stable_id"]
    p = previous.select(*keys).distinct().withColumn("_p", F.lit(True))
    c = current.select(*keys).distinct().withColumn("_c", F.lit(True))
    side = F.when(F.col("_p").isNull(), "created").when(F.col("_c").isNull(), "deleted").otherwise("common")
    return p.join(c, keys, "full_outer").select(*keys, side.alias("side"))


def snapshot_chain(snapshots: DataFrame, polls: DataFrame | None = None) -> DataFrame:
    """Typed events along a chain of snapshots (one row per drive, snapshot and file).

    Each drive's snapshots are numbered; a file absent from the next number was deleted there and created where it
    returns. A file has one row per snapshot, so its group is bounded by the number of snapshots. A drive's first
    snapshot yields no events. ``polls`` (drive_id, snapshot_id, snapshot_ts) lists snapshots that were taken, one small
    row each; only it can tell that a poll found a drive empty, so that every file is gone.
    """
    keys = ["drive_id", "stable_id"]
    cols = [*_ATTRIBUTES, "full_path"]
    along = Window.partitionBy("drive_id").orderBy("snapshot_id")
    taken = snapshots.select("drive_id", "snapshot_id", "snapshot_ts")
    if polls is not None:
        taken = taken.unionByName(polls.select("drive_id", "snapshot_id", "snapshot_ts"))
    polls = (
        taken.distinct()
        .withColumn("seq", F.row_number().over(along))
        .withColumn("next_id", F.lead("snapshot_id").over(along))
        .withColumn("next_ts", F.lead("snapshot_ts").over(along))
    )
    per_file = Window.partitionBy(*keys).orderBy("seq")
    seen = (
        snapshots.select(*keys, "snapshot_id", F.struct(*cols).alias("c"))
        .join(polls, ["drive_id", "snapshot_id"])
        .withColumns(
            {
                "p": F.lag("c").over(per_file),
                "p_seq": F.lag("seq").over(per_file),
                "n_seq": F.lead("seq").over(per_file),
            }
        )
    )
    adjacent = F.col("p_seq") == F.col("seq") - 1
    arrival = F.when(
        adjacent, _change({x: F.col(f"p.{x}") for x in cols}, {x: F.col(f"c.{x}") for x in cols})
    ).when(F.col("seq") > 1, F.lit("CREATED"))
    gone = F.col("next_id").isNotNull() & (F.coalesce(F.col("n_seq"), F.lit(0)) != F.col("seq") + 1)
    none = F.lit(None).cast(seen.schema["c"].dataType)
    event = lambda sid, ts, kind, p, c: F.struct(
        sid.alias("snapshot_id"), ts.alias("snapshot_ts"), kind.alias("event_type"), p.alias("p"), c.alias("c")
    )
    both = F.array(
        event(F.col("snapshot_id"), F.col("snapshot_ts"), arrival, F.when(adjacent, F.col("p")), F.col("c")),
        event(F.col("next_id"), F.col("next_ts"), F.when(gone, F.lit("DELETED")), F.col("c"), none),
    )
    return (
        seen.select(*keys, F.explode(both).alias("e"))
        .select(*keys, "e.*")
        .where("event_type is not null")
        .select("drive_id", "snapshot_id", "snapshot_ts", "stable_id", *_event_columns())
    )


def as_file_events(
    diff: DataFrame, timestamp: Column, first_id: Column, ids_per_chunk: int = 1_000_000
) -> DataFrame:
    """Give the diff rows of one poll their time and arrival ids: ``first_id`` onwards per drive, in file-id order.

    A drive is numbered in chunks of ``ids_per_chunk`` file ids, so a drive with most of the changes is not one task.
    """
    numbered = diff.withColumns(
        {
            "_n": F.lit(1).cast("bigint"),
            "_chunk": F.floor(F.col("stable_id") / F.lit(ids_per_chunk)).cast("bigint"),
        }
    )
    return running_totals(numbered, "drive_id", ["stable_id"], ["_n"]).select(
        (first_id + F.col("_n") - 1).cast("bigint").alias("id"),
        timestamp.cast("double").alias("timestamp"),
        *diff.columns,
    )
