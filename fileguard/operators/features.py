"""The twelve features of a file event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fileguard.functions import text
from fileguard.operators.scans import previous_value
from fileguard.params import ScanParams
from fileguard.schemas import FEATURES

# Fixed values.
SUSPICIOUS_WORDS = ("appdata", "temp", "tmp", "programdata", "userprofile")
SCRIPT_SUFFIXES = (".exe", ".bat", ".ps1")
SYSTEM_SUFFIXES = (".exe", ".dll")


def previous_title(events: DataFrame, scan: ScanParams = ScanParams(), base: DataFrame | None = None) -> DataFrame:
    """Add ``previous_title``: the title of the same file's preceding event by id, NULL when none is known.

    The title comes from the event history, not from ``old_local_title``. File id 0 is never remembered.
    """
    title = F.coalesce(F.col("local_title"), F.lit(""))
    out = previous_value(
        events, ["drive_id", "stable_id"], ["id"], "id", title, "previous_title", scan.rows_per_chunk, base=base
    )
    return out.withColumn("previous_title", F.when(F.col("stable_id") != 0, F.col("previous_title")))


def feature_columns(sep: str = "/") -> dict[str, Column]:
    """The feature expressions over an event with ``previous_title``, by name and in model order."""
    title = F.coalesce(F.col("local_title"), F.lit(""))
    path = F.coalesce(F.col("full_path"), F.lit(""))
    kind = F.col("event_type")
    # '' counts as unknown, like NULL. Only renames of a known file reach the comparison.
    known_rename = (kind == "RENAMED") & (F.coalesce(F.col("previous_title"), F.lit("")) != "")
    old_ext = F.when(known_rename, text.extension(F.col("previous_title")))
    new_ext = F.when(known_rename, text.extension(title))
    columns = [
        kind.isin("DELETED", "TRASHED").cast("int"),
        (kind == "CREATED").cast("int"),
        text.ends_with_any(title, SCRIPT_SUFFIXES).cast("int"),
        F.lit(1),
        F.lit(1),
        text.contains_any(path, SUSPICIOUS_WORDS).cast("int"),
        text.ends_with_any(title, SYSTEM_SUFFIXES).cast("int"),
        F.length(path),
        text.separator_count(path, sep),
        F.length(title),
        F.when(known_rename, text.indel_ratio(old_ext, new_ext)).otherwise(F.lit(1.0)),
        text.name_entropy(title),
    ]
    return dict(zip(FEATURES, columns))


def file_features(
    events: DataFrame, sep: str = "/", scan: ScanParams = ScanParams(), base: DataFrame | None = None
) -> DataFrame:
    """Events plus ``previous_title`` and the twelve features."""
    return previous_title(events, scan, base).withColumns(feature_columns(sep))
