"""Snapshots on a stream: each file's last state is kept, a poll's mark sweeps the files that it did not hold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from fileguard.operators.snapshots import typed_changes
from fileguard.streaming.packed import STATE, append_rows, held_rows, put_rows

_SIDE = ("local_title", "modified_date", "file_size", "trashed", "full_path")
_TYPES = ("string", "long", "long", "int", "string")
#: A file before (``p_``) and after (``c_``); ``was`` and ``is`` say whether it was and is there.
PAIRS = "drive_id long, snapshot_id long, snapshot_ts double, stable_id long, was boolean, is boolean, " + ", ".join(
    f"{side}_{c} {t}" for side in "pc" for c, t in zip(_SIDE, _TYPES, strict=True)
)
HELD = ["snapshot_id", "stable_id", *_SIDE]


class Files(StatefulProcessor):
    """Some of a drive's files, as the last complete poll had them. Rows wait for the mark of their poll; then the poll is the new
    generation: files that it does not hold are gone. Polls and generations are tables, compared column by column."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", STATE)
        self.files = handle.getListState("files", STATE)
        self.stamp = handle.getValueState("stamp", "snapshot_id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        marks: dict[int, float] = {}
        new = []
        for pdf in rows:
            mark = pdf["mark"].to_numpy(bool)
            for snapshot_id, snapshot_ts in pdf.loc[mark, ["snapshot_id", "snapshot_ts"]].itertuples(index=False, name=None):
                marks.setdefault(int(snapshot_id), snapshot_ts)
            new.append(self._typed(pdf.loc[~mark, HELD]))
        if not marks:
            append_rows(self.held, pd.concat(new, ignore_index=True))
            return
        items = pd.concat([x for x in (held_rows(self.held, nullable=True), *new) if x is not None], ignore_index=True)
        stamp = self.stamp.get()[0] if self.stamp.exists() else None
        polls = sorted(x for x in marks if stamp is None or x > stamp)
        if polls:
            # Generations, from the one in the state on, or else from the first poll.
            files = None if stamp is None else held_rows(self.files, nullable=True)
            stamps = polls if stamp is None else [stamp, *polls]
            place = items["snapshot_id"].map({x: i for i, x in enumerate(stamps) if x != stamp})
            known = items[place.notna()].assign(at=place[place.notna()].astype("int64"))
            if files is not None:
                known = pd.concat([files.assign(at=0), known], ignore_index=True)
            known = known.drop_duplicates(["stable_id", "at"], keep="last").sort_values(["stable_id", "at"], ignore_index=True)
            stamp = polls[-1]
            put_rows(self.files, known.loc[known["at"] == len(stamps) - 1, HELD])
            self.stamp.update((stamp,))
        put_rows(self.held, items[items["snapshot_id"] > stamp])
        if polls:
            found = self._changes(known, len(stamps) - 1)
            if len(found):
                times = found["at"].map({i: marks.get(x) for i, x in enumerate(stamps)})
                found = found.assign(drive_id=key[0], snapshot_id=found["at"].map(dict(enumerate(stamps))), snapshot_ts=times)
                yield found[[part.split()[0] for part in PAIRS.split(", ")]]

    @staticmethod
    def _changes(known: pd.DataFrame, newest: int) -> pd.DataFrame:
        """Files that come, change or go with one of the generations 1 to ``newest``; ``known`` lies by file and generation."""
        file, at = known["stable_id"].to_numpy("int64"), known["at"].to_numpy("int64")
        goes_on = np.r_[(np.diff(file) == 0) & (np.diff(at) == 1), False][: len(at)]
        stayed = np.r_[False, goes_on[:-1]][: len(at)]
        differs = np.zeros(len(at), bool)
        for x in _SIDE:
            old = known[x].shift()
            differs |= known[x].ne(old).fillna(True).to_numpy(bool) & ~(known[x].isna() & old.isna()).to_numpy(bool)
        came, changed, gone = (np.flatnonzero(x) for x in ((at > 0) & ~stayed, stayed & differs, (at < newest) & ~goes_on))
        none = -1  # no row: NULLs
        before = np.r_[np.full(len(came), none), changed - 1, gone]
        after = np.r_[came, changed, np.full(len(gone), none)]
        sides = [known[list(_SIDE)].reindex(i).add_prefix(f"{name}_").reset_index(drop=True) for name, i in (("p", before), ("c", after))]
        about = np.where(after == none, before, after)
        return pd.concat([pd.DataFrame({"stable_id": file[about], "at": at[about] + (after == none), "was": before != none, "is": after != none}), *sides], axis=1)

    @staticmethod
    def _typed(rows: pd.DataFrame) -> pd.DataFrame:
        """Columns of one type, whether a micro-batch has NULLs in them or not."""
        return rows.astype({"snapshot_id": "Int64", "stable_id": "Int64", **{c: "object" if t == "string" else "Int64" for c, t in zip(_SIDE, _TYPES, strict=True)}})

    def close(self) -> None:
        pass


def snapshot_events_stream(snapshots: DataFrame, shards: int = 64) -> DataFrame:
    """Typed events of a stream of snapshots, as ``snapshot_chain`` finds them in a table.

    ``snapshots`` has one row for each drive, poll and file, and one row with a NULL file id for each drive and poll: its mark,
    which follows the poll's rows in the stream (same micro-batch or later) and says that the poll is complete. So a poll may be
    cut anywhere, and one that found a drive empty, with no row but its mark, deletes every file. Polls of a drive are
    marked in rising order; rows and marks of a poll that is already passed are left out. A file listed twice counts once.
    A drive's files are spread over ``shards`` keys; state is one table of files in each, and
    one key's files and waiting polls are what a task holds at a time.
    """
    shard = F.pmod(F.xxhash64("stable_id"), F.lit(shards)).cast("int")
    all_ = F.sequence(F.lit(0), F.lit(shards - 1))
    spread = snapshots.withColumn("shard", F.explode(F.when(F.col("stable_id").isNull(), all_).otherwise(F.array(shard))))
    # Without NULLs a file id stays a whole number on its way.
    told = spread.withColumns({"mark": F.col("stable_id").isNull(), "stable_id": F.coalesce("stable_id", F.lit(0))})
    found = told.groupBy("drive_id", "shard").transformWithStateInPandas(Files(), PAIRS, "append", "None")
    side = lambda there, name: F.when(F.col(there), F.struct(*(F.col(f"{name}_{c}").alias(c) for c in _SIDE))).alias(name)
    keys = ["drive_id", "snapshot_id", "snapshot_ts", "stable_id"]
    return typed_changes(found.select(*keys, side("was", "p"), side("is", "c")), keys)
