"""Attacks on a stream: runs of suspicious events that grow and close.

A drive's time is cut into chunks, dealt over keys. A key holds suspicious events until the watermark has passed them, so that late
rows find their place, and reduces each chunk to its runs. Only the first and last run of what a chunk releases can go on in
another release; they take their files along, all others are complete. The second operator is keyed by drive: it puts the
runs, which come in order of time, one after the other and numbers them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from fileguard.functions.time import behind_watermark, slot, with_event_time
from fileguard.operators.forensics import GAP_SECONDS, is_suspicious
from fileguard.params import MICROS, DecisionParams
from fileguard.streaming.packed import STATE, append_rows, held_rows, put_rows

ATTACKS = (
    "drive_id long, attack_no long, start_us long, end_us long, duration_us long, events long, files long, peak_score double"
)
#: A run; ``names`` are its files where another release may go on with it, else NULL.
RUNS = "drive_id long, release timestamp, lo long, hi long, events long, files long, peak double, names array<string>"
_OPEN = "lo long, hi long, events long, peak double, closed long, stored long, added long"
HELD = ["drive_id", "chunk", "ts_us", "file", "fused"]
CHUNK_SECONDS = 3600


def runs_of(rows: pd.DataFrame, gap_us: int) -> pd.DataFrame:
    """Runs of each drive and chunk in ``rows``: drive_id, lo, hi, events, files, peak, names."""
    rows = rows.sort_values(["drive_id", "chunk", "ts_us"], kind="stable", ignore_index=True)
    drive, chunk, ts = (rows[c].to_numpy(np.int64) for c in ("drive_id", "chunk", "ts_us"))
    new_chunk = np.r_[True, (np.diff(drive) != 0) | (np.diff(chunk) != 0)]
    opens = new_chunk | np.r_[True, np.diff(ts) > gap_us]
    begin, run = np.flatnonzero(opens), np.cumsum(opens) - 1
    last = np.r_[begin[1:], len(ts)] - 1
    code, known = pd.factorize(rows["file"])
    first = ~pd.DataFrame({"run": run, "code": code}).duplicated().to_numpy()
    files = np.bincount(run[first], minlength=len(begin))
    border = new_chunk[begin] | np.r_[new_chunk[begin][1:], True]
    names = np.full(len(begin), None, object)
    kept = first & border[run]
    at = np.searchsorted(run[kept], np.arange(len(begin) + 1))
    named = known[code[kept]].to_numpy(object)
    for i in np.flatnonzero(border):
        names[i] = named[at[i] : at[i + 1]]
    peak = np.fmax.reduceat(rows["fused"].to_numpy(float), begin)
    return pd.DataFrame({"drive_id": drive[begin], "lo": ts[begin], "hi": ts[last], "events": last - begin + 1, "files": files, "peak": peak, "names": names})


class Runs(StatefulProcessor):
    """Holds the suspicious events of some chunks until the watermark has passed them, then reduces them to runs."""

    def __init__(self, gap_us: int):
        self.gap_us = gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", STATE)
        self.done: dict[tuple, int] = {}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            append_rows(self.held, pdf[HELD])
            low = int(pdf["ts_us"].min())
            first = low if first is None else min(first, low)
        self._wake(first)
        return iter(())

    def _wake(self, ts_us: int | None) -> None:
        if ts_us is not None:
            self.handle.registerTimer(-(-ts_us // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # One call releases all that the watermark has passed, whichever timer comes first; the watermark is the same for all keys.
        past = timerValues.getCurrentWatermarkInMs() * 1000
        if self.done.get(key, -1) >= past:
            return
        self.done[key] = past
        held = held_rows(self.held)
        if held is None:
            return
        due = held["ts_us"] <= past
        later = held[~due]
        put_rows(self.held, later)
        self._wake(int(later["ts_us"].min()) if len(later) else None)
        if due.any():
            runs = runs_of(held[due], self.gap_us).assign(release=pd.Timestamp(past, unit="us", tz="UTC"))
            yield runs[[part.split()[0] for part in RUNS.split(", ")]]

    def close(self) -> None:
        pass


class Attacks(StatefulProcessor):
    """A drive's open attack, which the runs of a release go on with or close. State is its numbers and its files."""

    def __init__(self, gap_us: int):
        self.gap_us = gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", _OPEN)
        self.files = handle.getListState("files", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # All runs up to the watermark are here, since all chunks release with it: only the newest attack may still grow.
        runs = pd.concat(list(rows), ignore_index=True).sort_values("lo", kind="stable", ignore_index=True)
        lo0, hi0, events0, peak0, closed, stored, added = tuple(self.open.get()) if self.open.exists() else (None, None, 0, None, 0, 0, 0)
        lo, hi = runs["lo"].to_numpy(np.int64), runs["hi"].to_numpy(np.int64)
        goes_on = hi0 is not None and lo[0] - hi0 <= self.gap_us
        opens = np.r_[not goes_on, lo[1:] - hi[:-1] > self.gap_us]
        begin = np.flatnonzero(np.r_[True, opens[1:]])
        end = np.r_[begin[1:], len(lo)]
        found = pd.DataFrame({
            "lo": lo[begin], "hi": hi[end - 1], "events": np.add.reduceat(runs["events"].to_numpy(np.int64), begin),
            "files": runs["files"].to_numpy(np.int64)[begin], "peak": np.fmax.reduceat(runs["peak"].to_numpy(float), begin),
        })
        names = {i: pd.unique(np.concatenate(runs["names"].iloc[begin[i] : end[i]].tolist())) for i in np.flatnonzero(end - begin > 1)}
        if len(found) - 1 not in names:
            names[len(found) - 1] = np.asarray(runs["names"].iloc[-1], object)
        if goes_on and 0 not in names:
            names[0] = np.asarray(runs["names"].iloc[0], object)
        for i, files in names.items():
            found.loc[i, "files"] = len(files)
        before = None
        if goes_on:
            peak0 = np.nan if peak0 is None else peak0
            for name, value in (("lo", lo0), ("events", events0 + found["events"].iloc[0]), ("peak", np.fmax(peak0, found["peak"].iloc[0]))):
                found.loc[0, name] = value
            if len(found) == 1:
                fresh = pd.DataFrame({"file": names[0]})
                append_rows(self.files, fresh)
                added += len(fresh)
                if added > stored:
                    # The files come again and again; at twice their number they are made distinct.
                    put_rows(self.files, held_rows(self.files).drop_duplicates())
                    stored, added = len(held_rows(self.files)), 0
            else:
                found.loc[0, "files"] = self._distinct(names[0])
        elif hi0 is not None:
            before = pd.DataFrame({"lo": [lo0], "hi": [hi0], "events": [events0], "files": [self._distinct()], "peak": [peak0]})
        if not goes_on or len(found) > 1:
            put_rows(self.files, pd.DataFrame({"file": names[len(found) - 1]}))
            stored, added = len(names[len(found) - 1]), 0
        out = [f for f in (before, found.iloc[:-1]) if f is not None and len(f)]
        ended = self._numbered(key[0], pd.concat(out, ignore_index=True) if out else found.iloc[:0], closed)
        *newest, peak = (found[c].iloc[-1].item() for c in ("lo", "hi", "events", "peak"))
        self.open.update((*newest, None if np.isnan(peak) else peak, closed + len(ended), stored, added))
        self.handle.registerTimer((newest[1] + self.gap_us) // 1000 + 2)
        if len(ended):
            yield ended

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        lo, hi, events, peak, closed, _, _ = tuple(self.open.get())
        # An attack that has grown, or is closed already, has another timer or none.
        if hi is None or (hi + self.gap_us) // 1000 + 2 > timerValues.getCurrentWatermarkInMs():
            return
        ended = pd.DataFrame({"lo": [lo], "hi": [hi], "events": [events], "files": [self._distinct()], "peak": [peak]})
        self.files.clear()
        self.open.update((None, None, 0, None, closed + 1, 0, 0))
        yield self._numbered(key[0], ended, closed)

    def _distinct(self, more=()) -> int:
        """Number of the open attack's files and ``more``."""
        held = held_rows(self.files)
        return len(pd.unique(np.concatenate([held["file"].to_numpy(object), np.asarray(more, object)])))

    @staticmethod
    def _numbered(drive: int, attacks: pd.DataFrame, closed: int) -> pd.DataFrame:
        lo, hi = attacks["lo"].astype("int64"), attacks["hi"].astype("int64")
        return pd.DataFrame({
            "drive_id": drive, "attack_no": closed + 1 + np.arange(len(attacks)), "start_us": lo, "end_us": hi, "duration_us": hi - lo,
            "events": attacks["events"].astype("int64"), "files": attacks["files"].astype("int64"), "peak_score": attacks["peak"].astype(float),
        })

    def close(self) -> None:
        pass


def attacks_stream(
    scored: DataFrame, decision: DecisionParams = DecisionParams(), gap_seconds: int = GAP_SECONDS, delay: str = "10 seconds", shards: int = 64
) -> DataFrame:
    """Attacks of a stream of scored events, each emitted once the watermark is a gap past its end, numbered by drive as the batch
    operator does. Rows may come in any order inside ``delay``; state is the rows that wait for the watermark, by chunks dealt over
    ``shards`` keys, and each drive's open attack with its files."""
    # Every event moves the watermark, suspicious ones are kept.
    timed = with_event_time(scored).withColumn("event_time", F.timestamp_micros("ts_us")).withWatermark("event_time", delay)
    kept = timed.where(behind_watermark(is_suspicious(decision) & F.col("drive_id").isNotNull() & F.col("ts_us").isNotNull())).select(
        "drive_id", "ts_us", "event_time", slot(F.col("ts_us"), CHUNK_SECONDS * MICROS).alias("chunk"),
        F.coalesce(F.col("stable_id").cast("string"), F.lit("")).alias("file"), F.col("fused").cast("double").alias("fused"),
    )
    dealt = kept.withColumn("shard", F.pmod(F.xxhash64("drive_id", "chunk"), F.lit(shards)).cast("int"))
    gap_us = gap_seconds * MICROS
    runs = dealt.groupBy("shard").transformWithStateInPandas(Runs(gap_us), RUNS, "append", "EventTime", eventTimeColumnName="release")
    return runs.groupBy("drive_id").transformWithStateInPandas(Attacks(gap_us), ATTACKS, "append", "EventTime")
