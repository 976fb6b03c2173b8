"""Trailing-window measures on a stream, from keyed state.

A drive's time is cut into chunks, and an event is told to its own chunk and, where the window reaches over the border, to the
next one as look-back. So a chunk answers for its events alone, and a busy drive, or a long replay of one, is spread over
its chunks. Chunks are dealt over ``shards`` keys: a key settles all of its chunks in one pass over their rows. It holds events until
their poll interval lies behind the watermark, answers them, and keeps what later events of the chunk can still see.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from fileguard.functions import text
from fileguard.functions.time import behind_watermark, slot, with_event_time
from fileguard.operators.detectors import flag_columns
from fileguard.params import EngineParams
from fileguard.sources.events import missing_column
from fileguard.streaming.packed import STATE, append_rows, held_rows, put_rows

MEASURES = ("recent_writes", "recent_renames", "rename_extensions", "recent_files")
KEYS = ["shard"]
#: ``own`` is whether the chunk still has to answer the event; ``token`` is that of a rename, else NULL.
HELD = ["drive_id", "chunk", "own", "t", "id", "writes", "renames", "file", "token"]
MEASURED = "drive_id long, id long, ts_us long, " + ", ".join(f"{m} long" for m in MEASURES)


def mentions(events: DataFrame, params: EngineParams, shards: int) -> DataFrame:
    """One row for each chunk that has to know of an event."""
    rename = F.coalesce(F.col("event_type") == "RENAMED", F.lit(False))
    write = F.coalesce(F.col("event_type").isin(*params.detector.write_types), F.lit(False))
    token = text.last_token(F.coalesce(F.col("local_title"), F.lit("")))
    # Like the batch operator: events without a file share one.
    file = F.coalesce(F.col("stable_id").cast("string"), F.lit(""))
    first, last = slot(F.col("ts_us"), params.scan.chunk_us), slot(F.col("ts_us") + params.detector.window_us, params.scan.chunk_us)
    told = events.select(
        "drive_id", "event_time", F.col("ts_us").alias("t"), "id", write.cast("long").alias("writes"), rename.cast("long").alias("renames"),
        file.alias("file"), F.when(rename, token).alias("token"), first.alias("first"), F.explode(F.sequence(first, last)).alias("chunk"),
    )
    shard = F.pmod(F.xxhash64("drive_id", "chunk"), F.lit(shards)).cast("int")
    return told.withColumns({"own": F.col("chunk") == F.col("first"), "shard": shard}).select(*KEYS, "event_time", *HELD)


def trailing_measures(rows: pd.DataFrame, window_us: int, chunk_us: int) -> pd.DataFrame:
    """``rows`` (any number of chunks) by chunk and time, with the measures of the closed window that ends at each row."""
    group = rows.groupby(["drive_id", "chunk"], sort=False).ngroup().to_numpy(np.int64)
    # Places on one line: chunks lie so far apart that no window, and no value that leaves one, reaches the next chunk.
    place = group * (chunk_us + 2 * window_us + 2) + (rows["t"] - rows["chunk"] * chunk_us + window_us).to_numpy(np.int64)
    order = np.argsort(place, kind="stable")
    rows, place = rows.iloc[order], place[order]
    begin, end = np.searchsorted(place, place - window_us, "left"), np.searchsorted(place, place, "right")

    def counted(name: str) -> np.ndarray:
        total = np.r_[0, np.cumsum(rows[name].to_numpy(np.int64))]
        return total[end] - total[begin]

    def distinct(name: str) -> np.ndarray:
        """A value's stretch begins where it was not seen for a window and ends a window after its last row."""
        codes = pd.factorize(rows[name])[0]
        known = np.flatnonzero(codes >= 0)
        at, value = place[known], codes[known]
        along = np.lexsort((at, value))
        at, value = at[along], value[along]
        opens = np.r_[True, (np.diff(value) != 0) | (np.diff(at) > window_us)][: len(at)]
        comes, leaves = np.sort(at[opens]), np.sort(at[np.r_[opens[1:], True][: len(at)]]) + window_us
        return np.searchsorted(comes, place, "right") - np.searchsorted(leaves, place, "left")

    return rows.assign(**dict(zip(MEASURES, (counted("writes"), counted("renames"), distinct("token"), distinct("file")), strict=True)))


class Windows(StatefulProcessor):
    """Holds the events of some chunks until their poll interval is released, then answers them."""

    def __init__(self, poll_us: int, window_us: int, chunk_us: int):
        self.poll_us, self.window_us, self.chunk_us = poll_us, window_us, chunk_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", STATE)
        self.done: dict[tuple, int] = {}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            append_rows(self.held, pdf[HELD])
            low = int(pdf["t"].min())
            first = low if first is None else min(first, low)
        self._wake(first)
        return iter(())

    def _wake(self, t: int | None) -> None:
        """A timer at the end of the poll interval that holds ``t``."""
        if t is not None:
            self.handle.registerTimer((t // self.poll_us + 1) * self.poll_us // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # One call settles all intervals behind the watermark, whichever timer comes first.
        past = timerValues.getCurrentWatermarkInMs() * 1000 // self.poll_us * self.poll_us
        if self.done.get(key, -1) >= past:
            return
        self.done[key] = past
        held = held_rows(self.held)
        if held is None:
            return
        due = held["t"] < past
        # Later events are not before ``past`` and not behind the end of their chunk.
        seen = due & (held["t"] >= past - self.window_us) & ((held["chunk"] + 1) * self.chunk_us > past)
        later = held[~due]
        put_rows(self.held, pd.concat([held[seen].assign(own=False), later]))
        leaves = [int(held.loc[seen, "t"].min()) + self.window_us] if seen.any() else []
        self._wake(min(([int(later["t"].min())] if len(later) else []) + leaves, default=None))
        now = held[due]
        if now["own"].any():
            out = trailing_measures(now, self.window_us, self.chunk_us)
            yield out[out["own"]].rename(columns={"t": "ts_us"})[["drive_id", "id", "ts_us", *MEASURES]].astype("int64")

    def close(self) -> None:
        pass


def window_measures_stream(events: DataFrame, params: EngineParams = EngineParams(), delay: str = "10 seconds", shards: int = 64) -> DataFrame:
    """(drive_id, id, ts_us, recent_writes, recent_renames, rename_extensions, recent_files) of every event of a stream, once its
    poll interval lies behind the watermark. Equal to the batch operator for any cut into micro-batches and after a restart.

    Events without id, time or drive are left out, and so are those the watermark has passed (see ``streaming.intake``). State
    holds a window's events; timers need a state store that keeps several states of an operator (RocksDB).
    """
    timed = with_event_time(events).withColumn("event_time", F.timestamp_micros("ts_us")).withWatermark("event_time", delay)
    told = mentions(timed.where(behind_watermark(missing_column().isNull())), params, shards)
    windows = Windows(params.decision.poll_us, params.detector.window_us, params.scan.chunk_us)
    return told.groupBy(*KEYS).transformWithStateInPandas(windows, MEASURED, "append", "EventTime")


def flags_stream(events: DataFrame, params: EngineParams = EngineParams(), delay: str = "10 seconds", shards: int = 64) -> DataFrame:
    """``window_measures_stream`` with both flags."""
    return window_measures_stream(events, params, delay, shards).withColumns(flag_columns(params.detector))
