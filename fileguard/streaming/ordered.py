"""Event-time ordering and per-file history of a stream of file events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from fileguard.functions.time import behind_watermark, with_event_time
from fileguard.params import MICROS
from fileguard.schemas import FILE_EVENTS
from fileguard.sources.events import missing_column

KEYS = ["drive_id", "stable_id"]
_REST = [f for f in FILE_EVENTS.fields if f.name not in KEYS] + [T.StructField("ts_us", T.LongType())]
_HELD = T.StructType([T.StructField(f.name, f.dataType) for f in _REST])
_TITLE = T.StructType([T.StructField("title", T.StringType())])
ORDERED_EVENTS = T.StructType(
    [T.StructField(k, T.LongType()) for k in KEYS]
    + list(_HELD.fields)
    + [T.StructField("previous_title", T.StringType())]
)


class FileHistory(StatefulProcessor):
    """Holds a file's events until their poll interval is past the watermark, then releases them in id order, each with
    the title before it. Two files never share a key, so a busy drive spreads over all tasks."""

    def __init__(self, poll_us: int, title_ttl_ms: int | None):
        self.poll_us, self.title_ttl_ms = poll_us, title_ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", _HELD)
        self.title = handle.getValueState("title", _TITLE, self.title_ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            self.held.appendList([_plain(row) for row in pdf[[f.name for f in _HELD]].itertuples(index=False, name=None)])
            for slot in (pdf["ts_us"] // self.poll_us).unique():
                self.handle.registerTimer((int(slot) + 1) * self.poll_us // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        past = expiredTimerInfo.getExpiryTimeInMs() * 1000
        names = [f.name for f in _HELD]
        held = [tuple(row) for row in self.held.get()]
        at = names.index("ts_us")
        due = sorted((row for row in held if row[at] < past), key=lambda row: row[0])
        if not due:
            return
        later = [row for row in held if row[at] >= past]
        if later:
            self.held.put(later)
        else:
            self.held.clear()
        before = self.title.get()[0] if self.title.exists() else None
        out = []
        for row in due:
            known = before if key[1] != 0 else None
            out.append((*key, *row, known))
            before = row[names.index("local_title")] or ""
        self.title.update((before,))
        yield pd.DataFrame(out, columns=ORDERED_EVENTS.fieldNames()).astype({"file_size": "Int64"})

    def close(self) -> None:
        pass


def _plain(row: tuple) -> tuple:
    """Column values as plain Python objects, NULL as None."""
    return tuple(None if pd.isna(v) else v.item() if hasattr(v, "item") else v for v in row)


def ordered_events(
    events: DataFrame, delay: str = "10 seconds", poll_seconds: int = 3, title_ttl_ms: int | None = None
) -> DataFrame:
    """Released events with ``previous_title``. Events later than ``delay`` behind the newest one are dropped.

    ``title_ttl_ms`` forgets files that stay silent that long, which bounds the state.
    """
    timed = with_event_time(events).withColumn("event_time", F.timestamp_micros("ts_us"))
    marked = timed.withWatermark("event_time", delay).where(behind_watermark(missing_column().isNull()))
    return marked.groupBy(*KEYS).transformWithStateInPandas(
        FileHistory(poll_seconds * MICROS, title_ttl_ms), ORDERED_EVENTS, "append", "EventTime"
    )


def late_rows(query) -> int:
    """Rows the watermark has dropped so far in this query's reported progress."""
    return sum(
        int(op.get("numRowsDroppedByWatermark", 0))
        for progress in query.recentProgress
        for op in progress["stateOperators"]
    )
