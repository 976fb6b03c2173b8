"""Keyed-state streams against the batch operators, for cuts anywhere, restarts, crashes and quiet streams."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fileguard.operators.detectors import detector_flags
from fileguard.operators.forensics import attack_events, attack_sessions
from fileguard.operators.snapshots import snapshot_chain
from fileguard.params import DetectorParams, EngineParams
from fileguard.schemas import ALERT_LOG, FILE_EVENTS
from fileguard.sources import alerts as alert_source
from fileguard.sources.snapshots import ITEMS
from fileguard.streaming import intake
from fileguard.streaming.attacks import Attacks, Runs, attacks_stream, runs_of
from fileguard.streaming.packed import held_rows
from fileguard.streaming.snapshots import _SIDE, Files, snapshot_events_stream
from fileguard.streaming.windows import KEYS, MEASURES, Windows, flags_stream, mentions
from tests.test_streaming import make_events, sentinel

#: File events as they arrive: any column may be NULL.
ARRIVING = T.StructType([T.StructField(f.name, f.dataType) for f in FILE_EVENTS.fields])
PARAMS = EngineParams(detector=DetectorParams(window_seconds=3, velocity_threshold=3, rename_threshold=1))


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def written(rows, folder, trigger=None):
    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch_id={batch_id}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/query").trigger(**(trigger or {"availableNow": True})).start()


def done(query):
    query.awaitTermination(300)
    assert query.exception() is None


@pytest.mark.parametrize("cuts, shards", [((40, 41, 130), 3), ((90,), 1)])
def test_flags_equal_batch_for_any_cut(spark, tmp_path, cuts, shards):
    pdf = make_events(200)
    pdf.loc[pdf["id"] % 31 == 0, "local_title"] = None
    # Some events share their time, some have no file.
    pdf.loc[pdf["id"] % 10 == 0, "timestamp"] = pdf["timestamp"].shift(1)
    table = spark.createDataFrame([tuple(None if pd.isna(v) else v for v in r) for r in pdf.itertuples(index=False)], ARRIVING).withColumn("stable_id", F.expr("case when id % 13 <> 0 then stable_id end"))
    columns = ["drive_id", "id", "ts_us", *MEASURES, "high_velocity", "systematic_rename"]
    want = rows_of(detector_flags(table, PARAMS.detector), *columns)
    assert {r[-1] for r in want} == {r[-2] for r in want} == {True, False}
    end = spark.createDataFrame(sentinel(pdf, 1000), FILE_EVENTS)
    lacking = spark.createDataFrame([(900, None, 0, 1, "CREATED", "x", 1, "", "x"), (901, 1.7e9, None, 1, "CREATED", "x", 1, "", "x")], ARRIVING)
    edges = [0, *cuts, 201]
    for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        part = table.where(f"id > {a} and id <= {b}").orderBy(F.rand(i))
        part = part.unionByName(lacking) if i == 0 else part
        part = part.unionByName(end) if b == 201 else part
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        stream = spark.readStream.schema(FILE_EVENTS).parquet(f"{tmp_path}/in/*")
        done(written(flags_stream(stream, PARAMS, "10 seconds", shards), tmp_path))
    got = spark.read.parquet(f"{tmp_path}/out").where("drive_id < 99")
    assert rows_of(got, *columns) == want


def test_late_row_joins_two_attacks(spark, tmp_path):
    base, s = 1_700_000_000_000_000, 1_000_000
    schema = "id long, drive_id long, ts_us long, stable_id long, fused double, malicious boolean"
    # Two runs 100 s apart; a row between them comes in the next part. A quiet third run follows.
    parts = [
        [(1, 0, base, 1, 0.9, False), (2, 0, base + 100 * s, 2, 0.6, None), (3, 1, base, 1, 0.2, True), (4, 0, base + 105 * s, None, 0.7, False)],
        [(5, 0, base + 50 * s, 1, 0.95, False), (6, 0, base + 51 * s, 9, 0.1, False)],
        [(7, 0, base + 300 * s, 3, 0.8, False), (8, 1, base + 60 * s + 1, 2, 0.9, False)],
        [(9, 99, base + 10_000 * s, 1, 0.0, False)],
    ]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
        done(written(attacks_stream(stream, delay="200 seconds"), tmp_path))
    got = spark.read.parquet(f"{tmp_path}/out")
    scored = spark.createDataFrame([r for p in parts for r in p], schema)
    columns = ["drive_id", "attack_no", "start_us", "end_us", "duration_us", "events", "files", "peak_score"]
    assert rows_of(got, *columns) == rows_of(attack_sessions(attack_events(scored)), *columns)
    assert got.where("drive_id = 0 and attack_no = 1").first()["events"] == 4 and got.count() == 4


def test_gate_keeps_and_counts_late_rows_through_a_crash(spark, tmp_path, monkeypatch):
    pdf = make_events(120)
    late = pdf.iloc[:3].assign(id=[900, 901, 902])
    parts = [pdf.iloc[:60], pd.concat([pdf.iloc[60:], late]), pdf.iloc[:1].assign(id=[903], timestamp=[None])]
    folder, move = f"{tmp_path}/gate", intake.move_folder
    for i, part in enumerate(parts):
        spark.createDataFrame([tuple(None if pd.isna(v) else v for v in r) for r in part.itertuples(index=False)], ARRIVING).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        stream = spark.readStream.schema(FILE_EVENTS).parquet(f"{tmp_path}/in/*")
        start = lambda stream=stream: intake.gate_stream(stream, folder, f"{tmp_path}/query", 10, {"availableNow": True})
        if i == 1:
            # Cut off after the rows are in place and before their mark.
            def broken(session, source, target):
                move(session, source, target)
                raise RuntimeError("lost")

            monkeypatch.setattr(intake, "move_folder", broken)
            with pytest.raises(Exception, match="lost"):
                start().awaitTermination(120)
            monkeypatch.setattr(intake, "move_folder", move)
        done(start())
    assert rows_of(intake.late_events(spark, folder), "id", "batch_id") == [(900, 1), (901, 1), (902, 1)]
    assert rows_of(intake.rejected_rows(spark, folder), "id") == [(903,)]
    counts = intake.gate_counts(spark, folder).first()
    assert (counts["on_time"], counts["late"], counts["rejected"]) == (120, 3, 1)
    # What is on time passes a watermark of the same delay.
    gated = intake.gated_events(spark, folder, 1)
    end = spark.createDataFrame(sentinel(pdf, 1000), FILE_EVENTS).withColumn("ts_us", (F.col("timestamp") * 1_000_000).cast("long"))
    end.withColumn("gate", F.lit("on_time")).coalesce(1).write.partitionBy("gate").parquet(f"{folder}/rows/batch_id=3")
    done(written(flags_stream(gated, PARAMS, "10 seconds", 2), f"{tmp_path}/flags"))
    got = spark.read.parquet(f"{tmp_path}/flags/out").where("drive_id < 99")
    assert got.count() == 120


def test_quiet_stream_decides_within_a_poll_and_the_delay(spark, tmp_path):
    """Four events at the time of the clock, then nothing more: a pulse moves the watermark."""
    schema = FILE_EVENTS
    now = time.time()
    rows = [(i + 1, now + i * 0.01, 0, i, "RENAMED", f"a{i}.x", 1, "", f"a{i}.x") for i in range(4)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/0")
    stream = intake.with_pulse(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*"))
    query = written(flags_stream(stream, PARAMS, "30 seconds", 1), tmp_path, {"processingTime": "1 second"})
    decided = None
    try:
        while time.time() < now + 200 and decided is None:
            time.sleep(0.5)
            assert query.exception() is None
            out = sorted((tmp_path / "out").glob("*/*.parquet")) if (tmp_path / "out").exists() else []
            if any(pd.read_parquet(f).shape[0] for f in out):
                decided = time.time()
    finally:
        query.stop()
    assert decided is not None
    got = pd.concat([pd.read_parquet(f) for f in sorted((tmp_path / "out").glob("*/*.parquet"))])
    assert sorted(got["id"]) == [1, 2, 3, 4] and got["recent_renames"].max() == 4
    # A delay, a poll of 3 s, and the micro-batches in between, which are slow here.
    assert decided - now < 30 + PARAMS.decision.poll_seconds + 60
    print(f"decided after {decided - now:.1f} s at a delay of 30 s")


def test_snapshots_cut_anywhere(spark, tmp_path):
    def poll(sid, titles, drive=0):
        return [(drive, sid, float(sid), k, v, 1, None if k == 2 else 1, int(v == "gone"), v) for k, v in titles.items()]

    def mark(sid, drive=0):
        return [(drive, sid, float(sid), None, None, None, None, None, None)]

    first, second, fourth = poll(1, {1: "a", 2: "b", 7: "z"}), poll(2, {1: "a.enc", 3: "c", 7: "z"}), poll(4, {1: "a", 2: "b"})
    parts = [
        first[:1],  # a poll that comes in pieces
        [*first[1:], *mark(1), *second[:2], *poll(1, {5: "q"}, 1)],
        [*mark(1, 1), *second[2:], *mark(2), *mark(3)],  # the third poll finds nothing
        [*fourth, *fourth[:1], *mark(4), *mark(2, 1), *second],  # a row twice; rows of a poll that has passed
    ]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, ITEMS).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        stream = spark.readStream.schema(ITEMS).parquet(f"{tmp_path}/in/*")
        done(written(snapshot_events_stream(stream, 3), tmp_path))
    items = spark.createDataFrame([*first, *second, *fourth, *poll(1, {5: "q"}, 1)], ITEMS)
    polls = spark.createDataFrame([(0, i, float(i)) for i in range(1, 5)] + [(1, 1, 1.0), (1, 2, 2.0)], "drive_id long, snapshot_id long, snapshot_ts double")
    want = snapshot_chain(items, polls)
    got = spark.read.parquet(f"{tmp_path}/out").drop("batch_id")
    assert rows_of(got, *want.columns) == rows_of(want, *want.columns)
    assert got.where("event_type = 'DELETED'").count() == 5


def test_alert_log_neither_loses_nor_doubles(spark, tmp_path):
    plain = T._parse_datatype_string("drive_id long, timestamp string, threat_level string, probability double, affected_files_count long, sync_paused boolean")
    schema = T.StructType([*plain.fields, T.StructField("triggering_event", ALERT_LOG["triggering_event"].dataType)])

    def found(*ids):
        return spark.createDataFrame([(i % 2, f"t{i}", "HIGH", 0.8, i, False, None) for i in ids], schema)

    def log():
        return rows_of(alert_source.read_alerts_once(spark, path), "drive_id", "batch_id", "timestamp")

    path = f"{tmp_path}/log"
    assert log() == []
    alert_source.write_attempt(found(1, 2), path, 0)
    assert log() == []
    alert_source.append_alerts_once(found(1, 2), path, 0)
    alert_source.append_alerts_once(found(1, 2), path, 0)
    assert log() == [(0, 0, "t2"), (1, 0, "t1")]
    # One drive's mark is there, the other's is not; two attempts of one micro-batch are both marked.
    alert_source.commit_attempt(spark, path, 1, alert_source.write_attempt(found(4), path, 1))
    alert_source.append_alerts_once(found(3, 4), path, 1)
    both = [alert_source.write_attempt(found(5), path, 2) for _ in range(2)]
    for attempt in both:
        alert_source.commit_attempt(spark, path, 2, attempt)
    alert_source.append_alerts_once(found(), path, 3)
    assert log() == [(0, 0, "t2"), (0, 1, "t4"), (1, 0, "t1"), (1, 1, "t3"), (1, 2, "t5")]


class State:
    """A value or list state in memory that counts the elements given to it."""

    def __init__(self):
        self.rows, self.given = [], 0

    def exists(self):
        return bool(self.rows)

    def get(self):
        return self.rows[0] if self.single else iter(list(self.rows))

    def put(self, rows):
        self.rows, self.given = list(rows), self.given + len(rows)

    def appendList(self, rows):
        self.rows, self.given = self.rows + list(rows), self.given + len(rows)

    def update(self, row):
        self.rows = [row]

    def clear(self):
        self.rows = []


class Handle:
    def __init__(self):
        self.states, self.timers = {}, set()

    def _state(self, name, single):
        found = self.states.setdefault(name, State())
        found.single = single
        return found

    def getListState(self, name, schema):
        return self._state(name, False)

    def getValueState(self, name, schema):
        return self._state(name, True)

    def registerTimer(self, at):
        self.timers.add(at)


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_windows_of_a_busy_key_cost_no_state_element_by_event():
    n, window, chunk = 30_000, 3_000_000, 10_000_000
    rng = np.random.default_rng(5)
    t = np.sort(rng.integers(0, 60_000_000, n)) // 1000 * 1000
    rows = pd.DataFrame({"drive_id": 1, "t": t, "id": np.arange(n), "writes": rng.integers(0, 2, n), "renames": rng.integers(0, 2, n)})
    rows["file"] = rng.integers(0, 400, n).astype(str)
    rows["token"] = [str(x) if r else None for x, r in zip(rng.integers(0, 30, n), rows["renames"], strict=True)]
    own = rows.assign(chunk=t // chunk, own=True)
    back = rows.assign(chunk=(t + window) // chunk, own=False)
    told = pd.concat([own, back[back["chunk"] > own["chunk"]]])
    processor, handle = Windows(3_000_000, window, chunk), Handle()
    processor.init(handle)
    key, out = (0,), []
    for part, upto in zip((told[told["t"] < 25_000_000], told[told["t"] >= 25_000_000]), (20_000, 90_000), strict=True):
        assert list(processor.handleInputRows(key, iter([part.sample(frac=1, random_state=1)]), Clock(0))) == []
        out += list(processor.handleExpiredTimer(key, Clock(upto), None))
    got = pd.concat(out).sort_values("id")
    assert handle.states["held"].given < 10 and not handle.states["held"].rows
    assert got["id"].tolist() == list(range(n))
    for i in range(0, n, 997):
        seen = rows[(rows["t"] >= t[i] - window) & (rows["t"] <= t[i])]
        want = (seen["writes"].sum(), seen["renames"].sum(), seen["token"].nunique(), seen["file"].nunique())
        assert tuple(got.iloc[i][list(MEASURES)]) == want


def test_one_busy_drive_is_dealt_by_its_time(spark):
    """No operator of the window stream is keyed by the drive alone, and a chunk gets its own rows and a window's look-back."""
    events = spark.range(20_000).selectExpr("id", "0L drive_id", "1700000000000000 + id * 1000000 ts_us", "timestamp_micros(ts_us) event_time", "id % 9 stable_id", "'CREATED' event_type", "'a' local_title")
    told = mentions(events, PARAMS, 64)
    assert "drive_id" not in KEYS and told.count() < 20_000 * 1.01
    assert told.groupBy(*KEYS).count().agg(F.max("count")).first()[0] < 20_000 / 4


def test_runs_over_chunks_and_releases_are_one_attack():
    gap, chunk = 60, 1000
    rng = np.random.default_rng(3)
    # Stretches of events with quiet ones in between, so that some attacks lie over several chunks and some inside one.
    steps = np.where(rng.random(4000) < 0.02, 61 + rng.integers(0, 400, 4000), rng.integers(0, 61, 4000))
    ts = np.cumsum(steps)
    rows = pd.DataFrame({"drive_id": 0, "chunk": ts // chunk, "ts_us": ts, "file": rng.integers(0, 60, 4000).astype(str), "fused": np.round(rng.random(4000), 6)})
    rows.loc[rows.index % 50 == 0, "fused"] = np.nan
    want, number = [], np.cumsum(np.r_[True, np.diff(ts) > gap])
    for no, g in rows.groupby(number):
        want.append((0, no, g["ts_us"].min(), g["ts_us"].max(), g["ts_us"].max() - g["ts_us"].min(), len(g), g["file"].nunique(), g["fused"].max()))
    for cuts in ((4000,), (1, 2, 900, 901, 2500, 4000), tuple(range(40, 4001, 40))):
        processor, handle, out = Attacks(gap), Handle(), []
        processor.init(handle)
        for a, b in zip((0, *cuts), cuts, strict=False):
            out += list(processor.handleInputRows((0,), iter([runs_of(rows.iloc[a:b], gap)]), Clock(0)))
        assert len(held_rows(handle.states["files"])) <= 2 * 60 + 60
        out += list(processor.handleExpiredTimer((0,), Clock(10**9), None))
        assert not handle.states["files"].rows and list(processor.handleExpiredTimer((0,), Clock(10**9), None)) == []
        got = pd.concat(out, ignore_index=True)
        assert len(got) == len(want) and all(x == y or (pd.isna(x) and pd.isna(y)) for r, w in zip(got.itertuples(index=False, name=None), want, strict=True) for x, y in zip(r, w, strict=True))


def test_held_events_of_attacks_cost_no_state_element_by_event():
    n = 30_000
    rows = pd.DataFrame({"drive_id": 0, "chunk": 0, "ts_us": np.arange(n) * 10, "file": [str(i % 7000) for i in range(n)], "fused": 0.9})
    processor, handle = Runs(60), Handle()
    processor.init(handle)
    list(processor.handleInputRows((0,), iter([rows]), Clock(0)))
    released = pd.concat(processor.handleExpiredTimer((0,), Clock(100), None))
    assert handle.states["held"].given < 10 and len(handle.timers) == 2
    assert released["events"].tolist() == [10_001] and len(released["names"].iloc[0]) == 7000


def test_a_poll_of_many_files_is_compared_as_a_table():
    """Cuts inside polls, an empty poll, NULLs beside large numbers; state has few elements and no object by file."""
    n, rng = 30_000, np.random.default_rng(7)
    polls = {}
    for sid in range(1, 8):
        k = np.flatnonzero(rng.random(n) < 0.9) if sid != 4 else np.array([], np.int64)
        polls[sid] = pd.DataFrame({
            "snapshot_id": sid, "snapshot_ts": sid * 5.0, "stable_id": k, "local_title": [None if i % 11 == 0 else f"f{i % 97 + (sid > 5 and i % 5 == 0)}" for i in k],
            "modified_date": k % 3, "file_size": np.where(k % 13 == 0, np.nan, k % 7), "trashed": (k % 17 == 5) & (sid > 2), "full_path": "x", "mark": False,
        }).astype({"trashed": "int64"})
    mark = lambda sid: pd.DataFrame([{"snapshot_id": sid, "snapshot_ts": sid * 5.0, "stable_id": 0, "mark": True}]).reindex(columns=polls[1].columns)
    processor, handle, out = Files(), Handle(), []
    processor.init(handle)
    parts = [[polls[1], mark(1), polls[2].iloc[:9000]], [polls[2].iloc[9000:]], [mark(2), polls[3].iloc[:50], mark(2)], [polls[3].iloc[50:], mark(4), mark(3), polls[5], mark(5), polls[6], polls[2]], [polls[6].iloc[:9], mark(6), polls[7], mark(7), mark(1)]]
    for part in parts:
        out += list(processor.handleInputRows((0, 0), iter(part), None))
    got = pd.concat(out, ignore_index=True)
    plain = lambda rows: {r[0]: tuple(None if pd.isna(v) else v for v in r[1:]) for r in rows[["stable_id", *_SIDE]].itertuples(index=False, name=None)}
    want = set()
    for sid in range(2, 8):
        p, c = plain(polls[sid - 1]), plain(polls[sid])
        want |= {(sid, sid * 5.0, f, p.get(f), c.get(f)) for f in p.keys() | c.keys() if p.get(f) != c.get(f)}
    side = lambda name: [tuple(None if pd.isna(v) else v for v in r) for r in got[[f"{name}_{c}" for c in _SIDE]].itertuples(index=False, name=None)]
    sides = zip(got["snapshot_id"], got["snapshot_ts"], got["stable_id"], got["was"], side("p"), got["is"], side("c"), strict=True)
    found = [(s, t, f, p if was else None, c if there else None) for s, t, f, was, p, there, c in sides]
    assert len(found) == len(want) and set(found) == want
    assert handle.states["files"].given < 20 and handle.states["held"].given < 20 and not handle.states["held"].rows
