import pandas as pd
from pyspark.sql import functions as F

from fileguard.operators.decisions import alerts, batch_threat
from fileguard.params import EngineParams, HmmParams, ScanParams
from fileguard.plans.detection import scored_events
from fileguard.schemas import FILE_EVENTS
from fileguard.sources.events import stream_events
from fileguard.sources.snapshots import ITEMS, stream_snapshots
from fileguard.streaming import detect

PARAMS = EngineParams(
    hmm=HmmParams(a=((0.95, 0.05), (0.1, 0.9)), mu=(3.0, 3.6), var=(0.05, 0.05)), scan=ScanParams(7, 9)
)
ONCE = {"availableNow": True}


def make_events(n: int = 300) -> pd.DataFrame:
    rows, t = [], 1_700_000_000.0
    for i in range(n):
        t += 0.31 if i % 100 < 70 else 11.0
        kind = ("RENAMED", "CREATED", "MODIFIED", "RENAMED", "DELETED")[i % 5]
        file = (i * 7) % 40
        title = f"doc_{file}" + (".encrypted" if i % 3 and kind == "RENAMED" else ".docx")
        rows.append((i + 1, t, i % 2, file, kind, title, 1, "", f"A/{title}"))
    return pd.DataFrame(rows, columns=FILE_EVENTS.fieldNames())


def sentinel(after: pd.DataFrame, seconds: float) -> pd.DataFrame:
    """An event far in the future moves the watermark past everything before it and is itself never released."""
    last = after["timestamp"].max() + seconds
    return pd.DataFrame(
        [(10_000_000, last, 99, 99, "CREATED", "end", 1, "", "end")], columns=FILE_EVENTS.fieldNames()
    )


def write(spark, pdf, path, name):
    spark.createDataFrame(pdf, FILE_EVENTS).coalesce(1).write.parquet(f"{path}/{name}")


def run(spark, source, out, check, files_per_batch=1):
    stream = stream_events(spark, f"{source}/*", files_per_batch)
    query = detect.detection_stream(stream, out, check, PARAMS, trigger=ONCE)
    query.awaitTermination(240)
    assert query.exception() is None
    return query


def compact(df, columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_stream_equals_batch_across_cuts_and_restart(spark, tmp_path):
    pdf = make_events(200)
    batch = scored_events(spark.createDataFrame(pdf, FILE_EVENTS), PARAMS)
    columns = ["drive_id", "id", "previous_title", F.round("fused", 9).alias("fused"), "state", "recent_files"]
    want = compact(batch, columns)
    want_alerts = compact(
        alerts(batch_threat(batch, PARAMS.decision, PARAMS.scan), PARAMS.decision),
        ["drive_id", "ts_us", "threat_level", "affected_files_count", "sync_paused", "triggering_event.id"],
    )
    source, out, check = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check"
    # Out of order inside the allowed delay; cut at places that split poll intervals; a restart in the middle.
    write(spark, pdf.iloc[:61].sample(frac=1, random_state=1), source, "a")
    run(spark, source, out, check)
    write(spark, pdf.iloc[61:].sample(frac=1, random_state=2), source, "b")
    write(spark, sentinel(pdf, 1000), source, "c")
    run(spark, source, out, check, files_per_batch=2)
    write(spark, sentinel(pdf, 2000), source, "d")
    run(spark, source, out, check)
    got = detect.read_scored(spark, out)
    assert compact(got.where("drive_id < 99"), columns) == want
    found = spark.read.parquet(f"{out}/alerts").where("drive_id < 99")
    assert (
        compact(
            found,
            ["drive_id", "ts_us", "threat_level", "affected_files_count", "sync_paused", "triggering_event.id"],
        )
        == want_alerts
    )
    assert len(want_alerts) > 1


def test_snapshot_stream(spark, tmp_path):
    def snap(sid, titles):
        return [(0, sid, float(sid), k, v, 1, 1, 0, v) for k, v in titles.items()]

    polls = [snap(1, {1: "a", 2: "b"}), snap(2, {1: "a.enc", 3: "c"}), snap(3, {1: "a.enc", 2: "b", 3: "c"})]
    for i, rows in enumerate(polls):
        spark.createDataFrame(rows, ITEMS).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        query = detect.snapshot_stream(
            stream_snapshots(spark, f"{tmp_path}/in/*"), f"{tmp_path}/out", f"{tmp_path}/check", ONCE
        )
        query.awaitTermination(120)
        assert query.exception() is None
    got = compact(spark.read.parquet(f"{tmp_path}/out"), ["snapshot_id", "stable_id", "event_type"])
    assert got == [(2, 1, "RENAMED"), (2, 2, "DELETED"), (2, 3, "CREATED"), (3, 2, "CREATED")]


def test_attack_session_stream(spark, tmp_path):
    base = 1_700_000_000_000_000
    times = [0, 60_000_000, 200_000_000, 100_000_000_000]
    pdf = pd.DataFrame({"drive_id": 0, "ts_us": [base + t for t in times], "fused": 0.9, "malicious": False})
    spark.createDataFrame(pdf).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    query = (
        detect.attack_session_stream(stream)
        .writeStream.format("memory")
        .queryName("attacks")
        .option("checkpointLocation", f"{tmp_path}/check")
        .start()
    )
    query.processAllAvailable()
    query.stop()
    got = compact(spark.table("attacks"), ["start_us", "end_us", "events"])
    assert got == [(base, base + 60_000_000, 2), (base + 200_000_000, base + 200_000_000, 1)]


def test_late_events_are_dropped_and_counted(spark, tmp_path):
    from fileguard.streaming.ordered import late_rows

    pdf = make_events(100)
    source, out, check = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check"
    write(spark, pdf, source, "a")
    run(spark, source, out, check)
    late = pdf.iloc[:3].assign(id=[900, 901, 902])
    write(spark, pd.concat([late, sentinel(pdf, 500)]), source, "b")
    query = run(spark, source, out, check)
    assert late_rows(query) == 3
    assert detect.read_scored(spark, out).where("id >= 900").count() == 0
