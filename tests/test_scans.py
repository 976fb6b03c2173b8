"""Every chunked scan against a plain loop, with chunks small enough to cut every key many times."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from fileguard.operators import decisions, detectors, features, forensics, hmm, models, scans
from fileguard.params import MICROS, DecisionParams, DetectorParams, HmmParams, ScanParams

TINY = ScanParams(chunk_seconds=7, rows_per_chunk=5)


def random_events(n=400, seed=3, drives=2, files=6):
    """Many ties in time, one file with a third of the rows, gaps in the ids."""
    rnd, rows, t, i = random.Random(seed), [], 1_000_000_000, 0
    for _ in range(n):
        t += rnd.choice([0, 0, 1, 400_000, 3_000_000, 20_000_000, 60_000_000])
        i += rnd.choice([1, 1, 1, 13])
        kind = rnd.choice(["RENAMED", "RENAMED", "CREATED", "MODIFIED", "DELETED"])
        file = 1 if rnd.random() < 0.33 else rnd.randrange(files)
        title = rnd.choice(["a.docx", "b.encrypted", "c.encrypted", "", "noext", None])
        rows.append((i, t / MICROS, rnd.randrange(drives), file, kind, title, title, t))
    return pd.DataFrame(
        rows, columns=["id", "timestamp", "drive_id", "stable_id", "event_type", "local_title", "full_path", "ts_us"]
    )


@pytest.fixture(scope="module")
def pdf():
    return random_events()


@pytest.fixture(scope="module")
def events(spark, pdf):
    return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), """id bigint, timestamp double,
        drive_id bigint, stable_id bigint, event_type string, local_title string, full_path string, ts_us bigint""")


def test_window_measures(pdf, events):
    got = {r.id: r for r in detectors.detector_flags(events, DetectorParams(velocity_threshold=4), TINY).collect()}
    assert len(got) == len(pdf)
    for row in pdf.itertuples():
        seen = pdf[(pdf.drive_id == row.drive_id) & (pdf.ts_us <= row.ts_us) & (pdf.ts_us >= row.ts_us - 60 * MICROS)]
        writes = seen.event_type.isin(["MODIFIED", "CREATED", "RENAMED"]).sum()
        renames = seen[seen.event_type == "RENAMED"]
        tokens = {(t or "").split(".")[-1] for t in renames.local_title}
        r = got[row.id]
        assert (r.recent_writes, r.recent_renames, r.rename_extensions, r.recent_files) == (
            writes,
            len(renames),
            len(tokens),
            seen.stable_id.nunique(),
        )
        assert r.high_velocity == (writes > 4)
        assert r.systematic_rename == (len(renames) >= 5 and len(tokens) == 1)


def test_previous_title(pdf, events):
    got = {r.id: r.previous_title for r in features.previous_title(events, TINY).collect()}
    state = {}
    for row in pdf.sort_values("id").itertuples():
        key = (row.drive_id, row.stable_id)
        assert got[row.id] == (state.get(key) if row.stable_id else None)
        state[key] = row.local_title or ""


def test_entropy_sequence(pdf, events):
    rows = events.withColumn("file_name_entropy", F.col("id").cast("double"))
    got = {r.id: r.entropies for r in hmm.entropy_sequence(rows, 15, TINY).collect()}
    for _, drive in pdf.groupby("drive_id"):
        ids = sorted(drive.id)
        for n, i in enumerate(ids):
            assert got[i] == ([float(x) for x in ids[n - 14 : n + 1]] if n >= 14 else None)


def test_trailing_rows_from_base(events):
    value = F.col("id").cast("double")
    plain = scans.trailing_rows(events, "drive_id", "id", value, "v", 4, 5)
    based = scans.trailing_rows(
        events.withColumn("x", value), "drive_id", "id", F.col("x"), "v", 4, 5, base=events, base_value=value
    )
    pick = lambda df: sorted((r.id, r.v) for r in df.collect())
    assert pick(plain) == pick(based)


def viterbi(xs, p):
    from math import log

    def b(x, k):
        return -((x - p.mu[k]) ** 2) / (2 * p.var[k]) - 0.5 * log(p.var[k])

    d = [log(p.pi[k]) + b(xs[0], k) for k in (0, 1)]
    back = []
    for x in xs[1:]:
        came = [max((0, 1), key=lambda j: (d[j] + log(p.a[j][k]), -j)) for k in (0, 1)]
        d = [d[came[k]] + log(p.a[came[k]][k]) + b(x, k) for k in (0, 1)]
        back.append(came)
    path = [1 if d[1] > d[0] else 0]
    for came in reversed(back):
        path.append(came[path[-1]])
    return path[::-1]


@pytest.mark.parametrize("a", [((0.9, 0.1), (0.2, 0.8)), ((0.2, 0.8), (0.7, 0.3))])
def test_viterbi(spark, a):
    p = HmmParams(pi=(0.7, 0.3), a=a, mu=(3.0, 4.0), var=(0.3, 0.2))
    rnd = random.Random(5)
    seqs = [[rnd.uniform(2, 5) for _ in range(15)] for _ in range(200)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)] + [(999, None)], "id int, entropies array<double>")
    rows = {r.id: r for r in hmm.hmm_path(hmm.hmm_state(df, p), p).collect()}
    for i, s in enumerate(seqs):
        want = viterbi(s, p)
        assert rows[i].path == want and rows[i].state == want[-1] and rows[i].malicious == (want[-1] == 1)
    assert rows[999].state is None and rows[999].malicious is None and rows[999].path is None


def test_batch_threat_and_trigger(spark):
    rnd, rows = random.Random(11), []
    for i in range(600):
        rows.append((i, rnd.randrange(2), i // 6 * 3_000_000 + i % 6, rnd.choice([0.1, 0.5, 0.84, 0.85, 0.86, 0.9, 0.0]),
                     rnd.random() < 0.2, i % 5, "MODIFIED", f"f{i}", f"p/f{i}", float(i)))
    df = spark.createDataFrame(rows, """id bigint, drive_id bigint, ts_us bigint, fused double, malicious boolean,
        stable_id bigint, event_type string, local_title string, full_path string, timestamp double""")
    for width in (1, 2, 4, 1000):
        got = {(r.drive_id, r.batch): r for r in
               decisions.batch_threat(df, DecisionParams(), ScanParams(rows_per_chunk=width)).collect()}
        groups = {}
        for r in rows:
            groups.setdefault((r[1], r[2] // 3_000_000), []).append(r)
        assert set(got) == set(groups)
        for key, events in groups.items():
            top, trigger = 0.0, None
            for e in events:
                if e[3] > top:
                    top, trigger = e[3], e[0]
                if e[4]:
                    top = max(top, 0.85)
            r = got[key]
            assert r.threat == top and (r.trigger.id if r.trigger else None) == trigger
            assert r.hmm_hit == any(e[4] for e in events) and r.events == len(events)


@pytest.mark.parametrize("chunk", [60, 86_400])
def test_cooldown(spark, chunk):
    rnd, rows, t = random.Random(2), [], 0
    for i in range(3000):
        t += rnd.choice([0, 1, 250_000, 2_000_000, 29_999_999, 30_000_000, 31_000_000]) if rnd.random() < 0.2 else 900_000
        rows.append((i, i % 3 // 2, t))
    df = spark.createDataFrame(rows, "id bigint, drive_id bigint, ts_us bigint")
    got = sorted(r.id for r in decisions.alert_cooldown(df, chunk_seconds=chunk).collect())
    want, ready = [], {}
    for i, drive, at in rows:
        if at >= ready.get(drive, -1):
            want.append(i)
            ready[drive] = at + 30_000_000
    assert got == want


def test_live_runs(spark):
    rnd, t, rows = random.Random(4), 0, []
    for _ in range(500):
        t += rnd.choice([1, 10, 59, 60, 61, 130])
        rows.append((rnd.randrange(2), t))
    got = scans.live_runs(spark.createDataFrame(rows, "k int, t bigint"), ["k"], "t", 60)
    runs = {(r.k, r.run_no): (r.run_start, r.run_end) for r in got.collect()}
    for k in (0, 1):
        want = []
        for at in sorted(t for kk, t in rows if kk == k):
            if want and at - want[-1][1] <= 60:
                want[-1][1] = at
            else:
                want.append([at, at])
        assert [runs[k, i + 1] for i in range(len(want))] == [tuple(w) for w in want]
        assert len(want) == sum(1 for key in runs if key[0] == k)


def test_restore_points(spark, pdf, events):
    asked = spark.createDataFrame(
        [(d, a, f, int(pdf.ts_us.iloc[at])) for d in (0, 1) for f in range(6) for a, at in enumerate((0, 50, 200, 399))],
        "drive_id bigint, attack_no bigint, stable_id bigint, start_us bigint",
    )
    got = forensics.restore_points(events, asked, ScanParams(rows_per_chunk=10), seconds_per_chunk=40).collect()
    assert len(got) == 48
    for r in got:
        past = pdf[(pdf.drive_id == r.drive_id) & (pdf.stable_id == r.stable_id) & (pdf.ts_us < r.start_us)]
        want = past.sort_values(["ts_us", "id"]).id.iloc[-1] if len(past) else None
        assert r.restore_id == want


def test_stratified_split(spark):
    rows = spark.range(1000).select(F.col("id").alias("row_id"), (F.col("id") % 10 == 0).cast("int").alias("label"))
    got = models.stratified_split(rows).groupBy("label", "split").count().collect()
    assert {(r.label, r.split): r["count"] for r in got} == {
        (0, "test"): 180, (0, "train"): 720, (1, "test"): 20, (1, "train"): 80
    }


def test_a_burst_is_cut_into_pieces_of_bounded_size(spark):
    """One second with nine tenths of a drive: no piece above the bound, and the same counts as without pieces."""
    from fileguard.operators import scans

    rows = spark.range(4000).select(
        "id", F.lit(1).cast("long").alias("drive_id"), F.when(F.col("id") % 10 != 0, 5_000_000_000 + F.col("id") * 231 % 1_000_000).otherwise(F.col("id") * 3_000_000).alias("ts_us"),
        (F.col("id") * 7 % 50).alias("stable_id"),
    )
    how = dict(counts={"n": F.col("id") % 2 == 0}, distinct={"files": (F.lit(True), F.col("stable_id"))}, window_us=400_000, chunk_us=600_000_000)
    plain = scans.trailing_counts(rows, **how)
    cut = scans.trailing_counts(rows, **how, rows_per_piece=150)
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, plain.collect()))
    steps = rows.select("drive_id", F.col("ts_us").alias("_t"), scans.slot(F.col("ts_us"), 600_000_000).alias("_chunk"))
    sizes = scans.row_bounded(steps, "drive_id", "_t", 150).groupBy("_chunk").count().agg(F.max("count"), F.count("*")).first()
    assert sizes[0] <= 150 and sizes[1] > 3600 / 150
    # Times with equal rows stay together, in order.
    bounds = scans.row_bounded(steps, "drive_id", "_t", 150).groupBy("_chunk").agg(F.min("_t").alias("lo"), F.max("_t").alias("hi")).orderBy("_chunk").collect()
    assert all(a["hi"] < b["lo"] for a, b in zip(bounds, bounds[1:], strict=False))
