import random

import numpy as np
import pytest

from fileguard.llm.exact_substrings import minimizer_runs, remove_repeats, repeated_windows
from tests.llm.cases import ROWS, awkward, documents, empty, removed, rows

COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def pooled(seed, n=30):
    """Texts pasted together from a few passages, so that repeats overlap, nest and end anywhere."""
    rng = random.Random(seed)
    pool = ["".join(rng.choice("ab c") for _ in range(rng.randint(5, 150))) for _ in range(6)]
    return [(i, "".join(rng.choice(pool) for _ in range(rng.randint(0, 6)))) for i in range(n)]


def test_windows_against_a_set():
    rng = random.Random(3)
    for trial in range(60):
        length = rng.choice([40, 100])
        parts = [t.encode() for _, t in pooled(trial, 8) if len(t) >= length] or [b"a" * 300]
        seen, expected = set(), []
        for part in parts:
            flags = []
            for i in range(len(part) - length + 1):
                flags.append(part[i : i + length] in seen)
                seen.add(part[i : i + length])
            expected.append(flags)
        assert [list(map(bool, f)) for f in repeated_windows(parts, length)] == expected


def test_segments_hold_every_window_once():
    texts = [b"", b"short", b"abc" * 50, bytes(range(1, 200)), b"x" * 120]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.r_[0, np.cumsum([len(t) for t in texts])]
    _, first, end = minimizer_runs(raw, offsets, 100, 32)
    held = sorted(i for a, b in zip(first, end, strict=True) for i in range(a, b))
    assert held == [o + i for o, t in zip(offsets, texts, strict=False) for i in range(len(t) - 99)]


@pytest.mark.parametrize("group", [1 << 14, 2])
def test_against_brute_force(spark, group):
    """``group=2`` sends nearly every minimizer down the path of single windows."""
    items = pooled(11, 40)
    df = spark.createDataFrame(items, "doc_id long, text string").repartition(4)
    assert rows(remove_repeats(df, group=group), *COLUMNS) == removed(items, 100)
    assert rows(remove_repeats(df, length=50, gram=20, group=group), *COLUMNS) == removed(items, 50)


def test_awkward_rows(spark):
    found = remove_repeats(awkward(spark), carried=("lang",))
    small = [(d, t) for d, t in ROWS if len(t or "") < 10_000]
    big = {7, 8}
    got = [r for r in rows(found, *COLUMNS) if r[0] not in big]
    assert got == [r for r in removed(small, 100) if r[0] not in big]
    long = {r["doc_id"]: r for r in found.where("doc_id in (7, 8)").collect()}
    assert long[8]["kept"] == "and a bit more"[-len(long[8]["kept"]) :] or long[8]["n_removed"] > 200_000
    # The long text repeats its own sentence: one occurrence stays, and what is too short to fill a window.
    assert long[7]["n_bytes"] - long[7]["n_removed"] < 200


def test_empty(spark):
    assert remove_repeats(empty(spark)).count() == 0


def test_test_data(spark):
    docs = documents(spark)
    items = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert rows(remove_repeats(docs), *COLUMNS) == removed(items, 100)
