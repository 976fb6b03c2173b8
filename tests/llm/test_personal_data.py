"""Base spans against plain regular expressions, the tagger's gradient and its spans on texts it has not seen."""

import hashlib
import random
import re

import numpy as np
import pytest

from fileguard.llm import personal_data as pd
from fileguard.llm.character_tagger import CLASSES, allowed, spans_of, started
from tests.llm.cases import ROWS, awkward, empty

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def fits(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return 14 <= len(digits) <= 19 and sum(v // 10 + v % 10 for v in doubled) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def plain(text):
    found = [(m.start(), i, k, m.end()) for i, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text) if fits(k, m[0])]
    return [(k, s, e) for s, _, k, e in sorted(found)]


def test_base_is_what_the_patterns_find():
    rng = random.Random(4)
    signs = ["a", "B", ".", "@", "-", "+", "(", ")", " ", "7", "12", "255", "256", "4111111111111111", "\n", "é", "%", "+1", "1.2.3.4"]
    for _ in range(4000):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(40)))
        assert pd.base(text) == plain(text), text


@pytest.mark.parametrize("text", ["9" * 300_000, "a" * 300_000 + "@", "@" * 100_000, "1." * 100_000, "+1" + " " * 200_000, "a@" * 100_000, "+" * 100_000 + "1 " * 100_000])
def test_base_is_linear(text):
    import time

    start = time.time()
    pd.base(text)
    pd.window_starts(text)
    assert time.time() - start < 5


def test_gradient():
    tagger = started(("a", "b"), hidden=5)
    tagger.weights = {k: v.astype(float) for k, v in tagger.weights.items()}
    x = np.random.default_rng(0).integers(0, CLASSES, (3, 7)).astype(np.uint8)
    y = np.array([[0, 1, 2, 0, 3, 4, 4], [1, 2, 2, 3, 0, 0, 1], [0] * 7])
    _, grads = tagger.gradient(x, y)
    for name, w in tagger.weights.items():
        at = np.unravel_index(np.abs(grads[name]).argmax(), w.shape)
        old, sides = w[at], []
        for step in (1e-4, -1e-4):
            w[at] = old + step
            sides.append(tagger.gradient(x, y)[0])
        w[at] = old
        assert abs((sides[0] - sides[1]) / 2e-4 - grads[name][at]) < 1e-3 * max(1, abs(grads[name][at])), name


def test_best_sequence_against_all_sequences():
    from itertools import product

    tagger = started(("a",), hidden=3)
    tagger.weights["moves"] += np.random.default_rng(1).standard_normal(tagger.weights["moves"].shape).astype(np.float32)
    x = np.random.default_rng(2).integers(0, CLASSES, (5, 6)).astype(np.uint8)
    e, moves = tagger.emissions(x), tagger.weights["moves"] + allowed(1)
    paths, _ = tagger.decoded(x)
    for b in range(5):
        score = lambda y: e[0, b, y[0]] + moves[3, y[0]] + sum(e[t, b, y[t]] + moves[y[t - 1], y[t]] for t in range(1, 6))  # noqa: B023, E731
        assert tuple(paths[b]) == max(product(range(3), repeat=6), key=score)


def test_spans_of_a_sequence():
    assert spans_of(np.array([0, 1, 2, 2, 1, 3, 4, 0, 3]), ("a", "b")) == [("a", 1, 4), ("a", 4, 5), ("b", 5, 7), ("b", 8, 9)]


def test_reconciled():
    text = "x" * 10 + "10.20.30.40" + " " * 100 + "1.2.3.4 then more"
    whole, cut = ("ip", 10, 21, 5.0, False, False), ("ip", 10, 15, 2.0, False, True)
    assert pd.reconciled(text, [], [whole, cut]) == [("ip", 10, 21)]
    assert pd.reconciled(text, [], [cut, ("ip", 13, 21, 3.0, True, False)]) == [("ip", 10, 21)]
    assert pd.reconciled(text, [("ip", 10, 21)], [whole]) == []
    assert pd.reconciled(text, [], [("ip", 11, 21, 5.0, False, False)]) == []  # inside a number
    # A long weak span loses against two short ones with the larger sum.
    pair = [("ip", 0, 7, 3.0, False, False), ("ip", 8, 15, 3.0, False, False), ("card", 4, 20, 5.0, False, False)]
    assert pd.reconciled("1.2.3.4 4.3.2.1 4111111111111111", [], pair) == [("ip", 0, 7), ("ip", 8, 15)]


def test_windows_cover_every_trigger():
    rng = random.Random(8)
    for _ in range(200):
        text = "".join(rng.choice("abc  \n") if rng.random() < 0.97 else rng.choice("1@7") for _ in range(rng.randrange(1, 900)))
        starts = pd.window_starts(text)
        assert starts == sorted(set(starts))
        want = {k * 64 for k in range(len(text) // 64 + 1) if re.search("[0-9@]", text[k * 64 : k * 64 + 128])}
        assert set(starts) == want


def test_held_out_spans(spark):
    """Trained on one table's documents, the tagger finds disguised spans in texts of another and leaves other numbers alone."""
    tagger = pd.fitted(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    others = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    around = [r[0] for r in others.where("doc_id > 0 and length(text) > 400 and not text rlike '[0-9@]'").orderBy("doc_id").limit(100).collect() for r in [(r["text"],)]]
    rng = np.random.default_rng(99)
    names = ["maria", "johann", "silva", "peter", "dupont", "garcia", "miller"]
    found, planted, wrong = 0, 0, 0
    for i in range(400):
        text = around[i % len(around)]
        at = text.index(" ", int(rng.integers(50, 300)))
        kind, value = pd.KINDS[i % 4], ""
        while not pd.holds(kind, value):
            value = pd.disguised(kind, "x@y.z", rng, names)
        known, more = pd.all_spans([f"{text[:at]} {value}{text[at:]}"], tagger)[0]
        planted += 1
        found += (at + 1, at + 1 + len(value)) in {(s, e) for _, s, e in known + more}
        known, more = pd.all_spans([f"{text[:at]} {pd.harmless(rng)}{text[at:]}"], tagger)[0]
        wrong += bool(known or more)
    assert found >= 0.93 * planted and wrong <= 0.02 * planted, (found, planted, wrong)
    # Two values side by side are one failing match of the patterns.
    side = "call +1 (171) 555-2028 4111111111111111 now"
    assert pd.base(side) == []
    assert pd.all_spans([side], tagger)[0][1] == [("phone", 5, 22), ("card", 23, 39)]


def test_table(spark):
    items = [*ROWS, (20, "mail a.b@c.de or 1.2.3.4, +49 30 1234567"), (20, "mail a.b@c.de or 1.2.3.4, +49 30 1234567"), (21, "😀 a@b.cd")]
    df = spark.createDataFrame(items, "doc_id long, text string")
    got = sorted((tuple(r) for r in pd.personal_data(df, None).collect()), key=repr)
    want = []
    for doc_id, text in items:
        spans = plain(text or "")
        written = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        counts = [sum(k == kind for k, _, _ in spans) for kind in pd.KINDS]
        want.append((doc_id, *counts, hashlib.sha256(written.encode()).hexdigest(), written, 0))
    assert got == sorted(want, key=repr)
    assert pd.personal_data(awkward(spark), None).count() == len(ROWS)


def test_nothing_to_learn_from(spark):
    assert pd.fitted(empty(spark)) is None
    assert pd.fitted(spark.createDataFrame([(None, "1.2.3.4"), (1, None), (2, "no such data")], "doc_id long, text string")) is None
    assert pd.personal_data(empty(spark), None).count() == 0
