"""Components by contour integration against a full solver, whitening against numpy over the whole table."""

import numpy as np
import pytest

from fileguard.llm.feast import count_above, largest
from fileguard.llm.whitening import RESULT, whiten


def of(values, seed=1):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))[0]
    a = q @ np.diag(np.asarray(values, float)) @ q.T
    return (a + a.T) / 2


@pytest.mark.parametrize("values", [
    np.linspace(1, 5, 40), [9] * 5 + [4] * 8 + [1] * 7, [3.0] * 30, [1.0], [2, 1], 10.0 ** -np.arange(24), [5, 5 - 1e-13, 4, 0, 0, 0], [1] * 15 + [1 - 1e-9] * 4 + [0.1] * 3,
])
def test_largest_pairs(values):
    a = of(values)
    found, vectors = largest(a, 16)
    exact = np.linalg.eigvalsh(a)[::-1]
    k = min(16, int((exact > 1e-10 * exact[0]).sum()))
    assert k <= len(found) <= 16
    assert np.allclose(found, exact[: len(found)], rtol=1e-4, atol=1e-13 * exact[0])
    assert np.abs(a @ vectors - vectors * found).max() <= 1e-13 * exact[0]
    assert np.abs(vectors.T @ vectors - np.eye(len(found))).max() < 1e-12


def test_inertia_counts():
    rng = np.random.default_rng(5)
    for n in (1, 2, 7, 30):
        a = rng.standard_normal((n, n))
        a = a + a.T
        values = np.linalg.eigvalsh(a)
        for shift in (*(values[:-1] + values[1:]) / 2, values[0] - 1, values[-1] + 1):
            assert count_above(a, shift) == (values > shift).sum()
    assert count_above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0) == 1
    assert count_above(np.zeros((3, 3)), 0) == 0


def plain(vectors):
    """deviation, whitened (up to sign) and explained of the rows, by numpy over the distinct grid vectors."""
    x = np.floor(64 * np.asarray(vectors, float)).astype(np.int64) + 1000000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    y = fit - sums / n
    values, q = np.linalg.eigh(y.T @ y / n)
    values, q = values[::-1][:16], q[:, ::-1][:, :16]
    return n, ((n * x - sums) ** 2).sum(axis=1), (x - sums / n) @ q / np.sqrt(values), values / np.trace(y.T @ y / n)


def test_against_numpy_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    given = df.collect()
    n, deviation, whitened, explained = plain([r["embedding"] for r in given])
    got = {}
    for r in whiten(df).collect():
        got.setdefault(r["vec_id"], {})[r["component"]] = r
    assert set(got) == {r["vec_id"] for r in given}
    assert all(sorted(parts) == list(range(1, 17)) for parts in got.values())
    ours = np.array([[got[r["vec_id"]][c]["whitened"] for c in range(1, 17)] for r in given])
    signs = np.sign((ours * whitened).sum(axis=0))
    assert np.abs(ours * signs - whitened).max() < 1e-8
    first = got[given[0]["vec_id"]]
    assert np.allclose([first[c]["explained"] for c in range(1, 17)], explained, rtol=1e-9)
    assert all(r["n"] == n and r["identity_error"] < 1e-9 for parts in got.values() for r in parts.values())
    assert [got[r["vec_id"]][1]["deviation"] for r in given] == deviation.tolist()


def test_rows_without_a_result(spark):
    rng = np.random.default_rng(2)
    good = rng.standard_normal((40, 3)).astype(np.float32)
    items = [(i, v.tolist(), "x") for i, v in enumerate(good)]
    items += [(None, good[0].tolist(), "x"), (0, good[0].tolist(), "again"), (0, good[0].tolist(), "again")]
    items += [(100, None, "x"), (101, [1.0, None, 2.0], "x"), (102, [1.0, float("nan"), 2.0], "x"), (103, [float("inf"), 0.0, 0.0], "x")]
    items += [(104, [1.0], "x"), (105, [], "x"), (106, [1e20, 0.0, 0.0], "x")]
    df = spark.createDataFrame(items, "vec_id long, embedding array<float>, n string")
    got = whiten(df).collect()
    n, deviation, _, _ = plain(good)
    assert len(got) == 43 * 3 and {r["n"] for r in got} == {n}
    assert {r["deviation"] for r in got if r["vec_id"] is None} == {int(deviation[0])}
    assert not {r["vec_id"] for r in got} & set(range(100, 107))


def test_no_components(spark):
    schema = "vec_id long, embedding array<float>"
    for items in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])]):
        out = whiten(spark.createDataFrame(items, schema))
        assert out.count() == 0
        assert [f"{n} {t.replace('bigint', 'long')}" for n, t in out.dtypes] == RESULT.split(", ")
    # One direction only: one component.
    line = whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(50)], schema)).collect()
    assert {r["component"] for r in line} == {1} and abs(line[0]["explained"] - 1) < 1e-9


def test_sums_beyond_64_bits(spark):
    items = [(i, [float(x), 1.0]) for i, x in enumerate((0, 2**29, 2**28, 5))] * 2 + [(9, [3.0, 2.0])]
    got = {r["vec_id"]: r["deviation"] for r in whiten(spark.createDataFrame(items, "vec_id long, embedding array<double>")).collect()}
    x = [[64 * int(v) + 1000000 for v in e] for _, e in {i: (i, e) for i, e in items}.values()]
    ids = list({i: 0 for i, _ in items})
    sums = [sum(c) for c in zip(*x, strict=True)]
    exact = {i: sum((5 * v - s) ** 2 for v, s in zip(e, sums, strict=True)) for i, e in zip(ids, x, strict=True)}
    assert got == {i: v if v < 2**63 else None for i, v in exact.items()}
    assert None in got.values()
