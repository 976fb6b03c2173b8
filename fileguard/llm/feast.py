"""The largest eigenvalues of a symmetric matrix by contour integration over eigenvalue intervals (FEAST).

A quadrature of the resolvent around a circle is a filter that keeps the eigenvectors whose eigenvalues lie inside. Applied to
a block of vectors and followed by a Rayleigh-Ritz step, a few rounds give the pairs of one interval to double precision. The
inertia of the shifted matrix (Sylvester) counts the eigenvalues above a number, so it cuts the spectrum into intervals of few
eigenvalues and afterwards proves that none was missed. The matrix is small (dimensions, not rows).
"""

from __future__ import annotations

import numpy as np

#: Nodes of the quadrature on the upper half circle, eigenvalues asked for in one interval, rounds in one subspace.
NODES = 12
SLICE = 6
ROUNDS = 24
TINY = np.finfo(float).eps
#: Share of the matrix norm below which an eigenvalue is rounding: above it, its own relative error stays below 1e-4.
NOISE = 1e-11
#: Share of the matrix norm below which neighbours are not cut apart.
CLOSE = 1e-9
PIVOT = (1 + 17**0.5) / 8


def count_above(matrix: np.ndarray, shift: float) -> int:
    """Eigenvalues of a symmetric matrix above ``shift``: positive pivots of its factors L D L' with complete pivoting."""
    a = matrix - shift * np.eye(len(matrix))
    n, k, positive = len(a), 0, 0

    def swap(i: int, j: int) -> None:
        if i != j:
            a[[i, j]] = a[[j, i]]
            a[:, [i, j]] = a[:, [j, i]]

    while k < n:
        rest = a[k:, k:]
        own = np.abs(np.diagonal(rest))
        r = int(own.argmax())
        off = np.abs(np.tril(rest, -1))
        p, q = np.unravel_index(off.argmax(), off.shape)
        if own[r] >= PIVOT * off[p, q]:
            if own[r] == 0:
                break
            swap(k, k + r)
            pivot, v = a[k, k], a[k + 1 :, k].copy()
            positive += pivot > 0
            a[k + 1 :, k + 1 :] -= np.outer(v, v) / pivot
            k += 1
        else:
            # A 2 by 2 pivot whose off-diagonal is largest has one positive and one negative eigenvalue.
            swap(k, k + int(q))
            swap(k + 1, k + int(p))
            v = a[k + 2 :, k : k + 2].copy()
            a[k + 2 :, k + 2 :] -= v @ np.linalg.solve(a[k : k + 2, k : k + 2], v.T)
            positive += 1
            k += 2
    return int(positive)


def cut_below(matrix: np.ndarray, j: int, low: float, high: float) -> tuple[float, int]:
    """A number with ``j`` eigenvalues above it, in the middle of their gap, and j; if the j-th and the next are closer than
    ``CLOSE``, a number below all that lie together and how many are above that."""
    a, b = low, high
    while b - a > CLOSE * high:
        middle = (a + b) / 2
        count = count_above(matrix, middle)
        if count == j:
            break
        a, b = (middle, b) if count > j else (a, middle)
    else:
        return a, count_above(matrix, a)
    left, right = middle, middle
    for _ in range(12):
        x, y = (a + left) / 2, (b + right) / 2
        a, left = (a, x) if count_above(matrix, x) == j else (x, left)
        b, right = (b, y) if count_above(matrix, y) == j else (y, right)
    return (left + right) / 2, j


def projected(matrix: np.ndarray, low: float, high: float, block: np.ndarray) -> np.ndarray:
    """The block's part in the eigenvectors of (low, high): the resolvent integrated over the circle on that diameter."""
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    radius, eye = (high - low) / 2, np.eye(len(matrix))
    out = np.zeros_like(block)
    for x, w in zip(nodes, weights, strict=True):
        turn = np.exp(-0.5j * np.pi * (x - 1))
        solved = np.linalg.solve(((low + high) / 2 + radius * turn) * eye - matrix, block.astype(complex))
        out += 0.5 * w * (radius * turn * solved).real
    return out


def ritz(matrix: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Falling Ritz values and their orthonormal vectors in the space that the block spans."""
    u, s, _ = np.linalg.svd(block, full_matrices=False)
    u = u[:, s > s[0] * TINY * len(matrix)]
    values, turns = np.linalg.eigh(u.T @ matrix @ u)
    return values[::-1], (u @ turns)[:, ::-1]


def interval(matrix: np.ndarray, low: float, high: float, above: int, expected: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``expected`` pairs with eigenvalues in (low, high), below ``above`` larger ones; the subspace is doubled until all of
    them are found."""
    n, scale = len(matrix), np.abs(matrix).max()
    size = min(n, 2 * expected + 2)
    while True:
        block = np.random.default_rng(size).standard_normal((n, size))
        last = np.inf
        for _ in range(ROUNDS):
            values, vectors = ritz(matrix, projected(matrix, low, high, block))
            inside = (values > low) & (values < high)
            rest = np.abs(matrix @ vectors[:, inside] - vectors[:, inside] * values[inside]).max(initial=0)
            if inside.sum() == expected and (rest <= 8 * TINY * scale or (rest <= 1e-12 * scale and rest >= last)):
                return values[inside], vectors[:, inside]
            block, last = vectors, rest
        if size == n:
            # The whole space: Rayleigh-Ritz is complete whatever the filter did.
            values, vectors = ritz(matrix, np.eye(n))
            return values[above : above + expected], vectors[:, above : above + expected]
        size = min(n, 2 * size)


def largest(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, of a symmetric positive semidefinite matrix and unit vectors as columns; fewer if
    fewer are above rounding. Signs are such that the entry of largest magnitude is positive."""
    n = len(matrix)
    scale = float(np.abs(matrix).max(initial=0.0))
    if n == 0 or scale == 0 or not np.isfinite(scale):
        return np.zeros(0), np.zeros((n, 0))
    unit = matrix / scale
    high = float(np.abs(unit).sum(axis=1).max()) * (1 + 1e-6)
    zero = max(NOISE, 8 * n * TINY) * high
    k = min(k, count_above(unit, zero))
    found, done = [], 0
    top = cut_below(unit, 0, zero, high)[0] if count_above(unit, high) == 0 else high
    while done < k:
        low, count = cut_below(unit, min(k, done + SLICE), zero, top)
        low = max(low, zero)
        values, vectors = interval(unit, low, top, done, count - done)
        found.append(vectors)
        done, top = count, low
    values, vectors = ritz(unit, np.hstack(found)) if found else (np.zeros(0), np.zeros((n, 0)))
    values, vectors = values[:k], vectors[:, :k]
    if len(values) < k or not np.allclose(vectors.T @ vectors, np.eye(k), atol=1e-10):
        raise ArithmeticError("components do not span the intervals that inertia has counted")
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)])
    return values * scale, vectors * signs
