"""A character tagger in numpy: bidirectional LSTM, linear layer, CRF transitions; trained on labelled spans.

Characters are classes: a letter whatever its case, a digit whatever its value, each ASCII sign. A label is O, or begin or inside
of a kind; the CRF forbids an inside without its begin. The loss is the negative log-likelihood of whole label sequences, its
gradient goes through time in full; steps are those of Adam. Windows shorter than the width are padded with a class of their own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

HIDDEN = 24
EPOCHS = 10
BATCH = 64
RATE = 0.012
FORBIDDEN = -1e4

#: Classes: 0 padding, 1 digit, 2 to 27 letters, 28 other letter, 29 space, 30 other blank, 31 other sign, 32 on ASCII signs.
SIGNS = [c for c in map(chr, range(33, 127)) if not c.isalnum()]
CLASSES = 32 + len(SIGNS)

Span = tuple[str, int, int]


def classes(text: str, width: int) -> np.ndarray:
    """The classes of up to ``width`` characters, padded."""
    points = np.frombuffer(text[:width].encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros(width, np.uint8)
    ascii_table = np.full(128, 31, np.uint8)
    ascii_table[48:58] = 1
    ascii_table[65:91] = ascii_table[97:123] = np.arange(2, 28)
    ascii_table[32] = 29
    ascii_table[9:14] = 30
    ascii_table[[ord(c) for c in SIGNS]] = np.arange(32, CLASSES)
    plain = points < 128
    found = np.where(plain, ascii_table[np.minimum(points, 127)], 31)
    for i in np.flatnonzero(~plain):
        c = text[i]
        found[i] = 28 if c.isalpha() else 30 if c.isspace() else 31
    out[: len(points)] = found
    return out


def labels(spans: list[Span], width: int, kinds: tuple[str, ...]) -> np.ndarray:
    out = np.zeros(width, np.int64)
    for kind, start, end in spans:
        k = kinds.index(kind)
        out[start:end] = 2 + 2 * k
        out[start : start + 1] = 1 + 2 * k
    return out


def spans_of(path: np.ndarray, kinds: tuple[str, ...]) -> list[Span]:
    """The spans of one label sequence."""
    out, start = [], None
    for i, y in enumerate([*path.tolist(), 0]):
        if start is not None and (y == 0 or y % 2 == 1):
            out.append((kinds[(path[start] - 1) // 2], start, i))
            start = None
        if y % 2 == 1:
            start = i
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def allowed(k: int) -> np.ndarray:
    """0 where label j may follow label i, else a large negative number; row k is the start."""
    n = 1 + 2 * k
    out = np.zeros((n + 1, n), np.float32)
    for j in range(2, n, 2):
        out[:, j] = FORBIDDEN
        out[[j - 1, j], j] = 0
    return out


@dataclass
class Tagger:
    """Parameters by name: ``symbols`` (2, classes, 4H), ``cells`` (2, H, 4H), ``out`` (2H, labels), ``bias``, ``moves``."""

    kinds: tuple[str, ...]
    weights: dict[str, np.ndarray]

    def emissions(self, x: np.ndarray, kept: dict | None = None) -> np.ndarray:
        """Scores (T, B, labels) of windows (B, T) of classes; ``kept`` receives what the gradient needs."""
        w, (b, t) = self.weights, x.shape
        h_size = w["cells"].shape[1]
        both = np.stack([x.T, x.T[::-1]])  # direction, time, window
        h = np.zeros((2, b, h_size), np.float32)
        c = np.zeros_like(h)
        hidden = np.zeros((2, t, b, h_size), np.float32)
        store = {"gates": [], "cell": [], "tanh": [], "before": []}
        for s in range(t):
            z = np.stack([w["symbols"][d][both[d, s]] for d in (0, 1)]) + h @ w["cells"]
            ifo = sigmoid(z[:, :, : 3 * h_size])
            g = np.tanh(z[:, :, 3 * h_size :])
            i, f, o = ifo[:, :, :h_size], ifo[:, :, h_size : 2 * h_size], ifo[:, :, 2 * h_size :]
            if kept is not None:
                store["before"].append((h, c))
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            hidden[:, s] = h
            if kept is not None:
                store["gates"].append((i, f, o, g))
                store["tanh"].append(tc)
        joined = np.concatenate([hidden[0], hidden[1][::-1]], axis=2)
        if kept is not None:
            kept.update(store, both=both, joined=joined)
        return joined @ w["out"] + w["bias"]

    def decoded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best label sequences (B, T) and, for each place, how far the chosen label's score is above that of O."""
        e = self.emissions(x)
        moves = self.weights["moves"] + allowed(len(self.kinds))
        t, b, n = e.shape
        score = e[0] + moves[n]
        back = np.zeros((t, b, n), np.uint8)
        for s in range(1, t):
            options = score[:, :, None] + moves[:n][None]
            back[s] = options.argmax(axis=1)
            score = options.max(axis=1) + e[s]
        path = np.zeros((b, t), np.int64)
        path[:, -1] = score.argmax(axis=1)
        for s in range(t - 1, 0, -1):
            path[:, s - 1] = back[s][np.arange(b), path[:, s]]
        scores = e.transpose(1, 0, 2)
        return path, np.take_along_axis(scores, path[:, :, None], 2)[:, :, 0] - scores[:, :, 0]

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of label sequences ``y`` (B, T) and its gradient by name."""
        w, (b, t) = self.weights, x.shape
        kept: dict = {}
        e = self.emissions(x, kept)
        n = e.shape[2]
        moves = w["moves"] + allowed(len(self.kinds))
        # Forward and backward sums of the CRF as products, each place brought to the sum 1.
        step, top = np.exp(moves[:n]), e.max(axis=2, keepdims=True)
        weight = np.exp(e - top)
        forward, backward = np.empty_like(e), np.ones_like(e)
        sums = np.empty((t, b, 1), e.dtype)
        forward[0] = np.exp(moves[n]) * weight[0]
        for s in range(t):
            if s:
                forward[s] = (forward[s - 1] @ step) * weight[s]
            sums[s] = forward[s].sum(axis=1, keepdims=True)
            forward[s] /= sums[s]
        for s in range(t - 1, 0, -1):
            weight[s] *= backward[s] / sums[s]  # from here on what follows the move into s
            backward[s - 1] = weight[s] @ step.T
        total = (np.log(sums) + top)[:, :, 0].sum(axis=0)
        de = forward * backward
        dmoves = np.zeros_like(w["moves"])
        dmoves[n] = de[0].sum(axis=0)
        dmoves[:n] = step * (forward[:-1].reshape(-1, n).T @ weight[1:].reshape(-1, n))
        rows, times = np.arange(b)[:, None], np.arange(t)[None, :]
        gold = e[times, rows, y].sum(axis=1) + moves[n][y[:, 0]] + moves[y[:, :-1], y[:, 1:]].sum(axis=1)
        de[times, rows, y] -= 1
        np.add.at(dmoves, (np.full(b, n), y[:, 0]), -1)
        np.add.at(dmoves, (y[:, :-1].ravel(), y[:, 1:].ravel()), -1)
        de /= b
        grads = {"moves": dmoves / b, "bias": de.sum(axis=(0, 1))}
        joined = kept["joined"]
        grads["out"] = joined.reshape(t * b, -1).T @ de.reshape(t * b, n)
        dj = de @ w["out"].T
        h_size = w["cells"].shape[1]
        dh_out = np.stack([dj[:, :, :h_size], dj[::-1, :, h_size:]])
        dz_all = np.zeros((2, t, b, 4 * h_size), np.float32)
        dcells = np.zeros_like(w["cells"])
        dh, dc = np.zeros((2, b, h_size), np.float32), np.zeros((2, b, h_size), np.float32)
        for s in range(t - 1, -1, -1):
            i, f, o, g = kept["gates"][s]
            h0, c0 = kept["before"][s]
            tc = kept["tanh"][s]
            dh = dh + dh_out[:, s]
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=2)
            dz_all[:, s] = dz
            dcells += h0.transpose(0, 2, 1) @ dz
            dh = dz @ w["cells"].transpose(0, 2, 1)
            dc = dc * f
        grads["cells"] = dcells
        dsymbols = np.zeros_like(w["symbols"])
        for d in (0, 1):
            hot = np.zeros((t * b, w["symbols"].shape[1]), np.float32)
            hot[np.arange(t * b), kept["both"][d].ravel()] = 1
            dsymbols[d] = hot.T @ dz_all[d].reshape(t * b, -1)
        grads["symbols"] = dsymbols
        return float((total - gold).mean()), grads


def started(kinds: tuple[str, ...], hidden: int = HIDDEN, seed: int = 7) -> Tagger:
    rng = np.random.default_rng(seed)
    n = 1 + 2 * len(kinds)
    draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[-2])).astype(np.float32)
    symbols = draw(2, CLASSES, 4 * hidden) * 3
    symbols[:, :, hidden : 2 * hidden] += 1
    weights = {
        "symbols": symbols, "cells": draw(2, hidden, 4 * hidden), "out": draw(2 * hidden, n),
        "bias": np.zeros(n, np.float32), "moves": np.zeros((n + 1, n), np.float32),
    }
    weights["bias"][0] = 2
    return Tagger(tuple(kinds), weights)


def train(examples: list[tuple[str, list[Span]]], kinds: tuple[str, ...], width: int, epochs: int = EPOCHS, seed: int = 7) -> Tagger:
    """A tagger fitted to texts of up to ``width`` characters with their spans; the same examples give the same tagger."""
    tagger = started(kinds, seed=seed)
    x = np.stack([classes(t, width) for t, _ in examples])
    y = np.stack([labels([(k, s, min(e, width)) for k, s, e in spans if s < width], width, kinds) for _, spans in examples])
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in tagger.weights.items()}
    second = {k: np.zeros_like(v) for k, v in tagger.weights.items()}
    step, steps = 0, epochs * -(-len(x) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            _, grads = tagger.gradient(x[some], y[some])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            step += 1
            rate = RATE * (1 - step / (steps + 1))
            for k, g in grads.items():
                g = g * min(1.0, 5.0 / (norm + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.98 * second[k] + 0.02 * g * g
                move = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.98**step)) + 1e-8)
                tagger.weights[k] = (tagger.weights[k] - rate * move).astype(np.float32)
    return tagger
