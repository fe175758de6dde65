"""A two-way recurrent text classifier (LSTM) in numpy, trained as the convolutional one is.

fit, loss and predict of convolution take NET and weights from initial(). A text is represented by the states after its
last token and, read backwards, after its first; padding, which is 0, leaves states as they are. Time and memory
of a batch grow with its longest text.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

from .convolution import Net, Weights, log_softmax

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have this package
#: Texts that are scored at once.
ROWS = 32


def initial(vocabulary: int, classes: int, width: int = 100, hidden: int = 128, layers: int = 2, seed: int = 42) -> Weights:
    """Random weights: embedding, layers of two directions (0 forwards, 1 backwards), a linear layer on both last states."""
    rng = np.random.default_rng(seed)
    even = lambda *shape: rng.uniform(-(hidden**-0.5), hidden**-0.5, shape).astype(np.float32)
    w = {"words": rng.standard_normal((vocabulary, width)).astype(np.float32), "out": even(2 * hidden, classes), "out_bias": even(classes)}
    w["words"][0] = 0
    for layer in range(layers):
        for way in (0, 1):
            name = f"{layer}.{way}."
            w |= {name + "in": even(2 * hidden if layer else width, 4 * hidden), name + "state": even(hidden, 4 * hidden), name + "bias": even(4 * hidden)}
    return w


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _steps(length: int, way: int) -> range:
    return range(length) if way == 0 else range(length - 1, -1, -1)


def _read(w: Weights, name: str, way: int, x: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict]:
    """States at all places and the last one, reading one way; and what the way back needs."""
    rows, length, size = *there.shape, w[name + "state"].shape[0]
    gates = x @ w[name + "in"] + w[name + "bias"]  # in, forget, new, out
    states, before, cells, cells_before = (np.zeros((rows, length, size), gates.dtype) for _ in range(4))
    h, c = np.zeros((2, rows, size), gates.dtype)
    for t in _steps(length, way):
        before[:, t], cells_before[:, t] = h, c
        z = gates[:, t] + h @ w[name + "state"]
        z[:, : 2 * size], z[:, 2 * size : 3 * size], z[:, 3 * size :] = _sigmoid(z[:, : 2 * size]), np.tanh(z[:, 2 * size : 3 * size]), _sigmoid(z[:, 3 * size :])
        gates[:, t] = z
        i, f, g, o = np.split(z, 4, axis=1)
        cells[:, t] = f * c + i * g
        now = there[:, t, None]
        h, c = np.where(now, o * np.tanh(cells[:, t]), h), np.where(now, cells[:, t], c)
        states[:, t] = h
    return states, h, {"gates": gates, "before": before, "cells": cells, "cells_before": cells_before, "x": x}


def _back(w: Weights, name: str, way: int, kept: dict, there: np.ndarray, d_states: np.ndarray, d_last: np.ndarray, g: Weights) -> np.ndarray:
    """Gradients of one direction's weights, put into g, and of its input."""
    dz = np.zeros_like(kept["gates"])
    dh, dc = d_last.copy(), np.zeros_like(d_last)
    for t in reversed(_steps(there.shape[1], way)):
        now = there[:, t, None]
        dh = dh + d_states[:, t]
        i, f, new, o = np.split(kept["gates"][:, t], 4, axis=1)
        top = np.tanh(kept["cells"][:, t])
        own = np.where(now, dh, 0)
        cell = np.where(now, dc, 0) + own * o * (1 - top * top)
        parts = [cell * new * i * (1 - i), cell * kept["cells_before"][:, t] * f * (1 - f), cell * i * (1 - new * new), own * top * o * (1 - o)]
        dz[:, t] = np.concatenate(parts, axis=1)
        dh = dz[:, t] @ w[name + "state"].T + np.where(now, 0, dh)
        dc = cell * f + np.where(now, 0, dc)
    flat = dz.reshape(-1, dz.shape[2])
    g[name + "in"] = kept["x"].reshape(len(flat), -1).T @ flat
    g[name + "state"] = kept["before"].reshape(len(flat), -1).T @ flat
    g[name + "bias"] = flat.sum(axis=0)
    return dz @ w[name + "in"].T


def _layers(w: Weights) -> int:
    return sum(k.endswith(".0.in") for k in w)


def _forward(w: Weights, ids: np.ndarray) -> tuple[np.ndarray, list[list[dict]], np.ndarray, np.ndarray]:
    """Both last states of the top layer, what the way back needs, the ids in use and where they are tokens."""
    ids = ids[:, : max(1, int((ids != 0).any(axis=0).nonzero()[0].max(initial=0)) + 1)]
    there = ids != 0
    x, kept = w["words"][ids], []
    for layer in range(_layers(w)):
        read = [_read(w, f"{layer}.{way}.", way, x, there) for way in (0, 1)]
        x = np.concatenate([r[0] for r in read], axis=2)
        kept.append([r[2] for r in read])
    return np.concatenate([r[1] for r in read], axis=1), kept, ids, there


def scores(w: Weights, ids: np.ndarray, ready: object = None) -> np.ndarray:
    """Log probabilities of the classes for each row of ids."""
    parts = [_forward(w, ids[a : a + ROWS])[0] for a in range(0, len(ids), ROWS)]
    return log_softmax(np.concatenate(parts) @ w["out"] + w["out_bias"])


def gradients(w: Weights, ids: np.ndarray, label: np.ndarray, weight: np.ndarray, drop: np.ndarray | None = None) -> tuple[float, Weights]:
    """The weighted mean loss of a batch and its gradients. drop: factors of the last states, 0 for what is left out."""
    last, kept, ids, there = _forward(w, ids)
    factor = 1 if drop is None else drop
    said = log_softmax((last * factor) @ w["out"] + w["out_bias"])
    share = (weight / weight.sum()).astype(w["out"].dtype)
    row = np.arange(len(ids))
    loss = float(-(said[row, label] * share).sum())
    d = np.exp(said)
    d[row, label] -= 1
    d *= share[:, None]
    g = {"out": (last * factor).T @ d, "out_bias": d.sum(axis=0)}
    d_last = np.split((d @ w["out"].T) * factor, 2, axis=1)
    d_states = np.zeros((*ids.shape, last.shape[1]), last.dtype)
    for layer in reversed(range(_layers(w))):
        each = np.split(d_states, 2, axis=2)
        d_states = sum(_back(w, f"{layer}.{way}.", way, kept[layer][way], there, each[way], d_last[way], g) for way in (0, 1))
        d_last = [np.zeros_like(x) for x in d_last]
    g["words"] = np.zeros_like(w["words"])
    np.add.at(g["words"], ids, d_states)
    g["words"][0] = 0
    return loss, g


NET = Net(scores, gradients, lambda w: None)
