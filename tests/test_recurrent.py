"""The recurrent classifier: gradients against differences, reading against a plain cell, training."""

from __future__ import annotations

import numpy as np
import pytest

from jobsift.operators import convolution, recurrent

SMALL = {"vocabulary": 12, "classes": 3, "width": 4, "hidden": 5}
IDS = np.array([[3, 4, 5, 6, 0, 0], [7, 0, 0, 0, 0, 0], [2, 2, 9, 11, 10, 0], [0, 0, 0, 0, 0, 0]])


def doubles(w):
    return {k: v.astype(np.float64) for k, v in w.items()}


def plain_last(w, row):
    """Both last states of a text without its padding, cell by cell."""
    xs = [w["words"][i] for i in row if i]
    for layer in range(2):
        ways = []
        for way in (0, 1):
            h, c, out = np.zeros(5), np.zeros(5), []
            for x in xs if way == 0 else xs[::-1]:
                z = x @ w[f"{layer}.{way}.in"] + h @ w[f"{layer}.{way}.state"] + w[f"{layer}.{way}.bias"]
                i, f, o = (1 / (1 + np.exp(-z[k : k + 5])) for k in (0, 5, 15))
                c = f * c + i * np.tanh(z[10:15])
                h = o * np.tanh(c)
                out.append(h)
            ways.append((out if way == 0 else out[::-1], h))
        xs = [np.concatenate(p) for p in zip(ways[0][0], ways[1][0], strict=True)]
    return np.concatenate([ways[0][1], ways[1][1]])


def test_scores_equal_plain_cells():
    w = doubles(recurrent.initial(**SMALL))
    z = np.array([plain_last(w, row) for row in IDS]) @ w["out"] + w["out_bias"]
    assert np.allclose(recurrent.scores(w, IDS), z - np.log(np.exp(z).sum(axis=1, keepdims=True)))


def test_gradients_equal_differences():
    rng = np.random.default_rng(2)
    w = doubles(recurrent.initial(**SMALL))
    label, weight, drop = np.array([0, 2, 1, 1]), rng.random(4) + 0.5, (rng.random((4, 10)) > 0.3) / 0.7
    _, g = recurrent.gradients(w, IDS, label, weight, drop)
    assert sorted(g) == sorted(w)
    for name, value in w.items():
        for _ in range(20):
            at = tuple(rng.integers(0, n) for n in value.shape)
            if name == "words" and at[0] == 0:
                continue  # padding stays zero
            both = []
            for step in (1e-6, -1e-6):
                moved = w | {name: value.copy()}
                moved[name][at] += step
                both.append(recurrent.gradients(moved, IDS, label, weight, drop)[0])
            assert (both[0] - both[1]) / 2e-6 == pytest.approx(g[name][at], abs=1e-6)


def test_training_learns_order(spark):
    """Whether 2 comes before 3 can't be told from counts of tokens."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(240):
        ids = rng.integers(4, 8, 8)
        a, b = sorted(rng.choice(8, 2, replace=False))
        ids[a], ids[b] = (2, 3) if i % 2 else (3, 2)
        rows.append((i, [*ids.tolist(), 0, 0], i % 2, 1.0))
    df = spark.createDataFrame(rows, "doc_id long, input_ids array<int>, label_id long, loss_weight double")
    w, losses = convolution.fit(df.filter("doc_id < 200"), df.filter("doc_id >= 200"), recurrent.initial(8, 2, width=8, hidden=12), "doc_id", epochs=25, rate=0.02, size=10, workers=2, patience=25, net=recurrent.NET)
    said = convolution.predict(df.filter("doc_id >= 200"), w, recurrent.NET).collect()
    assert np.mean([r.label_id == r.prediction for r in said]) > 0.9 and min(losses) < 0.35
