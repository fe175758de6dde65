"""The grid of linear classifiers: gradients, steps, workers, resuming, and the store of models."""

import os
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from jobsift.config import Config
from jobsift.operators import linear, model_store, report
from pyspark.sql import functions as F


def rows_of(spark, n=240):
    words = ["ab ba", "cd dc", "ef fe"]
    rows = [(i, (words[i % 3] + " ") * (1 + i % 4) + words[(i * 7) % 3][: i % 2], i % 3, 1.0 + i % 2) for i in range(n)] + [(n, None, 1, 1.0), (n + 1, "", 2, 1.0), (n + 2, "ab", None, 1.0)]
    df = spark.createDataFrame(rows, "id long, text string, label_id long, loss_weight double")
    return linear.hashed_counts(df, "text", 64)


def dense(df, idf):
    rows = df.filter("label_id is not null").orderBy("id").collect()
    x = np.zeros((len(rows), len(idf) + 1))
    for out, r in zip(x, rows, strict=True):
        out[r.places] = np.array(r["counts"]) * idf[r.places]
        out /= max(np.sqrt((out * out).sum()), 1e-12)
    x[:, -1] = 1
    return x, np.array([r.label_id for r in rows]), np.array([r.loss_weight for r in rows])


def plain_fit(x, label, weight, penalty, share, steps, classes=3):
    """The same accelerated proximal steps for one model on dense rows."""
    at = ahead = np.zeros((x.shape[1], classes))
    t, losses = 1.0, []
    free = np.ones((x.shape[1], 1))
    free[-1] = 0
    for _ in range(steps):
        s = x @ ahead
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        losses.append(float(-(weight * np.log(p[np.arange(len(x)), label])).sum() / weight.sum()))
        d = p.copy()
        d[np.arange(len(x)), label] -= 1
        g = x.T @ (d * weight[:, None]) / weight.sum() + penalty * (1 - share) * ahead * free
        step = 1 / (1 + penalty * (1 - share))
        new = ahead - step * g
        small = np.sign(new) * np.maximum(np.abs(new) - step * penalty * share, 0)
        new = np.where(free > 0, small, new)
        later = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, at, t = new + (t - 1) / later * (new - at), new, later
    return at, losses


GRID = linear.Grid(64, 3, (0.001, 0.01, 0.1), (0.0, 0.25, 0.5))


def test_all_models_equal_plain_ones(spark, tmp_path):
    df = rows_of(spark)
    idf = linear.rarity(df, 64)
    x, label, weight = dense(df, idf)
    losses = linear.fit(df, GRID, idf, str(tmp_path / "m"), max_iter=6, tolerance=-9)
    got = model_store.load(str(tmp_path / "m"))["at"]
    for k, (penalty, share) in enumerate(zip(GRID.penalty, GRID.share, strict=True)):
        want, seen = plain_fit(x, label, weight, penalty, share, 6)
        assert np.allclose(got[:, 3 * k : 3 * k + 3], want, atol=1e-9) and losses[k] == pytest.approx(seen[-1])
    runs = {r.model: r for r in linear.run_table(df, GRID, idf, str(tmp_path / "m")).collect()}
    for k in range(3):
        s = x @ got[:, 3 * k : 3 * k + 3]
        said = s - np.log(np.exp(s).sum(axis=1, keepdims=True))
        assert runs[k].accuracy == pytest.approx((s.argmax(axis=1) == label).mean())
        assert runs[k].loss == pytest.approx(-(said[np.arange(len(x)), label] * weight).sum() / weight.sum())
        assert (runs[k].regParam, runs[k].elasticNetParam) == (GRID.penalty[k], GRID.share[k])
    told = linear.predict(df, GRID, idf, str(tmp_path / "m"), 1).orderBy("id").collect()
    s = x @ got[:, 3:6]
    p = np.exp(s) / np.exp(s).sum(axis=1, keepdims=True)
    assert np.allclose([r.probability for r in told if r.label_id is not None], p) and len(told) == 243
    assert report.best_run(linear.run_table(df, GRID, idf, str(tmp_path / "m"))).first().loss == min(r.loss for r in runs.values())


def test_workers_do_not_change_a_step(spark, tmp_path):
    df = rows_of(spark).persist()
    idf = linear.rarity(df, 64)
    found = []
    for n in (1, 7, 40):
        linear.fit(df.repartition(n, "id"), GRID, idf, str(tmp_path / f"m{n}"), max_iter=3, tolerance=-9)
        found.append(model_store.load(str(tmp_path / f"m{n}"))["at"])
    assert np.allclose(found[0], found[1], atol=1e-12) and np.allclose(found[0], found[2], atol=1e-12) and np.abs(found[0]).max() > 0.1


def test_training_goes_on_after_the_last_epoch(spark, tmp_path):
    """A driver that is lost between steps, or while an epoch is written, comes to the same weights."""
    df = rows_of(spark).persist()
    idf = linear.rarity(df, 64)
    linear.fit(df, GRID, idf, str(tmp_path / "whole"), max_iter=5, tolerance=-9)
    path = str(tmp_path / "cut")
    linear.fit(df, GRID, idf, path, max_iter=3, tolerance=-9)
    os.makedirs(f"{path}/epoch-000004")
    with open(f"{path}/epoch-000004/part-0.parquet", "w") as f:
        f.write("half")
    assert model_store.epochs(path)[-1] == 3
    linear.fit(df, GRID, idf, path, max_iter=5, tolerance=-9)
    a, b = (model_store.load(str(tmp_path / x)) for x in ("whole", "cut"))
    assert model_store.epochs(path) == [4, 5] and np.allclose(a["at"], b["at"], atol=1e-12) and a["time"] == b["time"]


def test_a_step_reads_the_rows_once_for_all_models(spark, tmp_path, monkeypatch):
    rows_of(spark).write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    plans = []
    real = model_store.write
    monkeypatch.setattr(model_store, "write", lambda blocks, *a: (plans.append(blocks._jdf.queryExecution().executedPlan().toString()), real(blocks, *a)))
    grid = linear.Grid.of(replace(Config()), 64, 3)
    assert grid.models == 9
    linear.fit(df, grid, linear.rarity(df, 64), str(tmp_path / "m"), max_iter=2, tolerance=-9)
    steps = [p for p in plans if "MapInArrow" in p]
    assert len(steps) == 2 and all(p.count("Scan parquet") == 1 for p in steps)


def test_nothing_to_learn_from(spark, tmp_path):
    df = rows_of(spark)
    linear.fit(df.limit(0), GRID, np.zeros(64), str(tmp_path / "m"), max_iter=3)
    assert not model_store.load(str(tmp_path / "m"))["at"].any()
    assert linear.run_table(df.limit(0), GRID, np.zeros(64), str(tmp_path / "m")).count() == 0
    assert linear.predict(df.limit(0), GRID, np.zeros(64), str(tmp_path / "m"), 0).count() == 0


def test_store_keeps_names_shapes_and_kinds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(model_store, "BLOCK", 7)
    arrays = {"a": np.arange(60.0).reshape(5, 4, 3), "b": np.array([1, 2], np.int32), "c": np.zeros((0, 3), np.float32), "d": np.float64(3.5).reshape(())}
    path = str(tmp_path / "m")
    with pytest.raises(FileNotFoundError):
        model_store.load(path)
    for e in range(3):
        model_store.save(spark, arrays, path, e)
    got = model_store.load(path)
    assert set(got) == set(arrays) and all((got[k] == v).all() and got[k].shape == v.shape and got[k].dtype == v.dtype for k, v in arrays.items())
    assert set(model_store.load(path, 1, ["b"])) == {"b"}
    model_store.forget(path, 1)
    assert model_store.epochs(path) == [2]


def test_executors_read_the_store(spark, tmp_path):
    model_store.save(spark, {"w": np.arange(10.0)}, str(tmp_path / "m"))
    path, load = str(tmp_path / "m"), model_store.load

    def run(batches):
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([float(load(path)["w"].sum())])], names=["s"])

    assert spark.range(2).coalesce(1).mapInArrow(run, "s double").agg(F.max("s")).first()[0] == 45.0
