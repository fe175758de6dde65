"""Many linear classifiers at once: a whole grid of penalties, trained in step on one scan of the data.

The models of all grid points lie side by side in one array, a row for each hashed character and columns for each
model and class. A step is one job: every task reads the weights from the model store, goes through its rows and adds
up its part of all models' gradients; the parts are summed block by block on executors, which also take the step and write the
new weights as the store's next epoch. So a step is that of one large batch whatever the number of workers, the
driver gets a loss for each model, a lost executor costs its tasks, and a lost driver goes on after the last epoch.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Config
from . import model_store
from .model_store import epochs, forget, load

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have this package
#: Rows that are multiplied at once.
ROWS = 256
#: Rows of the weights that one block holds, about.
BLOCK_ROWS = 512
_MULTIPLY = np.uint32(0x9E3779B1)


@dataclass(frozen=True)
class Grid:
    """The shape of the models, and a penalty and its share of absolute values for each."""

    features: int
    classes: int
    penalty: tuple[float, ...]
    share: tuple[float, ...]

    @property
    def models(self) -> int:
        return len(self.penalty)

    @property
    def width(self) -> int:
        return self.models * self.classes

    @classmethod
    def of(cls, cfg: Config, features: int, classes: int) -> Grid:
        points = list(product(cfg.grid.get("regParam", (0.0,)), cfg.grid.get("elasticNetParam", (0.0,))))
        return cls(features, classes, tuple(p for p, _ in points), tuple(s for _, s in points))


def hashed_counts(df: DataFrame, text: str, features: int) -> DataFrame:
    """Add places and counts, the hashed characters of the text and how often they are there. A null text has none. The
    text itself goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, counts = [], []
            for t in batch.column(batch.num_columns - 1).to_pylist():
                code = np.frombuffer((t or "").encode("utf-32-le"), np.uint32)
                at, n = np.unique((code * _MULTIPLY >> np.uint32(7)) % np.uint32(features), return_counts=True)
                places.append(at.astype(np.int32))
                counts.append(n.astype(np.float32))
            arrays = [pa.array(places, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], names=[*batch.schema.names[:-1], "places", "counts"])

    others = [c for c in df.columns if c not in (text, "places", "counts")]
    kept = df.select(*others)
    schema = T.StructType([*kept.schema.fields, T.StructField("places", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.FloatType()))])
    return df.select(*others, F.col(text).alias("_text")).mapInArrow(run, schema)


def rarity(train: DataFrame, features: int) -> np.ndarray:
    """The inverse document frequency of each place, as logarithms; a row for each place reaches the driver."""
    n = train.count()
    seen = np.zeros(features)
    for r in train.select(F.explode("places").alias("p")).groupBy("p").count().collect():
        seen[r.p] = r["count"]
    return np.log((n + 1) / (seen + 1))


def _matrices(batches: Iterator[pa.RecordBatch], idf: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches of rows with the places they have, and their values there, each row of length 1."""
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            batch = whole.slice(at, ROWS)
            lists, values = batch.column("places"), batch.column("counts").flatten().to_numpy()
            places = lists.flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), np.asarray(lists.value_lengths().fill_null(0)))
            used, place = np.unique(places, return_inverse=True)
            x = np.zeros((batch.num_rows, len(used)))
            x[row, place] = values * idf[places]
            x /= np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)
            yield batch, used, x


def _log_softmax(s: np.ndarray) -> np.ndarray:
    s = s - s.max(axis=2, keepdims=True)
    return s - np.log(np.exp(s).sum(axis=2, keepdims=True))


def _say(weights: np.ndarray, used: np.ndarray, x: np.ndarray, grid: Grid) -> np.ndarray:
    """Log probabilities, rows by models by classes. The last row of the weights is the bias."""
    return _log_softmax((x @ weights[used] + weights[-1]).reshape(len(x), grid.models, grid.classes))


def _gradient_parts(grid: Grid, idf: np.ndarray, path: str, epoch: int):
    """A task's part of the gradients as (block, data), and of the losses as block -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = load(path, epoch, ["ahead"])["ahead"]
        total, losses = np.zeros_like(weights), np.zeros(grid.models)
        for batch, used, x in _matrices(batches, idf):
            label, mass = batch.column("label_id").to_numpy(), batch.column("loss_weight").to_numpy()
            said = _say(weights, used, x, grid)
            row = np.arange(len(x))
            losses -= mass @ said[row, :, label]
            d = np.exp(said)
            d[row, :, label] -= 1
            d = (d * mass[:, None, None]).reshape(len(x), grid.width)
            total[used] += x.T @ d
            total[-1] += d.sum(axis=0)
        parts = [(-1, losses), *((k, total[a : a + BLOCK_ROWS]) for k, a in enumerate(range(0, len(total), BLOCK_ROWS)))]
        parts = [(k, x) for k, x in parts if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array([x.tobytes() for _, x in parts], pa.binary())], names=["block", "data"])

    return run


def _shrunk(w: np.ndarray, grid: Grid, step: np.ndarray, bias: bool) -> np.ndarray:
    """The step that the penalty of absolute values takes; a block's last row is the bias, which has no penalty."""
    size = np.repeat(np.array(grid.penalty) * np.array(grid.share) * step, grid.classes)
    out = np.sign(w) * np.maximum(np.abs(w) - size, 0)
    if bias:
        out[-1] = w[-1]
    return out


def _take_step(grid: Grid, path: str, epoch: int, mass: float):
    """Sum the parts of each block and take an accelerated proximal step: rows of the store's next epoch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = load(path, epoch)
        square = np.array(grid.penalty) * (1 - np.array(grid.share))
        step = 1 / (1 + square)  # rows have length 1, and 1 for the bias: the curvature is no more than 1
        rows, blocks = now["at"].shape[0], -(-now["at"].shape[0] // BLOCK_ROWS)
        t = float(now["time"][0])
        later = (1 + np.sqrt(1 + 4 * t * t)) / 2

        def out(block: int, total: np.ndarray) -> pa.RecordBatch:
            found: list[tuple[str, np.ndarray, list[int], int]]
            if block < 0:
                found = [("losses", total / mass, [grid.models], 0), ("time", np.array([later]), [1], 0)]
            else:
                a, z = block * BLOCK_ROWS, min(rows, (block + 1) * BLOCK_ROWS)
                at, ahead = now["at"][a:z], now["ahead"][a:z]
                g = total.reshape(at.shape) / mass
                slope = np.repeat(square, grid.classes) * ahead
                if block == blocks - 1:
                    slope[-1] = 0
                new = _shrunk(ahead - np.repeat(step, grid.classes) * (g + slope), grid, step, block == blocks - 1)
                found = [("at", new, [rows, grid.width], block), ("ahead", new + (t - 1) / later * (new - at), [rows, grid.width], block)]
            columns = [[n for n, *_ in found], ["<f8"] * len(found), [s for *_, s, _ in found], [k for *_, k in found], [x.tobytes() for _, x, *_ in found]]
            kinds = [pa.string(), pa.string(), pa.list_(pa.int64()), pa.int32(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["name", "kind", "shape", "block", "data"])

        last: int | None = None
        total = np.zeros(0)
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if block != last:
                    if last is not None:
                        yield out(last, total)
                    size = grid.models if block < 0 else (min(rows, (block + 1) * BLOCK_ROWS) - block * BLOCK_ROWS) * grid.width
                    last, total = block, np.zeros(size)
                if data:
                    total += np.frombuffer(data)
        if last is not None:
            yield out(last, total)

    return run


def fit(train: DataFrame, grid: Grid, idf: np.ndarray, path: str, max_iter: int = 25, tolerance: float = 1e-4) -> list[float]:
    """Train all models of the grid, and leave them in the store at path; the losses of the last epoch before the end. It
    ends after max_iter steps, or when no model's loss has fallen by more than tolerance of it.

    train: label_id, loss_weight, places and counts of the rows, which should be stored, for each step reads them. Rows
    with a null label or weight are left out; without any row nothing is learned. A store that has epochs is
    trained on from the last; it should hold the same grid."""
    spark = train.sparkSession
    rows = train.filter("label_id is not null and loss_weight is not null and places is not null")
    rows = rows.select(F.col("label_id").cast("long"), F.col("loss_weight").cast("double"), "places", "counts")
    mass = rows.agg(F.sum("loss_weight")).first()[0] or 0.0
    if not epochs(path):
        zero = np.zeros((grid.features + 1, grid.width))
        model_store.save(spark, {"at": zero, "ahead": zero, "time": np.ones(1), "losses": np.full(grid.models, np.inf)}, path)
    blocks = -(-(grid.features + 1) // BLOCK_ROWS)
    every = spark.range(-1, blocks, 1, 1).select(F.col("id").cast("int").alias("block"), F.lit(None).cast("binary").alias("data"))
    losses = load(path, names=["losses"])["losses"]
    while mass > 0 and (epoch := epochs(path)[-1]) < max_iter:
        parts = rows.mapInArrow(_gradient_parts(grid, idf, path, epoch), "block int, data binary").unionByName(every)
        dealt = parts.repartition("block").sortWithinPartitions("block")
        model_store.write(dealt.mapInArrow(_take_step(grid, path, epoch, mass), model_store.SCHEMA), path, epoch + 1)
        forget(path, 2)
        before, losses = losses, load(path, epoch + 1, ["losses"])["losses"]
        if np.all(before - losses <= tolerance * losses) and np.isfinite(before).all():
            break
    return [float(x) for x in losses]


def run_table(valid: DataFrame, grid: Grid, idf: np.ndarray, path: str) -> DataFrame:
    """(model, regParam, elasticNetParam, loss, accuracy) of every model on the rows of a table, in one scan of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = load(path, names=["at"])["at"]
        lost, right, mass, n = np.zeros(grid.models), np.zeros(grid.models, np.int64), 0.0, 0
        for batch, used, x in _matrices(batches, idf):
            label, own = batch.column("label_id").to_numpy(), batch.column("loss_weight").to_numpy()
            said = _say(weights, used, x, grid)
            lost -= own @ said[np.arange(len(x)), :, label]
            right += (said.argmax(axis=2) == label[:, None]).sum(axis=0)
            mass, n = mass + float(own.sum()), n + len(x)
        if n:
            columns = [np.arange(grid.models), lost, right, np.full(grid.models, mass), np.full(grid.models, n)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["model", "lost", "right", "mass", "n"])

    rows = valid.filter("label_id is not null and loss_weight is not null and places is not null")
    rows = rows.select(F.col("label_id").cast("long"), F.col("loss_weight").cast("double"), "places", "counts")
    told = rows.mapInArrow(run, "model long, lost double, right long, mass double, n long").groupBy("model")
    told = told.agg((F.sum("lost") / F.sum("mass")).alias("loss"), (F.sum("right") / F.sum("n")).alias("accuracy"))
    points = valid.sparkSession.createDataFrame([*zip(range(grid.models), grid.penalty, grid.share, strict=True)], "model long, regParam double, elasticNetParam double")
    return points.join(told, "model").select("model", "regParam", "elasticNetParam", "loss", "accuracy")


def predict(df: DataFrame, grid: Grid, idf: np.ndarray, path: str, model: int) -> DataFrame:
    """Add probability, of each class, and prediction, the likeliest, by one of the models. Rows without places are told
    by the bias alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = slice(model * grid.classes, (model + 1) * grid.classes)
        weights = load(path, names=["at"])["at"][:, own]
        one = Grid(grid.features, grid.classes, grid.penalty[:1], grid.share[:1])
        for batch, used, x in _matrices(batches, idf):
            said = _say(weights, used, x, one)[:, 0]
            arrays = [pa.array(list(np.exp(said)), pa.list_(pa.float64())), pa.array(said.argmax(axis=1))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, "probability", "prediction"])

    df = df.drop("probability", "prediction")
    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("probability", T.ArrayType(T.DoubleType())), T.StructField("prediction", T.LongType())]))
