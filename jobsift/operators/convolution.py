"""A convolutional text classifier in numpy, trained in parallel on all partitions.

Rows come from encode.tokens or encode.wordpieces (input_ids, padding 0), with label_id and loss_weight. As a filter's sum over a
window is a sum of one number for each of its tokens, those numbers are tabled by token once and looked up, and as only
the largest sum of a filter counts, gradients flow to that window alone. Every epoch each worker trains on its own rows
from the same weights; the weights of all are averaged block by block on the executors, so the driver gets one
model and nothing else.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle, inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.stages import settled
from . import model_store

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have this package
Weights = dict[str, np.ndarray]
#: Numbers in a block of weights that one task averages.
BLOCK = 1 << 16
#: Window sums that are in memory at once: what a core's cache holds.
NUMBERS = 1 << 17


def initial(vocabulary: int, classes: int, width: int = 100, filters: int = 32, kernel: int = 3, hidden: int = 250, seed: int = 42) -> Weights:
    """Random weights: embedding, one convolution, two linear layers. Token 0 is padding and stays zero."""
    rng = np.random.default_rng(seed)
    even = lambda fan, *shape: rng.uniform(-(fan**-0.5), fan**-0.5, shape).astype(np.float32)
    words = rng.standard_normal((vocabulary, width)).astype(np.float32)
    words[0] = 0
    return {
        "words": words, "look": even(kernel * width, kernel, width, filters), "look_bias": even(kernel * width, filters),
        "mid": even(filters, filters, hidden), "mid_bias": even(filters, hidden), "out": even(hidden, hidden, classes), "out_bias": even(hidden, classes),
    }


def _best(tables: list[np.ndarray], ids: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """The largest window sum of each filter in each row, before the bias, and if wanted the first place that has it."""
    n, length = ids.shape
    half, filters = len(tables) // 2, tables[0].shape[1]
    wide = np.pad(ids, ((0, 0), (half, half)))
    rows = max(1, NUMBERS // (length * filters))
    best, at = np.empty((n, filters), tables[0].dtype), np.zeros((n, filters), np.int64) if places else None
    room, more = (np.empty((min(rows, n) * length, filters), tables[0].dtype) for _ in range(2))
    for a in range(0, n, rows):
        part = wide[a : a + rows]
        sums, add = room[: len(part) * length], more[: len(part) * length]
        for k, t in enumerate(tables):
            np.take(t, part[:, k : k + length].ravel(), axis=0, out=add if k else sums, mode="clip")  # ids are within the table
            if k:
                sums += add
        sums = sums.reshape(len(part), length, filters)
        if places:
            at[a : a + rows] = sums.argmax(axis=1)
            best[a : a + rows] = np.take_along_axis(sums, at[a : a + rows, None], axis=1)[:, 0]
            continue
        while sums.shape[1] > 1:  # halves against each other; what is in the middle may be met twice
            half_way = (sums.shape[1] + 1) // 2
            sums = np.maximum(sums[:, :half_way], sums[:, sums.shape[1] - half_way :])
        best[a : a + rows] = sums[:, 0]
    return best, at


def _tables(w: Weights) -> list[np.ndarray]:
    return [w["words"] @ k for k in w["look"]]


def scores(w: Weights, ids: np.ndarray, tables: list[np.ndarray] | None = None) -> np.ndarray:
    """Log probabilities of the classes for each row of ids."""
    seen = np.maximum(_best(tables or _tables(w), ids)[0] + w["look_bias"], 0)
    return log_softmax(np.maximum(seen @ w["mid"] + w["mid_bias"], 0) @ w["out"] + w["out_bias"])


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def gradients(w: Weights, ids: np.ndarray, label: np.ndarray, weight: np.ndarray, drop: np.ndarray | None = None) -> tuple[float, Weights]:
    """The weighted mean loss of a batch and its gradients. drop: factors of the hidden layer, 0 for what is left out."""
    known, own, wide = _own_words(w, ids)
    best, at = _best([own @ k for k in w["look"]], wide, True)
    seen = best + w["look_bias"]
    fired = np.maximum(seen, 0)
    inner = fired @ w["mid"] + w["mid_bias"]
    kept = np.maximum(inner, 0) * (1 if drop is None else drop)
    said = log_softmax(kept @ w["out"] + w["out_bias"])
    share = (weight / weight.sum()).astype(w["out"].dtype)
    row = np.arange(len(ids))
    loss = float(-(said[row, label] * share).sum())
    d = np.exp(said)
    d[row, label] -= 1
    d *= share[:, None]
    g = {"out": kept.T @ d, "out_bias": d.sum(axis=0)}
    d = (d @ w["out"].T) * (inner > 0) * (1 if drop is None else drop)
    g |= {"mid": fired.T @ d, "mid_bias": d.sum(axis=0)}
    d = (d @ w["mid"].T) * (seen > 0)
    g["look_bias"] = d.sum(axis=0)
    g["words"], g["look"] = np.zeros_like(w["words"]), np.empty_like(w["look"])
    half, filters = len(w["look"]) // 2, np.arange(d.shape[1])
    wide, moved = np.pad(wide, ((0, 0), (half, half))), np.zeros_like(own)
    for k, look in enumerate(w["look"]):
        token = np.take_along_axis(wide, at + k, axis=1)  # of each row and filter
        flow = np.bincount((token * len(filters) + filters).ravel(), d.ravel(), len(known) * len(filters)).reshape(len(known), -1).astype(d.dtype)
        g["look"][k] = own.T @ flow
        moved += flow @ look.T
    g["words"][known] = moved
    g["words"][0] = 0
    return loss, g


def _own_words(w: Weights, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of a batch, padding first, their embeddings, and the ids as places among them."""
    there = np.zeros(len(w["words"]), bool)
    there[ids] = there[0] = True
    known = np.flatnonzero(there)
    place = np.zeros(len(there), np.int64)
    place[known] = np.arange(len(known))
    return known, w["words"][known], place[ids]


@dataclass(frozen=True)
class Net:
    """What is trained: scores(weights, ids, ready), gradients(weights, ids, label, weight, drop) with drop as wide as
    the rows of weights["out"], and ready(weights), what many calls of scores share."""

    scores: Callable[..., np.ndarray]
    gradients: Callable[..., tuple[float, Weights]]
    ready: Callable[[Weights], object]


CNN = Net(scores, gradients, _tables)


class _Adam:
    """Adam with clipped gradients on all weights as one vector; w's arrays become parts of it."""

    def __init__(self, w: Weights, rate: float, clip: float) -> None:
        self.rate, self.clip, self.n = rate, clip, 0
        self.flat = _flat(w)
        w.update(_parts(self.flat, w))
        self.first, self.second, self.room = (np.zeros_like(self.flat) for _ in range(3))

    def step(self, g: Weights) -> None:
        self.n += 1
        x, room = _flat(g), self.room
        norm = float(np.sqrt(np.dot(x, x)))
        x *= min(1.0, self.clip / (norm + 1e-6))
        np.subtract(x, self.first, out=room)
        room *= 0.1
        self.first += room
        x *= x
        x -= self.second
        x *= 0.001
        self.second += x
        np.divide(self.second, 1 - 0.999**self.n, out=x)
        np.sqrt(x, out=x)
        x += 1e-8
        np.divide(self.first, x, out=room)
        room *= self.rate / (1 - 0.9**self.n)
        self.flat -= room


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = batch.column("input_ids")
    ids = np.frombuffer(b"".join(ids.to_pylist()), np.int32) if pa.types.is_binary(ids.type) else ids.flatten().to_numpy()
    return ids.reshape(batch.num_rows, -1), batch.column("label_id").to_numpy(), batch.column("loss_weight").to_numpy()


def _flat(w: Weights) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in sorted(w)])


def _parts(flat: np.ndarray, like: Weights) -> Weights:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


def _shaped(flat: np.ndarray, like: Weights) -> Weights:
    return {k: v.astype(np.float32) for k, v in _parts(flat, like).items()}


def _epoch(net: Net, w: Weights, rate: float, clip: float, size: int, dropout: float, seed: int):
    """Train on a worker's rows; its weights times its rows' weight, in blocks, as (block, weight, data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rng, mass = {k: v.copy() for k, v in w.items()}, np.random.default_rng(seed), 0.0
        steps = _Adam(own, rate, clip)
        for whole in batches:
            for at in range(0, whole.num_rows, size):
                ids, label, weight = _arrays(whole.slice(at, size))
                if weight.sum() <= 0:
                    continue
                drop = ((rng.random((len(ids), len(own["out"]))) >= dropout) / (1 - dropout)).astype(np.float32) if dropout else None
                steps.step(net.gradients(own, ids, label, weight, drop)[1])
                mass += float(weight.sum())
        if mass:
            flat = _flat(own).astype(np.float64) * mass
            for k, a in enumerate(range(0, len(flat), BLOCK)):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([mass]), pa.array([flat[a : a + BLOCK].tobytes()], pa.binary())], names=["block", "mass", "data"])

    return run


def _average(part: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(x, np.float64) for x in part["data"])
    return pd.DataFrame({"block": part["block"].iloc[:1], "data": [(total / part["mass"].sum()).tobytes()]})


def _usable(df: DataFrame) -> DataFrame:
    return df.filter("input_ids is not null and label_id is not null and loss_weight is not null")


def loss(df: DataFrame, w: Weights, net: Net = CNN) -> float | None:
    """The weighted mean loss over all rows; None without rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = net.ready(w)
        for batch in batches:
            if batch.num_rows:
                ids, label, weight = _arrays(batch)
                each = -net.scores(w, ids, ready)[np.arange(len(ids)), label] * weight
                yield pa.RecordBatch.from_arrays([pa.array([float(each.sum())]), pa.array([float(weight.sum())])], names=["loss", "weight"])

    return _usable(df).select("input_ids", "label_id", F.col("loss_weight").cast("double")).mapInArrow(run, "loss double, weight double").agg(F.sum("loss") / F.sum("weight")).first()[0]


def deal(train: DataFrame, key: str, workers: int | None = None, seed: int = 42) -> DataFrame:
    """The rows to train on, dealt to workers by a hash of the key, once: as many as there are cores if none are given. What
    fit() does with them is then the same however often they are read. Rows with nulls are left out."""
    rows = _usable(train).select(F.col(key).alias("key"), "input_ids", "label_id", F.col("loss_weight").cast("double"))
    rows = rows.repartition(workers or train.sparkSession.sparkContext.defaultParallelism, F.xxhash64(F.lit(seed), "key"))
    packed = T.StructType([T.StructField("input_ids", T.BinaryType()) if x.name == "input_ids" else x for x in rows.schema])
    return settled(rows.mapInArrow(_packed, packed))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with their ids as bytes, which Spark sorts and sends in one piece."""
    for batch in batches:
        ids = [x.values.to_numpy().astype(np.int32).tobytes() for x in batch.column("input_ids")]
        at = batch.schema.get_field_index("input_ids")
        yield batch.set_column(at, "input_ids", pa.array(ids, pa.binary()))


def fit(train: DataFrame, valid: DataFrame, w: Weights, key: str, epochs: int = 10, rate: float = 1e-3, size: int = 32, patience: int = 3, clip: float = 1.0, dropout: float = 0.0, workers: int | None = None, seed: int = 42, net: Net = CNN) -> tuple[Weights, list[float]]:
    """The weights of the epoch with the least validation loss, and the loss after each epoch. It ends when patience epochs
    in a row bring nothing; the rate falls linearly to zero. The validation rows should be stored, for each epoch reads
    them again; those to train on are dealt() once. Without any row the weights stay as they are."""
    return fit_dealt(deal(train, key, workers, seed), valid, w, epochs, rate, size, patience, clip, dropout, seed, net)


def fit_dealt(dealt: DataFrame, valid: DataFrame, w: Weights, epochs: int = 10, rate: float = 1e-3, size: int = 32, patience: int = 3, clip: float = 1.0, dropout: float = 0.0, seed: int = 42, net: Net = CNN) -> tuple[Weights, list[float]]:
    """fit() on rows that deal() has dealt. Each epoch has its own order of a worker's rows, by a hash of the key."""
    best, losses, since = (w, float("inf")), [], 0
    for epoch in range(epochs):
        rows = dealt.sortWithinPartitions(F.xxhash64(F.lit(seed + epoch), "key"), "key").drop("key")
        told = rows.mapInArrow(_epoch(net, w, rate * (1 - epoch / epochs), clip, size, dropout, seed + epoch), "block int, mass double, data binary")
        blocks = told.groupBy("block").applyInPandas(_average, "block int, data binary").collect()  # one model
        if not blocks:
            break
        w = _shaped(np.concatenate([np.frombuffer(r.data, np.float64) for r in sorted(blocks, key=lambda r: r.block)]), w)
        now = loss(valid, w, net)
        if now is None:
            best = (w, now)
            continue
        losses.append(now)
        if now < best[1]:
            best, since = (w, now), 0
        elif (since := since + 1) >= patience:
            break
    return best[0], losses


def grid_search(
    train: DataFrame,
    valid: DataFrame,
    start: Callable[[int], Weights],
    key: str,
    path: str,
    hidden: Sequence[int] = (25, 50, 100),
    dropout: Sequence[float] = (0.1, 0.2, 0.5),
    at_once: int = 3,
    **options,
) -> DataFrame:
    """(point, hidden, dropout, loss, epochs) of each grid point: report.best_run() picks one, and load(point_path(path,
    point)) gives its weights. start(width of the hidden layer) makes the weights to begin with.

    All points train on rows that are dealt once. at_once of them run at a time, each in a scheduler pool of its own, so
    that with spark.scheduler.mode FAIR they share the cores evenly. A point that the store has, from a run that was cut
    off, isn't trained again."""
    spark = train.sparkSession
    dealt = deal(train, key, options.pop("workers", None), options.get("seed", 42))
    points = [(k, h, float(d)) for k, (h, d) in enumerate(product(hidden, dropout))]

    def run(point: tuple[int, int, float]) -> None:
        k, h, d = point
        if not model_store.epochs(point_path(path, k)):
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"grid-{k}")
            w, losses = fit_dealt(dealt, valid, start(h), dropout=d, **options)
            save(spark, w | {"_losses": np.array(losses)}, point_path(path, k))

    with ThreadPoolExecutor(at_once) as pool:
        list(pool.map(inheritable_thread_target(spark)(run), points))
    seen = [(load(point_path(path, k), names=["_losses"]).get("_losses", np.zeros(0)), k, h, d) for k, h, d in points]
    return spark.createDataFrame([(k, h, d, float(x.min()) if len(x) else None, len(x)) for x, k, h, d in seen], "point int, hidden int, dropout double, loss double, epochs int")


def point_path(path: str, point: int) -> str:
    return f"{path.rstrip('/')}/point-{point:03d}"


def predict(df: DataFrame, w: Weights, net: Net = CNN) -> DataFrame:
    """Add scores, the log probability of each class, and prediction, the likeliest; null where input_ids is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = net.ready(w)
        for batch in batches:
            ids = batch.column("input_ids")
            there = np.flatnonzero(ids.is_valid().to_numpy(zero_copy_only=False))
            said: list = [None] * batch.num_rows
            if len(there):
                for i, x in zip(there, net.scores(w, ids.flatten().to_numpy().reshape(len(there), -1), ready), strict=True):
                    said[i] = x
            best = pa.array([None if x is None else int(x.argmax()) for x in said], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(said, pa.list_(pa.float32())), best], names=[*batch.schema.names, "scores", "prediction"])

    df = df.drop("scores", "prediction")
    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("scores", T.ArrayType(T.FloatType())), T.StructField("prediction", T.LongType())]))


def save(spark: SparkSession, w: Weights, path: str, epoch: int = 0) -> None:
    """Commit the weights as an epoch of the model store at a path."""
    model_store.save(spark, w, path, epoch)


def load(path: str, epoch: int | None = None, names: list[str] | None = None) -> Weights:
    """The weights of an epoch of a store, the last if none is named; without names those that a model has."""
    found = model_store.load(path, epoch, names)
    return found if names else {k: v for k, v in found.items() if not k.startswith("_")}
