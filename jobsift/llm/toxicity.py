"""Toxicity by a classifier chain.

Categories are predicted in a fixed order by linear models over hashed words; each model also gets the
log odds of the categories before it. While fitting, those come from out-of-fold predictions, so that a
later model sees earlier probabilities as wrong as they will be on new texts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, schema_with, ship
from .shingles import word_hashes

BUCKETS = 1 << 20
#: Labelled rows that a model is fitted on at most (about; a hash of the id picks them).
TRAIN_DOCS = 12_000
#: A text with more distinct words than this teaches nothing, so that the driver gets 3 GB of words at the very most,
#: and about a hundredth of that from ordinary texts. It is classified like any other.
TRAIN_WORDS = 1 << 16
FOLDS = 5
RIDGE = 0.1
#: A word (bucket) has a weight in a model if its chi-square with the label is at least this: rare words that meet
#: a label by chance have less. All words that pass it are used, a bucket each, BUCKETS at most.
LEAST_CHI = 25.0
ROUNDS = 12
#: Bytes between words: ASCII other than letters and digits.
GAP = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def words_of(texts: Sequence[str | None]) -> list[np.ndarray]:
    """Distinct word buckets of each text."""
    w, at = word_hashes(texts, GAP)
    w = (w >> np.uint64(44)).astype(np.int32)
    return [np.unique(w[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = pa.array([w.tobytes() for w in words_of(batch.column(0).to_pylist())], pa.binary())
        yield pa.RecordBatch.from_arrays([words, *batch.columns[1:]], names=["_words", *batch.schema.names[1:]])


def _telling(x: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """The buckets whose chi-square with the label is large enough."""
    n, pos = len(y), float(y.sum())
    flat = np.concatenate(x) if len(x) else np.zeros(0, np.int32)
    df = np.bincount(flat, minlength=BUCKETS).astype(float)
    hit = np.bincount(flat, weights=np.repeat(y, [len(r) for r in x]), minlength=BUCKETS)
    wanted = df * pos / n
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = np.where((df >= 3) & (wanted > 0), (hit - wanted) ** 2 / (wanted * (1 - df / n + 1e-9) * (1 - pos / n + 1e-9)), 0.0)
    return np.flatnonzero(chi >= LEAST_CHI)


@dataclass(frozen=True)
class LinearModel:
    """Weights of a few buckets, of earlier categories' log odds, and a constant."""

    buckets: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    constant: float


def _fit_one(x: list[np.ndarray], earlier: np.ndarray, y: np.ndarray) -> LinearModel:
    """Ridge logistic regression by Newton steps with conjugate gradients."""
    if y.sum() in (0, len(y)):
        rate = (y.sum() + 0.5) / (len(y) + 1)
        return LinearModel(np.zeros(0, np.int32), np.zeros(0), np.zeros(earlier.shape[1]), float(np.log(rate / (1 - rate))))
    keep = _telling(x, y)
    place = np.full(BUCKETS, -1, np.int32)
    place[keep] = np.arange(len(keep), dtype=np.int32)
    rows, cols = [], []
    for i, r in enumerate(x):
        c = place[r]
        c = c[c >= 0]
        cols.append(c)
        rows.append(np.full(len(c), i, np.int32))
    row, col = np.concatenate(rows), np.concatenate(cols)
    n, k, m = len(y), len(keep), earlier.shape[1]
    ridge = np.concatenate((np.full(k, RIDGE), np.full(m, 0.1), [1e-6]))

    def forward(w: np.ndarray) -> np.ndarray:
        return np.bincount(row, weights=w[:k][col], minlength=n) + earlier @ w[k : k + m] + w[-1]

    def backward(r: np.ndarray) -> np.ndarray:
        return np.concatenate((np.bincount(col, weights=r[row], minlength=k), earlier.T @ r, [r.sum()]))

    w = np.zeros(k + m + 1)
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(forward(w), -30, 30)))
        grad = backward(p - y) + ridge * w
        if np.abs(grad).max() < 1e-5 * n:
            break
        curve = np.maximum(p * (1 - p), 1e-6)
        step, res = np.zeros_like(w), -grad
        way, norm = res.copy(), res @ res
        for _ in range(15):
            seen = backward(curve * forward(way)) + ridge * way
            size = norm / (way @ seen)
            step += size * way
            res = res - size * seen
            new = res @ res
            if new < 1e-3 * (grad @ grad):
                break
            way, norm = res + new / norm * way, new
        w += step
    return LinearModel(keep.astype(np.int32), w[:k], w[k : k + m], float(w[-1]))


def _odds(model: LinearModel, x: list[np.ndarray], earlier: np.ndarray) -> np.ndarray:
    table = np.zeros(BUCKETS)
    table[model.buckets] = model.weights
    return np.clip(np.array([table[r].sum() for r in x]) + earlier @ model.earlier + model.constant, -30, 30)


@dataclass(frozen=True)
class ToxicityChain:
    categories: tuple[str, ...]
    models: tuple[LinearModel, ...]
    cutoffs: tuple[float, ...]  # of the probability, best F1 out of fold

    def score(self, texts: Sequence[str | None]) -> np.ndarray:
        """Probabilities, a row for each text and a column for each category."""
        if not len(texts):
            return np.zeros((0, len(self.models)))
        used = np.zeros(BUCKETS, bool)
        for m in self.models:
            used[m.buckets] = True
        w, at = word_hashes(texts, GAP)
        w = (w >> np.uint64(44)).astype(np.int32)
        x = [np.unique(r[used[r]]) for r in (w[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True))]
        odds = np.zeros((len(texts), 0))
        for m in self.models:
            odds = np.column_stack((odds, _odds(m, x, odds)))
        return 1 / (1 + np.exp(-odds))


def fit_chain(x: list[np.ndarray], labels: dict[str, np.ndarray], fold: np.ndarray) -> ToxicityChain:
    """Fit on the texts' words and 0/1 labels by category, in the order of the dict. fold: 0 to FOLDS - 1
    for each text."""
    out_of_fold, models, cutoffs = np.zeros((len(x), 0)), [], []
    for y in labels.values():
        y = np.asarray(y, float)
        own = np.zeros(len(x))
        for k in range(FOLDS):
            test, train = np.flatnonzero(fold == k), np.flatnonzero(fold != k)
            if len(test) and len(train):
                part = _fit_one([x[i] for i in train], out_of_fold[train], y[train])
                own[test] = _odds(part, [x[i] for i in test], out_of_fold[test])
        models.append(_fit_one(x, out_of_fold, y))
        cutoffs.append(_best_cutoff(1 / (1 + np.exp(-own)), y))
        out_of_fold = np.column_stack((out_of_fold, own))
    return ToxicityChain(tuple(labels), tuple(models), tuple(cutoffs))


def _best_cutoff(p: np.ndarray, y: np.ndarray) -> float:
    """The middle of the best range by F1, within 0.1 to 0.9."""
    tries = np.linspace(0.1, 0.9, 81)
    f1 = [2 * y[p >= t].sum() / max(1.0, (p >= t).sum() + y.sum()) for t in tries]
    return float(np.median(tries[np.array(f1) >= max(f1) - 1e-9]))


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, object], text: str = "text", key: str = "doc_id", train_docs: int = TRAIN_DOCS) -> ToxicityChain:
    """Fit on labelled documents. categories: for each, a boolean expression over the columns of labels;
    rows where one is null are left out. Of repeated labels of a document the largest counts, and of rows that
    repeat a labelled id one teaches, chosen by a hash of its words. Without labelled rows every probability is a half."""
    ship(docs.sparkSession)
    marked = labels.select(F.col(key).alias("_id"), *[e.cast("int").alias(c) for c, e in categories.items()]).dropna()
    marked = marked.groupBy("_id").agg(*[F.max(c).alias(c) for c in categories])
    n = marked.count()
    chance = F.pmod(F.xxhash64(F.lit(3), "_id"), F.lit(1_000_000)) / 1_000_000
    marked = marked.filter(chance < min(1.0, train_docs / max(1, n)))
    rows = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(marked), "_id")
    fold = F.pmod(F.xxhash64(F.lit(4), "_id"), F.lit(FOLDS)).cast("int").alias("_fold")
    rows = rows.select("_text", "_id", fold, *categories)
    kind = schema_with(rows.drop("_text").select(F.lit(b"").alias("_words"), "*"))
    bags = rows.mapInArrow(lean(_bag), kind).filter(F.octet_length("_words") <= 4 * TRAIN_WORDS)
    one = bags.groupBy("_id").agg(F.min(F.struct(F.xxhash64("_words").alias("_h"), "_words", "_fold", *categories)).alias("_one"))
    got = one.select("_id", "_one.*").toArrow()
    order = np.argsort(got.column("_id").to_numpy(), kind="stable")
    words = got.column("_words").to_pylist()
    return fit_chain([np.frombuffer(words[i], np.int32) for i in order], {c: got.column(c).to_numpy()[order] for c in categories}, got.column("_fold").to_numpy()[order])


def classify(docs: DataFrame, chain: ToxicityChain, text: str = "text") -> DataFrame:
    """Add p_<category> for each category and is_<category> (at or over the cutoff). A null or empty
    text has no words and so the constant's probability, and is in no category. Very long texts are read whole;
    rows that repeat get the same answer; an empty table gives an empty result. Other columns pass through;
    those named like a new one are replaced."""
    ship(docs.sparkSession)
    new = [*(f"p_{c}" for c in chain.categories), *(f"is_{c}" for c in chain.categories)]
    docs = docs.drop(*new)
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # BUCKETS weights a category at most, 12 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            p = shared.value.score(texts)
            some = np.array([bool(t) for t in texts], bool)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(c) for c in p.T), *(pa.array((c >= t) & some) for c, t in zip(p.T, shared.value.cutoffs, strict=True))],
                names=[*batch.schema.names, *new],
            )

    kinds = {n: "double" if n.startswith("p_") else "boolean" for n in new}
    return docs.mapInArrow(lean(run), schema_with(docs, **kinds))
