"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of n-grams are gathered per language, smoothed into a matrix of log probabilities, and broadcast
(its size is fixed: buckets times languages, 128 KB each). Documents are scored in batches as sparse rows of n-gram
counts times that matrix, in numpy.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, lean, schema_with, ship, stage, unstage

BUCKETS = 1 << 15
ORDERS = (2, 3)
#: The model is fitted on about so many documents of each language, chosen by a hash of the id.
TRAIN_DOCS = 5_000
#: Products of n-grams and languages that are summed at once; bounds memory with many languages.
PRODUCTS = 4_000_000
SMOOTH = 0.5
UNDETERMINED = "und"
_MAYBE_LETTER = re.compile(r"[^\W\d_]")
_NO_WORD = re.compile(r"[\W\d_]+")
_MUL = np.uint32(0x9E3779B1)


def has_letter(text: str) -> bool:
    """Numbers such as fractions are word characters to a regular expression, but no letters."""
    return any(m[0].isalpha() for m in _MAYBE_LETTER.finditer(text))


def _buckets(text: str) -> np.ndarray:
    """Buckets of all n-grams of the lower-cased letters, runs of anything else being one space."""
    code = np.frombuffer((" " + _NO_WORD.sub(" ", text.lower()).strip() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    out = []
    for n in ORDERS:
        if len(code) >= n:
            h = np.full(len(code) - n + 1, n, np.uint32)
            for k in range(n):
                h = (h ^ code[k : k + len(h)]) * _MUL
                h ^= h >> np.uint32(15)
            out.append(h & np.uint32(BUCKETS - 1))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def _sparse(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of n-gram counts: offsets, buckets, counts."""
    at, which, counts = [0], [], []
    for t in texts:
        dense = np.bincount(_buckets(t), minlength=BUCKETS)
        own = np.flatnonzero(dense)
        which.append(own)
        counts.append(dense[own])
        at.append(at[-1] + len(own))
    return np.array(at), np.concatenate(which), np.concatenate(counts).astype(np.float64)


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    prior: np.ndarray
    weights: np.ndarray  # buckets x languages, log probabilities in single precision

    def score(self, texts: Sequence[str | None]) -> list[tuple[str, float]]:
        """The likeliest language and its posterior probability; und and 0 without a letter."""
        out: list[tuple[str, float]] = [(UNDETERMINED, 0.0)] * len(texts)
        own = [i for i, t in enumerate(texts) if t is not None and has_letter(t)]
        if not own or not self.languages:
            return out
        most = max(1, PRODUCTS // len(self.languages))
        for k in range(0, len(own), 64):
            part = own[k : k + 64]
            at, which, counts = _sparse([texts[i] for i in part])
            logs = np.empty((len(part), len(self.languages)))
            first = 0
            while first < len(part):  # a document has BUCKETS n-grams at most
                last = max(first + 1, int(np.searchsorted(at, at[first] + most, side="right")) - 1)
                lo, hi = at[first], at[last]
                logs[first:last] = np.add.reduceat(self.weights[which[lo:hi]] * counts[lo:hi, None], at[first:last] - lo, axis=0)
                first = last
            logs += self.prior
            logs -= logs.max(axis=1, keepdims=True)
            p = np.exp(logs)
            p /= p.sum(axis=1, keepdims=True)
            for i, row in zip(part, p, strict=True):
                best = int(row.argmax())
                out[i] = (self.languages[best], float(row[best]))
        return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each language from rows sorted by language, so that one language's are held at a time."""
    lang, docs, totals = None, 0, np.zeros(BUCKETS, np.int64)

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([docs], pa.int64()), pa.array([totals.tobytes()], pa.binary())], names=["l", "docs", "totals"])

    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if label != lang:
                if docs:
                    yield out()
                lang, docs, totals = label, 0, np.zeros(BUCKETS, np.int64)
            if has_letter(text):
                totals += np.bincount(_buckets(text), minlength=BUCKETS)
                docs += 1
    if docs:
        yield out()


def _log_probabilities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Smoothed log probabilities of each language from its counts, rows sorted by language."""

    def out() -> pa.RecordBatch:
        logs = np.log(totals / totals.sum()).astype(np.float32)
        return pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([logs.tobytes()], pa.binary())], names=["l", "logs"])

    lang, totals = None, np.zeros(0)
    for batch in batches:
        for label, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if label != lang:
                if lang is not None:
                    yield out()
                lang, totals = label, np.full(BUCKETS, SMOOTH)
            totals += np.frombuffer(counts, np.int64)
    if lang is not None:
        yield out()


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", train_docs: int = TRAIN_DOCS) -> LanguageModel:
    """Learn from text and label of the given rows; rows with a null text or label teach nothing, and rows that
    repeat teach as often as they are there. Without labelled rows the model knows no language.

    Of languages with more than train_docs rows a hash of the id picks about that many, in sixteen groups by that
    hash, which executors count and sum. Every language is learned: the driver gets a row of 128 KB for each, and
    broadcasts these, so a column of labels should hold languages, not free text."""
    ship(docs.sparkSession)
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("t"), F.col(lang).alias("l"), F.col(key).alias("k"))
    found = rows.groupBy("l").agg(F.count("*").alias("n"))
    found = stage(found, "languages")
    h = F.xxhash64(F.lit(2), "k")
    share = F.least(F.lit(1.0), F.lit(float(train_docs)) / F.col("n"))
    n_languages = found.count()
    picked = rows.join(F.broadcast(found) if n_languages <= BROADCAST_ROWS else found, "l").filter(F.pmod(h, F.lit(1_000_000)) / 1_000_000 < share)
    dealt = picked.select("t", "l", F.pmod(F.shiftright(h, 32), F.lit(16)).alias("g")).repartition("l", "g").sortWithinPartitions("l", "g")
    counts = dealt.select("t", "l").mapInArrow(lean(_count), "l string, docs long, totals binary").select("l", "totals")
    learned = counts.repartition("l").sortWithinPartitions("l").mapInArrow(_log_probabilities, "l string, logs binary").toArrow()
    rows_of = {r.l: r.n for r in found.collect()}
    unstage(found)
    names = sorted(learned.column("l").to_pylist())
    if not names:
        return LanguageModel((), np.zeros(0), np.zeros((BUCKETS, 0), np.float32))
    place = {name: i for i, name in enumerate(names)}
    weights = np.empty((BUCKETS, len(names)), np.float32)
    for name, logs in zip(learned.column("l").to_pylist(), learned.column("logs"), strict=True):
        weights[:, place[name]] = np.frombuffer(logs.as_buffer(), np.float32)
    prior = np.array([rows_of[name] for name in names], float)
    return LanguageModel(tuple(names), np.log(prior / prior.sum()), weights)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Add lang_pred and score (0 to 1); und and 0.0 where the text is null or has no letter, or where
    the model knows no language. Of equally likely languages the first by name counts. Whole texts are read,
    however long; rows that repeat an id are predicted by their own text; an empty table gives an empty result.
    Other columns pass through; columns that are already named so are replaced."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value.score(batch.column(batch.schema.get_field_index(text)).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                names=[*batch.schema.names, "lang_pred", "score"],
            )

    return docs.mapInArrow(lean(run), schema_with(docs, lang_pred="string", score="double"))


def is_held_out(key: Column) -> Column:
    """A quarter of the ids, by CRC-32 of their decimal form; rows with a null id are never held out."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
