"""Labels, tokens and weights for training."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import feature_text

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have this package


def label_ids(df: DataFrame, label: str) -> DataFrame:
    """(label, label_id): distinct labels in order, numbered from 0. A few hundred rows."""
    distinct = df.filter(F.col(label).isNotNull()).select(label).distinct()
    return distinct.withColumn("label_id", (F.dense_rank().over(Window.orderBy(label)) - 1).cast("bigint"))


def label_count(df: DataFrame, label: str) -> DataFrame:
    return df.agg(F.countDistinct(label).alias("labels"))


def encode(df: DataFrame, ids: DataFrame, label: str) -> DataFrame:
    """Add label_id; null for a label that isn't listed."""
    return df.join(ids, label, "left")


def decode(df: DataFrame, ids: DataFrame, label: str, column: str) -> DataFrame:
    """Replace a column of label ids by the labels."""
    names = ids.select(F.col("label_id").alias(column), F.col(label).alias("_name"))
    return df.join(names, column, "left").drop(column).withColumnRenamed("_name", column)


def class_weights(train: DataFrame, label: str) -> DataFrame:
    """(label, class_weight): n / (k * n_c)."""
    counts = train.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n_c"))
    whole = Window.partitionBy()  # over a row for each label
    return counts.select(label, (F.sum("n_c").over(whole) / (F.count("*").over(whole) * F.col("n_c"))).alias("class_weight"))


def character_counts(df: DataFrame, text: str) -> DataFrame:
    """(token, count) of the characters of all texts. Every task counts the code points of its texts in arrays and sends a
    row for each character that it has seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(sys.maxunicode + 1, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for t in _joined(batch.column(0).slice(at, 256).drop_null().to_pylist()):
                    n = np.bincount(np.frombuffer(t.encode("utf-32-le"), np.uint32))
                    seen[: len(n)] += n
        found = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array([chr(p) for p in found], pa.string()), pa.array(seen[found])], names=["token", "n"])

    told = df.select(text).mapInArrow(run, "token string, n long")
    return told.groupBy("token").agg(F.sum("n").alias("count"))


def _joined(texts: list[str], most: int = 1 << 20) -> Iterator[str]:
    """The texts one after the other, in pieces of about so many characters; a longer text in pieces of its own."""
    held, size = [], 0
    for t in texts:
        for at in range(0, len(t), most):
            held.append(t[at : at + most])
            size += len(held[-1])
            if size >= most:
                yield "".join(held)
                held, size = [], 0
    yield "".join(held)


def vocabulary(train: DataFrame, text: str, size: int) -> DataFrame:
    """(token, token_id) of the most frequent characters, from 2; 0 is padding and 1 anything else."""
    counts = character_counts(train, text).orderBy(F.desc("count"), "token").limit(size)
    return counts.select("token", (F.row_number().over(Window.orderBy(F.desc("count"), "token")) + 1).cast("int").alias("token_id"))


def tokens(df: DataFrame, vocab: DataFrame, max_length: int, title: str = "title", description: str = "description", repeats: int = 2) -> DataFrame:
    """Add input_ids and attention_mask of a fixed length, one id for a character. The vocabulary, as small as
    its size parameter says, is collected once; characters are looked up in its sorted code points."""
    known = sorted((ord(r.token), r.token_id) for r in vocab.collect())
    points, ids = np.array([k for k, _ in known], np.uint32), np.array([i for _, i in known], np.int32)

    def encode_batch(texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), max_length), np.int32)
        for row, t in zip(out, texts, strict=True):
            code = np.frombuffer((t or "")[:max_length].encode("utf-32-le", "surrogatepass"), np.uint32)
            if len(points):
                at = np.minimum(np.searchsorted(points, code), len(points) - 1)
                row[: len(code)] = np.where(points[at] == code, ids[at], 1)
            else:
                row[: len(code)] = 1
        return out

    return _with_ids(df, feature_text(F.col(title), F.col(description), repeats), encode_batch, max_length)


def _with_ids(df: DataFrame, text: Column, encode_batch: Callable[[list[str | None]], np.ndarray], max_length: int) -> DataFrame:
    """Add input_ids, rows of max_length ids with 0 as padding, and attention_mask. A null text has neither."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = batch.column(batch.num_columns - 1).to_pylist()
                ids = encode_batch(texts)
                none = pa.array([t is None for t in texts], pa.bool_())
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel(), pa.int32()), max_length).cast(pa.list_(pa.int32())) for x in (ids, (ids != 0).astype(np.int32))]
                lists = [pc.if_else(none, pa.scalar(None, pa.list_(pa.int32())), x) for x in lists]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *lists], names=[*batch.schema.names[:-1], "input_ids", "attention_mask"])

    df = df.drop("input_ids", "attention_mask")
    schema = T.StructType([*df.schema.fields, *(T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("input_ids", "attention_mask"))])
    return df.withColumn("_text", text).mapInArrow(run, schema)


def wordpieces(df: DataFrame, vocab: list[str], max_length: int, title: str = "title", description: str = "description", repeats: int = 2) -> DataFrame:
    """Add input_ids and attention_mask of a fixed length by WordPiece: lower-cased words and single Chinese
    characters, each cut into the longest pieces of the vocabulary from its begin, [UNK] where that
    fails; [CLS] before and [SEP] after them, the end cut off at max_length, and [PAD] up to it. vocab: pieces
    in the order of their ids, [PAD] first, as the lines of a vocabulary file."""
    place = {piece: i for i, piece in enumerate(vocab)}
    cls, sep, unk = (place[x] for x in ("[CLS]", "[SEP]", "[UNK]"))
    if place["[PAD]"] != 0:
        raise ValueError("[PAD] must be the first piece")
    longest = max(map(len, vocab))

    def encode_batch(texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), max_length), np.int32)
        for row, t in zip(out, texts, strict=True):
            ids = [cls]
            for word in basic_words(t or ""):
                if len(ids) >= max_length - 1:
                    break
                ids += pieces_of(word, place, unk, longest)
            ids = [*ids[: max_length - 1], sep]
            row[: len(ids)] = ids
        return out

    return _with_ids(df, feature_text(F.col(title), F.col(description), repeats), encode_batch, max_length)


def basic_words(text: str) -> Iterator[str]:
    """Words for WordPiece: control characters go, accents go, letters are lower-cased, and punctuation marks and
    Chinese characters are words of their own."""
    word: list[str] = []
    for c in text:
        kind = unicodedata.category(c)
        if c.isspace():
            parts, single = "", True
        elif c in "\0\ufffd" or kind[0] == "C":
            continue
        else:
            single = _is_chinese(ord(c)) or kind[0] == "P" or c.isascii() and not c.isalnum()
            parts = c if single else "".join(x for x in unicodedata.normalize("NFD", c.lower()) if unicodedata.category(x) != "Mn")
        if single and word:
            yield "".join(word)
            word = []
        if single and parts:
            yield parts
        elif not single:
            word.append(parts)
    if word:
        yield "".join(word)


def _is_chinese(point: int) -> bool:
    """The ranges of CJK ideographs."""
    return any(a <= point <= b for a, b in ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F)))


def pieces_of(word: str, place: dict[str, int], unknown: int, longest: int, most: int = 100) -> list[int]:
    """Ids of the longest pieces from the word's begin; later pieces are marked by ##. Words over most characters,
    or with a rest that no piece begins, are unknown."""
    if not word or len(word) > most:
        return [unknown] if word else []
    found, at = [], 0
    while at < len(word):
        mark = "##" if at else ""
        for end in range(min(len(word), at + longest), at, -1):
            if (i := place.get(mark + word[at:end])) is not None:
                found.append(i)
                at = end
                break
        else:
            return [unknown]
    return found
