"""The corpus pipeline: language identification, exact and near deduplication, mixing, packing.

Each stage is (name, function); a function takes (spark, docs, sf_dir), and its result is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents, with the
values that came in, also where a column is named like one that the stage's operator adds. All stages take
null texts and columns, very long texts, repeated rows and empty tables; what they do with them is said below.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsift.llm import language_id
from jobsift.llm.bloom_dedup import exact_dedup, without
from jobsift.llm.chosen_path import near_duplicates
from jobsift.llm.common import settle, stage, table, unstage
from jobsift.llm.mixing import mix
from jobsift.llm.packing import pack
from jobsift.llm.queries import KEEP, TARGETS, tokenizer_path

#: A document is rejected if no language is at least so likely.
LEAST_SCORE = 0.5
#: Documents are near-duplicates from this Jaccard similarity of their 5-word shingle sets.
NEAR = (80, 100)


def _kept(docs: DataFrame, step: Callable[[DataFrame], DataFrame], added: list[str]) -> DataFrame:
    """The rows that step leaves, with the input's columns. Columns named like those that step adds wait under
    another name."""
    aside = {c: f"_jobsift_own_{i}" for i, c in enumerate(docs.columns) if c.lower() in added}
    return step(docs.withColumnsRenamed(aside)).select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns])


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language that the model can tell; null texts and those without a letter go. The model
    learns from the labelled documents themselves, so a null label is no reason to go; if none is labelled,
    every document with a letter stays. Rows that repeat share their fate, an empty table stays empty."""
    model = language_id.fit(docs)
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    sure = (F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)
    return _kept(docs, lambda d: language_id.identify(d, model).filter(sure), ["lang_pred", "score"])


def exact_deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text stays, that with the largest id; null texts count as empty ones, null ids as the
    smallest, and of rows that repeat both id and text just one stays. An empty table stays empty."""
    return _kept(docs, lambda d: exact_dedup(d).filter("kept"), ["keep_id", "group_size", "kept", "text_sha256"])


def near_deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest id. A hash of the text
    tells documents with equal ids apart; rows that repeat both stay or go together, and the stage before
    leaves none. Texts without words, null or empty, all stay. Texts don't move: keys of rows that go are
    broadcast, or, where they are many, a filter of them, and only rows that it hits meet them. An empty
    table stays empty."""
    marked = docs.withColumn("_jobsift_key", F.struct("doc_id", F.xxhash64("text").alias("text")))
    found = near_duplicates(marked.select("_jobsift_key", "text"), key="_jobsift_key", share=NEAR)
    gone = stage(found.filter("not kept").select("_jobsift_key").distinct(), "gone")
    return without(marked, gone, "_jobsift_key").select(*[F.col(f"`{c}`") for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens have the target shares of sources, languages and topics. Every document has a chance;
    null and new sources and languages are values like any other. The topic is the column topic, or the form of
    the text, if the table has none. Rows that repeat an id stay or go together. An empty table stays empty."""
    return _kept(docs, lambda d: mix(d, TARGETS, KEEP).filter("kept"), ["tokens", "weight", "probability", "kept"])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of windows of tokens; a null text is empty and has just its end. Rows that repeat
    are documents of their own, very long texts are cut into windows, and an empty table has no pieces."""
    return pack(docs, tokenizer_path())


STAGES = [
    ("language_id", identified),
    ("exact_dedup", exact_deduplicated),
    ("near_dedup", near_deduplicated),
    ("mixing", mixed),
    ("packing", packed),
]

#: The classifier, the similarity join and the tokenizer are beyond SQL; tests/llm/test_pipeline.py holds run()
#: to a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, done = table(spark, sf_dir, "documents"), []
    for name, step in STAGES:
        docs = settle(lambda: step(spark, docs, sf_dir), f"pipeline-{name}")  # noqa: B023
        unstage(*done)
        done = [docs]
    return docs
