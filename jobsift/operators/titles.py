"""Frequent titles, their shards, codes and the postings that have them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import broad_code, extract_code
from .ranking import equal_shares, ranked


def frequent(df: DataFrame, least: int, title: str = "title") -> DataFrame:
    """(title, count) of titles with at least so many rows."""
    return df.filter(F.col(title).isNotNull()).groupBy(title).count().filter(F.col("count") >= least)


def total(counts: DataFrame) -> DataFrame:
    return counts.agg(F.sum("count").cast("bigint").alias("total"))


def shards(counts: DataFrame, n: int, title: str = "title") -> DataFrame:
    """Number of an equal share of the titles, the most frequent first, equally frequent ones by name; the first shards
    are one title larger if the shares aren't equal. Titles are dealt out in sampled ranges, whatever their script."""
    placed = ranked(counts, F.desc("count"), F.asc(title), name="_rank")
    return placed.select(*counts.columns, equal_shares(F.col("_rank"), placed.count(), n).alias("shard"))


def labels(answers: DataFrame) -> DataFrame:
    """(title, soc_code) of the answers that hold a code."""
    return answers.select("title", extract_code(F.col("answer")).alias("soc_code")).dropna(subset=["soc_code"])


def label_join(postings: DataFrame, title_labels: DataFrame, on: str = "title") -> DataFrame:
    """Postings with the code of their title. The planner broadcasts the labels if they are small; else
    adaptive execution splits hot titles."""
    return postings.join(title_labels, on, "inner")


def universe(crosswalk: DataFrame, code: str = "soc_code") -> DataFrame:
    """Distinct broad codes of the official list."""
    return crosswalk.select(broad_code(F.col(code)).alias(code)).distinct()


def within(rows: DataFrame, codes: DataFrame, on: str = "soc_code") -> DataFrame:
    """Rows whose code is in the list."""
    return rows.join(codes, on, "left_semi")


def large_groups(rows: DataFrame, least: int, by: str = "soc_code") -> DataFrame:
    """Rows of groups with at least so many. Counting and a semi join move less than a window, and the
    groups are pre-aggregated before they are shuffled."""
    groups = rows.groupBy(by).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).select(by)
    return rows.join(groups, by, "left_semi")
