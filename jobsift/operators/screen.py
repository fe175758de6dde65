"""Screening of raw postings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.columns import missing_to_null, month_key
from ..schema import ATTRIBUTE_COLUMNS, DESCRIPTION_COLUMNS, POSTING_COLUMNS


def clean(raw: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Missing values to null, postings without a date out, titles filled from the position's name."""
    df = raw.withColumns({c: missing_to_null(F.col(c), cfg.sentinels) for c in POSTING_COLUMNS if c in raw.columns})
    return df.dropna(subset=["publish_date"]).withColumn("title", F.coalesce("title", "position_name"))


def not_part_time(df: DataFrame, cfg: Config = Config(), title: str = "title") -> DataFrame:
    """Part-time postings out; rows without a title stay."""
    if cfg.part_time_match == "contains":
        return df.filter(~F.coalesce(F.col(title).contains(cfg.part_time_title), F.lit(False)))
    return df.filter(~F.col(title).eqNullSafe(cfg.part_time_title))


def allowed(df: DataFrame, cfg: Config = Config(), source: str = "source") -> DataFrame:
    return df.filter(F.col(source).isin(*cfg.allowed_sources))


def keep_first(df: DataFrame, keys: list[str], order: list[str], scope: str | None = None) -> DataFrame:
    """The first row of each combination of keys, nulls being equal; within each scope if one is named.
    One exchange on the keys; ranks over 1 go before it."""
    by = [*([scope] if scope else []), *keys]
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_n", n).filter("_n = 1").drop("_n")


def screen(raw: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Clean, filter, add the month and drop duplicates. raw has shard and position, as its reader gives."""
    df = allowed(not_part_time(clean(raw, cfg), cfg), cfg).withColumn("date", month_key(F.col("publish_date")))
    return keep_first(df, list(cfg.dedup_keys), ["position"], "shard" if cfg.dedup_scope == "shard" else None).drop("position")


def attributes(screened: DataFrame) -> DataFrame:
    return screened.select(*ATTRIBUTE_COLUMNS)


def descriptions(screened: DataFrame) -> DataFrame:
    return screened.select(*DESCRIPTION_COLUMNS)


def with_group_size(df: DataFrame, by: str) -> DataFrame:
    """Add n, how many rows have the row's value; 0 for a null."""
    counts = df.filter(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("_n"))
    return df.join(counts, by, "left").select(*df.columns, F.coalesce("_n", F.lit(0).cast("bigint")).alias("n"))


def titles(screened: DataFrame) -> DataFrame:
    return screened.select("title")


def source_census(df: DataFrame, source: str = "source", top: int = 20) -> DataFrame:
    """Rows by source, the most frequent first."""
    return df.filter(F.col(source).isNotNull()).groupBy(source).count().orderBy(F.desc("count"), source).limit(top)
