"""Readers of posting shards, of staged tables and of code lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import decodable
from ..schema import CROSSWALK_CODE, POSTING_COLUMNS, SCREENED

SEPARATOR = "@!"


def parse_lines(lines: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Columns of delimited, unquoted lines (column value). Lines with too many fields and blank lines go;
    short ones are filled up with nulls; a byte-order mark is dropped. Other columns stay."""
    names = columns or POSTING_COLUMNS
    others = [c for c in lines.columns if c != "value"]
    text = F.regexp_replace(F.col("value"), "^﻿", "")
    parts = lines.filter(F.trim(text) != "").select(*others, F.split(text, SEPARATOR, -1).alias("_parts"))
    parts = parts.filter(F.size("_parts") <= len(names))
    return parts.select(*[F.get("_parts", F.lit(i)).alias(c) for i, c in enumerate(names)], *others)


def read_shards(spark: SparkSession, path: str | list[str], pattern: str | None = None) -> DataFrame:
    """Raw postings of all shards of a folder (or paths), with the file's name as shard and the row's place
    in it, which says what "first" means when duplicates are dropped. Bytes that aren't UTF-8 go; no character does."""
    reader = spark.read.option("pathGlobFilter", pattern) if pattern else spark.read
    lines = reader.text(path)
    placed = lines.select(
        decodable(F.col("value")).alias("value"),
        F.col("_metadata.file_name").alias("shard"),
        F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("row")).alias("position"),
    )
    return parse_lines(placed)


def shard_paths(folder: str, name: str, numbers: range) -> list[str]:
    """Paths of numbered shards, name holding one %d."""
    return [f"{folder.rstrip('/')}/{name % i}" for i in numbers]


def read_screened_csv(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """A screened table that was exported with '?' between fields, by position. Lines with too many fields go, and short
    ones are filled up with nulls. Bytes that aren't UTF-8 go, characters never do: fields are taken as bytes, one a
    character, and decoded afterwards, so a file may be split anywhere."""
    names = [f.name for f in SCREENED.fields[:16]]
    schema = T.StructType([*SCREENED.fields[:16], *(T.StructField(c, T.StringType()) for c in ("_more", "_odd"))])
    reader = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_odd").option("sep", "?").option("header", header).option("escape", '"').option("enforceSchema", True)
    df = reader.option("encoding", "ISO-8859-1").option("columnPruning", False).csv(path)
    df = df.filter(F.col("_more").isNull() & F.col("_odd").isNotNull())  # a line of 17 fields is all that isn't odd
    return df.select(*[F.nullif(decodable(F.encode(c, "ISO-8859-1").cast("string")), F.lit("")).alias(c) for c in names])


def read_table_csv(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """Comma-separated text with a header; without the index column that some exports have."""
    df = spark.read.option("header", True).option("escape", '"').option("multiLine", True).option("pathGlobFilter", pattern).csv(path)
    return df.drop("Unnamed: 0", "_c0")


def read_crosswalk(spark: SparkSession, path: str) -> DataFrame:
    """The official list's detailed codes."""
    return spark.read.option("header", True).csv(path).select(F.col(CROSSWALK_CODE).alias("soc_code"))
