"""Writers. Stages exchange Parquet; text is for the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def write_stage(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, sep: str = ",", quote_all: bool = False) -> None:
    """Text with a header; quotes in a field are doubled."""
    df.write.mode("overwrite").option("header", True).option("sep", sep).option("escape", '"').option("quoteAll", quote_all).csv(path)


def write_report(df: DataFrame, path: str) -> None:
    """A report as a single file of text; it has a row for each label."""
    write_csv(df.coalesce(1), path)


def row_count(df: DataFrame, name: str) -> DataFrame:
    """(name, rows): the table's row count, as observed while all its rows are made."""
    observed, seen = counted(df, name)
    observed.write.format("noop").mode("overwrite").save()
    return df.sparkSession.createDataFrame([(name, seen.get["rows"])], "name string, rows long")


def counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """The table, and an observation that has its row count once an action has run."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen
