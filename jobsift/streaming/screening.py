"""Screening of shards as they arrive.

The batch job loops over shards; as a stream the same per-row steps run on each new file. Duplicates are
dropped across the shards of the watermark's span, by month of publication.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..config import Config
from ..functions.columns import month_key
from ..operators.screen import allowed, clean, not_part_time
from ..sources.postings import parse_lines


def screened_stream(spark: SparkSession, folder: str, cfg: Config = Config(), late: str = "62 days", max_files: int = 8) -> DataFrame:
    """Screened postings of every file that appears in a folder. State is bounded by the watermark."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(folder).withColumn("shard", F.col("_metadata.file_name"))
    df = allowed(not_part_time(clean(parse_lines(lines), cfg), cfg), cfg).withColumn("date", month_key(F.col("publish_date")))
    month = F.try_to_timestamp(F.concat("date", F.lit("-01")))
    keys = [k for k in cfg.dedup_keys if k != "date"] + (["shard"] if cfg.dedup_scope == "shard" else [])
    return df.withColumn("month", month).withWatermark("month", late).dropDuplicates([*keys, "month"]).drop("month")


def write_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
