"""Exact places of rows in an order over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stages import settled

#: Bits of monotonically_increasing_id() that count the rows of a partition; the others name the partition.
_PLACE_BITS = 33


def ranked(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """Add each row's place from 0 in the order. Equal rows, of which there should be none, get places next to each other
    in no particular order.

    Spark samples splitters of the order and exchanges the rows by range, once; each range is sorted by itself, and rows
    get their place in it. The sizes of the ranges, a row for each, are summed up and added. The ranges are
    settled first, since another sample would draw them elsewhere."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = settled(placed.withColumn("_at", F.monotonically_increasing_id())).withColumn("_range", F.shiftright("_at", _PLACE_BITS))
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))  # over a row for each range
    offsets = sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.col("_at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    return placed.join(F.broadcast(offsets), "_range").select(*df.columns, (F.col("_before") + own).alias(name))


def equal_shares(rank: Column, rows: int, n: int) -> Column:
    """The number, from 1, of the share of a row at a place from 0, when so many rows are cut into n shares; the first
    are one row larger if the shares aren't equal."""
    least, more = divmod(rows, n)
    large = more * (least + 1)
    share = F.when(rank < large, F.floor(rank / (least + 1))).otherwise(more + F.floor((rank - large) / max(least, 1))) + 1
    return share.cast("bigint")
