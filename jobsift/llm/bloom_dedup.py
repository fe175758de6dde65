"""Exact deduplication by a two-pass Bloom filter.

Pass one: each text's hash becomes a cell of a large, sparse Bloom filter. Every task gathers the cells it sets
into a list for each range of the filter, so what it sends is a few lists, four bytes a row; where the lists
of a range meet, cells set twice are the hashes that may be repeated. They make a second, dense filter of
two bits a hash. Pass two tests every row against the broadcast second filter: rows that miss are unique
and pass straight through without a shuffle; only the others meet by the SHA-256 of their text. A second filter
that is too large to broadcast at once is used in parts, each for its own range of the hash, so it never
gets fuller. Everything is a built-in SQL function.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, ascii_lower, join_groups, stage, unstage

BLOCK_BITS = 32768  # of Spark's bitmap aggregates
#: Bits of the second filter for each hash that may be repeated; two are set, so about 1.4 % of unique rows hit.
BITS_PER_HASH = 16
#: Blocks of 4 KB that are broadcast at once: 64 MB. With more the rows are tested in several parts.
PART_BLOCKS = 16384
#: Cells of the first filter are 32 bits within a range, one for about so many rows and 2 ** RANGE_BITS at most.
RANGE_ROWS, RANGE_BITS = 65536, 14
SIGN = 1 << 31


def _maybe_repeated(hashes: DataFrame, bits: int) -> DataFrame:
    """(g): the cells that two or more rows set, and so every repeated hash, shortened. There are
    2 ** bits ranges."""
    g = _short(F.col("h"), bits)
    cell = (g.bitwiseAND(F.lit(0xFFFFFFFF)) - SIGN).cast("int")
    lists = hashes.select(F.shiftrightunsigned(g, 32).alias("range"), cell.alias("cell")).groupBy("range").agg(F.collect_list("cell").alias("cells"))
    twice = lists.select("range", F.explode("cells").alias("cell")).groupBy("range", "cell").agg(F.count("*").alias("n")).filter("n > 1")
    return twice.select(F.shiftleft("range", 32).bitwiseOR(F.col("cell").cast("long") + SIGN).alias("g"))


def _short(h: Column, bits: int) -> Column:
    return F.shiftrightunsigned(h, 32 - bits)


class KeyFilter:
    """A blocked Bloom filter of hashes (g): bitmaps by block, staged, so that its size is known before it is used."""

    def __init__(self, hashes: DataFrame, n: int) -> None:
        self.blocks = max(1, math.ceil(n * BITS_PER_HASH / BLOCK_BITS))
        block, first, second = self._cells(F.col("g"))
        cells = hashes.select(block.alias("_jobsift_block"), F.explode(F.array(first, second)).alias("bit"))
        self.bitmaps = stage(cells.groupBy("_jobsift_block").agg(F.bitmap_construct_agg("bit").alias("_jobsift_bits")), "bloom")

    def _cells(self, g: Column) -> tuple[Column, Column, Column]:
        """A hash's block, and its two bits there."""
        h = F.xxhash64(F.lit(8), g)
        block = F.pmod(h, F.lit(self.blocks)).cast("int")
        return block, *(F.shiftright(h, at).bitwiseAND(F.lit(BLOCK_BITS - 1)).cast("long") for at in (24, 42))

    def parts(self, rows: DataFrame, g: Column) -> list[DataFrame]:
        """The rows with _jobsift_maybe, whether the filter may hold their g: a table for each part of the filter."""
        block, first, second = self._cells(g)
        rows = rows.withColumn("_jobsift_block", block)
        out = []
        for at in range(0, self.blocks, PART_BLOCKS):
            own = rows if self.blocks <= PART_BLOCKS else rows.filter(F.col("_jobsift_block").between(at, at + PART_BLOCKS - 1))
            bits = self.bitmaps if self.blocks <= PART_BLOCKS else self.bitmaps.filter(F.col("_jobsift_block").between(at, at + PART_BLOCKS - 1))
            met = own.join(F.broadcast(bits), "_jobsift_block", "left")  # PART_BLOCKS rows of 4 KB at most
            hit = F.coalesce(_bit(F.col("_jobsift_bits"), first) & _bit(F.col("_jobsift_bits"), second), F.lit(False))
            out.append(met.withColumn("_jobsift_maybe", hit).drop("_jobsift_block", "_jobsift_bits"))
        return out


def repeat_filter(hashes: DataFrame, n_rows: int) -> tuple[KeyFilter, int]:
    """The second filter of a table of hashes (h), and how many bits of a hash name its range in the first."""
    bits = min(RANGE_BITS, max(0, math.ceil(math.log2(max(1, n_rows) / RANGE_ROWS))))
    repeated = stage(_maybe_repeated(hashes, bits), "repeated")
    made = KeyFilter(repeated, repeated.count())
    unstage(repeated)
    return made, bits


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The rows whose key isn't in gone, a staged table of distinct keys; a null is a key like any other.
    Up to BROADCAST_ROWS keys are broadcast; a filter of more of them lets the other rows pass straight through, so
    that only rows that may go meet the keys."""
    n = gone.count()
    gone = gone.withColumnRenamed(key, "_jobsift_gone")
    anti = lambda r, g: r.join(g, r[key].eqNullSafe(g["_jobsift_gone"]), "left_anti")
    if n <= BROADCAST_ROWS:
        return anti(rows, F.broadcast(gone))
    made = KeyFilter(gone.select(F.xxhash64("_jobsift_gone").alias("g")), n)
    tested = made.parts(rows.withColumn("_jobsift_h", F.xxhash64(key)), F.col("_jobsift_h"))
    names = [F.col(f"`{c}`") for c in rows.columns]
    passed = [t.filter("not _jobsift_maybe").select(*names) for t in tested]
    met = [anti(t.filter("_jobsift_maybe").select(*names), gone) for t in tested]
    return reduce(DataFrame.unionByName, [*passed, *met])


def _bit(bits: Column, at: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, at.bitwiseAND(F.lit(7)).cast("int")).bitwiseAND(F.lit(1)) == 1


def exact_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Annotate every row with keep_id, group_size, kept and text_sha256.

    Texts are equal when identical after lower-casing A-Z only; null counts as empty, and very long texts
    are compared whole. Of equal texts the row with the largest key stays; a null key is smallest, and of rows
    that repeat the same key and text just one stays. Empty tables give empty results. Columns of the input
    pass through, except those that have one of the four new names, which are replaced; names that begin
    with _jobsift are reserved."""
    docs = docs.drop("keep_id", "group_size", "kept", "text_sha256")
    norm = ascii_lower(F.coalesce(F.col(text), F.lit("")))
    hashed = docs.withColumn("_jobsift_h", F.xxhash64(norm))
    n_rows = docs.count()
    made, bits = repeat_filter(hashed.select(F.col("_jobsift_h").alias("h")), n_rows)
    tested = made.parts(hashed, _short(F.col("_jobsift_h"), bits))
    tested = [t.drop("_jobsift_h").withColumn("text_sha256", F.sha2(norm, 256)) for t in tested]

    single = [
        t.filter(~F.col("_jobsift_maybe")).select(
            *docs.columns,
            F.col(key).alias("keep_id"),
            F.lit(1).cast("long").alias("group_size"),
            F.lit(True).alias("kept"),
            "text_sha256",
        )
        for t in tested
    ]
    maybe = reduce(DataFrame.unionByName, [t.filter("_jobsift_maybe").drop("_jobsift_maybe") for t in tested])
    maybe = stage(maybe.withColumn("_jobsift_row", F.monotonically_increasing_id()), "repeats")
    groups = maybe.groupBy("text_sha256").agg(
        F.max(F.struct(F.col(key).alias("key"), F.col("_jobsift_row").alias("row"))).alias("_jobsift_best"), F.count("*").alias("group_size")
    )
    met = join_groups(maybe, stage(groups, "groups"), "text_sha256", "group_size", n_rows).select(
        *docs.columns,
        F.col("_jobsift_best.key").alias("keep_id"),
        "group_size",
        (F.col("_jobsift_row") == F.col("_jobsift_best.row")).alias("kept"),
        "text_sha256",
    )
    return reduce(DataFrame.unionByName, single).unionByName(met)
