"""Sharding by histogram sort.

Rows are ordered by a 96-bit key, 48 hashed bits of the text and then 48 of the id. Counting rounds
find the splitters: each round counts exact bytes and rows between candidate boundaries, and only the
intervals that still matter (they hold a splitter and more bytes than the tolerance, or too many rows
for one task) get finer boundaries in the next. With the splitters known, rows are exchanged once.
Everything is a built-in SQL function; the driver sees only counts per interval.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage, unstage

#: Bits of the key that are known after each round; the first 48 are the text's, the rest the id's.
DEPTHS = (12, 18, 24, 30, 36, 42, 48, 54, 60, 66, 72, 78, 84, 90, 96)
#: An interval with over 1/LEAVES of all rows is cut further, so that no task sorts more than about that.
LEAVES = 2048
LEAST_LEAF_ROWS = 100


def _prefix(depth: int) -> Column:
    """The key's first bits as text, so that both halves fit one column."""
    if depth <= 48:
        return F.shiftrightunsigned("_jobsift_h", 48 - depth).cast("string")
    return F.concat_ws("/", F.col("_jobsift_h"), F.shiftrightunsigned("_jobsift_g", 96 - depth))


def _start(depth: int, prefix: str) -> int:
    """The smallest 96-bit key with this prefix."""
    if depth <= 48:
        return int(prefix) << (96 - depth)
    h, g = map(int, prefix.split("/"))
    return (h << 48) + (g << (96 - depth))


def _keys(docs: DataFrame, text: str, key: str) -> DataFrame:
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        "*",
        F.shiftrightunsigned(F.xxhash64(whole), 16).alias("_jobsift_h"),
        F.shiftrightunsigned(F.xxhash64(F.lit(1), F.col(key)), 16).alias("_jobsift_g"),
        (F.octet_length(whole).cast("long") + 1).alias("size"),
    )


def _intervals(keys: DataFrame, shards: int, tolerance: float) -> tuple[list[tuple[int, int, str, int, int]], list[set[str]], int]:
    """Leaves (start, depth, prefix, bytes, rows) in key order; the prefixes refined at each depth."""
    leaves: list[tuple[int, int, str, int, int]] = []
    refined: list[set[str]] = []
    live, total, most_rows = keys, 0, 0
    for i, depth in enumerate(DEPTHS):
        if i:
            live = keys.filter(_prefix(DEPTHS[i - 1]).isin(sorted(refined[i - 1])))
        found = live.groupBy(_prefix(depth).alias("p")).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()
        new = [(_start(depth, r.p), depth, r.p, r.bytes, r.rows) for r in found]
        if not i:
            total = sum(x[3] for x in new)
            most_rows = max(LEAST_LEAF_ROWS, sum(x[4] for x in new) // LEAVES)
        leaves = sorted(leaves + new)
        cut: set[str] = set()
        if depth < DEPTHS[-1]:
            below = 0
            for leaf in leaves:
                inside = any(below < total * k / shards < below + leaf[3] for k in range(1, shards))
                if leaf[1] == depth and (leaf[4] > most_rows or inside and leaf[3] > tolerance * total / shards and leaf[4] > 1):
                    cut.add(leaf[2])
                below += leaf[3]
        refined.append(cut)
        if not cut:
            break
        leaves = [x for x in leaves if x[1] != depth or x[2] not in cut]
    return leaves, refined, total


def shard_by_bytes(docs: DataFrame, shards: int = 8, tolerance: float = 0.002, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Add size (UTF-8 bytes of the text plus 1), shard and slot (gapless from 0 in each shard).

    Shard sizes differ from an equal share by at most tolerance times the share or half a row, apart
    from rows with both the same text and id, which can't be told apart. Rows of equal text stay in one
    shard unless a boundary must cut their group. A null text has no bytes, null ids are equal ids.
    Columns of the input pass through; those named like a new one are replaced, and names that begin with
    _jobsift are reserved. An empty table gives an
    empty result. Splitters are the interval edges nearest to the equal shares."""
    docs = docs.drop("size", "shard", "slot")
    keyed = _keys(docs, text, key)
    keys = stage(keyed.select("_jobsift_h", "_jobsift_g", "size"), "keys")
    leaves, refined, total = _intervals(keys, shards, tolerance)
    unstage(keys)

    edges = [0, *accumulate(x[3] for x in leaves)]
    cuts = [min(range(len(edges)), key=lambda j: (abs(edges[j] - total * k / shards), j)) for k in range(1, shards)]
    rows, base, shard = [], 0, 0
    for i, (_, depth, prefix, _, n) in enumerate(leaves):
        while shard < shards - 1 and i >= cuts[shard]:
            shard, base = shard + 1, 0
        rows.append((f"{depth}:{prefix}", shard, base))
        base += n

    leaf = F.concat(F.lit(f"{DEPTHS[len(refined) - 1]}:"), _prefix(DEPTHS[len(refined) - 1]))
    for i in range(len(refined) - 2, -1, -1):
        deeper = _prefix(DEPTHS[i]).isin(sorted(refined[i]))
        leaf = F.when(deeper, leaf).otherwise(F.concat(F.lit(f"{DEPTHS[i]}:"), _prefix(DEPTHS[i])))
    # at most 4096 intervals, and 64 for each one that was cut: of these there are no more than LEAVES and a few at a depth
    places = docs.sparkSession.createDataFrame(rows, "_jobsift_leaf string, shard int, _jobsift_base long")
    placed = keyed.withColumn("_jobsift_leaf", leaf).join(F.broadcast(places), "_jobsift_leaf")
    order = "row_number() over (partition by _jobsift_leaf order by _jobsift_h, _jobsift_g, size)"
    return placed.select(*docs.columns, "size", "shard", (F.col("_jobsift_base") + F.expr(order) - 1).alias("slot"))
