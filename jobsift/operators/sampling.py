"""Exact, reproducible samples and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import hash_order


def per_group(df: DataFrame, by: str, cap: int, key: str, seed: int) -> DataFrame:
    """All rows of a group, or cap of them chosen by a hash of the key. Ranks beyond the cap are dropped
    before the exchange, so no task gets more than the cap from each task before it."""
    w = Window.partitionBy(by).orderBy(*hash_order(seed, F.col(key)))
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= cap).drop("_n")


def hash_rank(df: DataFrame, key: str, seed: int) -> DataFrame:
    """(key, rank): every row's place, from 1, in the order of a hash of its key.

    The order's first 12 bits deal the rows to 4096 even ranges; each range is ranked by itself, and the
    counts of the ranges before it, a table of that fixed size, are added. So no task gets all rows."""
    order = hash_order(seed, F.col(key))
    placed = df.select(key).withColumn("_range", F.conv(F.left(order[0], F.lit(3)), 16, 10).cast("int"))
    counts = placed.groupBy("_range").agg(F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_range", before.alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    ranked = placed.withColumn("_own", own).join(F.broadcast(offsets), "_range")
    return ranked.select(key, (F.col("_before") + F.col("_own")).alias("rank"))


def split(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Add split: train, valid, test as 60, 20 and 20 in a hundred, the test share rounded up. The key
    should be unique; rows without one are left out. Only the key is ranked: the two places in its order that part the
    splits are looked up, so rows are neither joined nor moved."""
    n = df.count()
    n_rest = (2 * n + 4) // 5
    n_test = (n_rest + 1) // 2
    n_train, n_valid = n - n_rest, n_rest - n_test
    place = F.struct(*[c.alias(f"_{i}") for i, c in enumerate(hash_order(seed, F.col(key)))])
    upto = lambda k: F.max(F.when(F.col("rank") <= k, place))
    kind = df.select(place.alias("at")).schema["at"].dataType
    last = hash_rank(df.filter(F.col(key).isNotNull()), key, seed).agg(upto(n_train), upto(n_train + n_valid)).first()
    within = lambda at: F.lit(False) if at is None else place <= F.struct(*[F.lit(x).cast(f.dataType).alias(f.name) for x, f in zip(at, kind, strict=True)])
    name = F.when(within(last[0]), "train").when(within(last[1]), "valid").otherwise("test")
    return df.filter(F.col(key).isNotNull()).withColumn("split", name)
