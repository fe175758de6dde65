"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from collections.abc import Hashable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, join_groups, lean, settle, ship, stage, unstage


class Forest:
    """Union-find whose roots are the smallest members; keeps only links that joined two trees."""

    def __init__(self) -> None:
        self.up: dict[Hashable, Hashable] = {}

    def find(self, x: Hashable) -> Hashable:
        up = self.up
        root = x
        while (nxt := up.get(root, root)) != root:
            root = nxt
        while x != root:
            x, up[x] = up.get(x, x), root
        return root

    def join(self, a: Hashable, b: Hashable) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if b < a:
            a, b = b, a
        self.up[b] = a
        self.up.setdefault(a, a)
        return True

    def stars(self) -> Iterator[tuple[Hashable, Hashable]]:
        """(member, root) for every member that isn't the root of its tree."""
        for x in list(self.up):
            if (r := self.find(x)) != x:
                yield x, r


def stars_of(links: Iterable[tuple[Hashable, Hashable]]) -> list[tuple[Hashable, Hashable]]:
    f = Forest()
    for a, b in links:
        f.join(a, b)
    return list(f.stars())


def _with_least(e: DataFrame, n: int) -> DataFrame:
    """e with m, the least v of each u. Hubs meet the one row of their minimum by broadcast."""
    least = stage(e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_jobsift_n")), "least")
    return join_groups(e, least, "u", "_jobsift_n", n).drop("_jobsift_n")


def _large_star(e: DataFrame, n: int) -> DataFrame:
    """Link the larger neighbours of each node to its smallest neighbour, or to itself if it is smaller."""
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    met = _with_least(both, 2 * n).filter("v > u")
    return met.select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(e: DataFrame, n: int) -> DataFrame:
    """Link each node and its smaller neighbours to the smallest of them. Links point to the smaller node."""
    ends = F.explode(F.array("u", "v")).alias("u")
    return _with_least(e, n).select(ends, F.col("m").alias("v")).filter("u <> v").distinct()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all links of a task."""
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            forest.join(a, b)
    found = [(x, forest.find(x)) for x in list(forest.up)]
    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["node", "root"])


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has a link, root the smallest node of its component.

    Nulls in a link are ignored; self-links and repeated links do no harm, and without links there are no
    rows. Links are 64-bit numbers. No step collects rows to the driver: minima are pre-aggregated, and nodes with a thousandth
    of all links meet theirs by broadcast. Every round is written to the shared folder. Once no more than BROADCAST_ROWS links are
    left (3 MB), a bounded task joins them in one pass, as each further round would cost four exchanges."""
    ship(links.sparkSession)
    e = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).filter("u is not null and v is not null and u <> v")
    e = stage(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "links")
    n = e.count()
    if n > BROADCAST_ROWS:
        raw, e = e, stage(e.distinct(), "links")
        unstage(raw)
        n = e.count()
    state = None
    while n:
        if n <= BROADCAST_ROWS:
            return stage(e.coalesce(1).mapInArrow(lean(_joined), "node long, root long"), "joined")
        after = settle(lambda: _small_star(stage(_large_star(e, n), "stars"), n), "links")  # noqa: B023
        seen = after.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        unstage(e)
        e, n = after, seen[0]
        if seen == state:
            break
        state = seen
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
