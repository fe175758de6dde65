"""What each of several filters removes, in every order in which they could be applied.

One pass gives each document a flag for each filter that it fails. Documents are counted by part and flags,
and a CUBE over part and flags gives, of each subset of the filters, the documents that none of it removes: the row of the
grouping set whose flags are all false. A step of an order is a pair of such subsets, the filters before it
and those up to it, so all orders and all figures are joins of one small table with itself.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_groups, stage, unstage

#: Words of a text, for a regular expression of Java.
WORDS = r"[^\x20\x09-\x0D]+"
MEASURES = ("n", "good", "toxic")


def text_flags(text: Column) -> dict[str, Column]:
    """The filters that look at one text: A under 200 words, B under half of the words distinct, C over 2 % capital
    letters, D any of #$%&*|. A null text is empty."""
    whole = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(whole, F.lit(WORDS), F.lit(0))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 50 * F.size(words).cast("long"),
        "C": 100 * F.regexp_count(whole, F.lit("[A-Z]")).cast("long") > 2 * F.length(whole).cast("long"),
        "D": whole.rlike("[#$%&*|]"),
    }


def repeats_smaller(rows: DataFrame, n_rows: int, digest: str, key: str) -> DataFrame:
    """Add E: whether a row with the same digest has a smaller key. Null keys are neither smaller nor larger than
    others. Only digests with several rows meet these again, and large groups by broadcast."""
    groups = rows.groupBy(digest).agg(F.min(key).alias("_first"), F.count("*").alias("_rows")).filter("_rows > 1")
    met = join_groups(rows, stage(groups, "copies"), digest, "_rows", n_rows, "left")
    return met.withColumn("E", F.coalesce(F.col(key) > F.col("_first"), F.lit(False))).drop("_first", "_rows")


def flagged(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", part: str = "source") -> DataFrame:
    """(part, A, B, C, D, E, good, toxic) of each document, staged. Texts are read once and don't move; what
    moves is a digest and the key. A document is good or toxic if any row of labels with its key says so, with quality = 1
    or toxic = 1; a null part is empty."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.col(key).alias("key"),
        *[c.alias(name) for name, c in text_flags(F.col(text)).items()],
        F.unhex(F.sha2(whole, 256)).alias("digest"),
    )
    rows = stage(rows, "flags")
    said = labels.groupBy(F.col(key).alias("key")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    met = repeats_smaller(rows, rows.count(), "digest", "key").join(said, "key", "left")
    sure = [F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("good", "toxic")]
    return stage(met.select("part", *"ABCDE", *sure), "audited")


def survivors(rows: DataFrame, filters: str) -> DataFrame:
    """(part, subset, n, good, toxic): of each part and each subset of the filters, as a mask whose lowest bit is the first
    filter, the documents that none of the subset removes. All subsets of a part are there, also
    where nothing survives."""
    cells = rows.groupBy("part", *filters).agg(
        F.count("*").alias("n"), *[F.sum(F.col(c).cast("long")).alias(c) for c in MEASURES[1:]]
    )  # no more rows than parts times two to the number of filters
    clean = [F.lit(False).alias(f) for f in filters]
    nothing = cells.select("part").distinct().select("part", *clean, *[F.lit(0).cast("long").alias(c) for c in MEASURES])
    taken = [F.when(F.grouping(f) == 0, F.lit(1 << i)).otherwise(0) for i, f in enumerate(filters)]
    cube = cells.unionByName(nothing).cube("part", *filters).agg(
        F.grouping("part").alias("all_parts"), sum(taken, F.lit(0)).alias("subset"), *[F.sum(c).alias(c) for c in MEASURES]
    )
    none_fails = [F.coalesce(~F.col(f), F.lit(True)) for f in filters]  # null: the flag is not of the set
    kept = cube.filter(F.col("all_parts") == 0)
    for c in none_fails:
        kept = kept.filter(c)
    return kept.select("part", "subset", *MEASURES)


def orders(filters: str) -> list[tuple[str, int, str, int, int, int]]:
    """(filter_order, step, filter, its bit, subset before, subset after) of all orders: fixed by the filters."""
    out = []
    for order in permutations(filters):
        before = 0
        for step, f in enumerate(order, 1):
            bit = 1 << filters.index(f)
            out.append(("".join(order), step, f, bit, before, before | bit))
            before |= bit
    return out


def audit(rows: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """One row for each part, order of the filters and step, zeros included: kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley. rows: part, a flag for each filter, good, toxic.

    An empty table gives no rows. Repeated rows count each; a null part is one of its own. Of filters so many that
    their orders don't fit a small table (7 have 35,280 steps) ValueError is raised."""
    if len(filters) > 7:
        raise ValueError("at most seven filters: all their orders are listed")
    spark = rows.sparkSession
    every = (1 << len(filters)) - 1
    found = stage(survivors(rows, filters), "survivors")
    at = lambda name: found.select("part", F.col("subset").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in MEASURES])
    # pairs of subsets that differ in one filter, with the number of orders in which that filter comes at that place
    pairs = {(f, bit, before, after) for _, _, f, bit, before, after in orders(filters)}
    size = len(filters)
    weighted = [(*p, factorial(p[2].bit_count()) * factorial(size - 1 - p[2].bit_count())) for p in sorted(pairs)]
    pair = spark.createDataFrame(weighted, "filter string, bit int, before int, after int, orders long")
    met = at("before").join(F.broadcast(pair), "before").join(at("after"), ["part", "after"])
    own = F.col("before_n") - F.col("after_n")
    met = met.select("part", "filter", "bit", "before", "after", "orders", F.col("after_n").alias("kept"), own.alias("removed"), *[(F.col(f"before_{c}") - F.col(f"after_{c}")).alias(f"{c}_lost") for c in MEASURES[1:]])
    met = stage(met, "pairs")
    # removed alone, removed last of all, and removed in all orders
    whole = met.groupBy("part", "filter").agg(
        F.sum(F.when(F.col("before") == 0, F.col("removed"))).alias("fails"),
        F.sum(F.when(F.col("after") == every, F.col("removed"))).alias("unique_fails"),
        F.sum(F.col("removed") * F.col("orders")).alias("shapley"),
    )
    steps = spark.createDataFrame(orders(filters), "filter_order string, step int, filter string, bit int, before int, after int").drop("bit", "after")
    return met.join(F.broadcast(steps), ["filter", "before"]).join(whole, ["part", "filter"]).select(
        "part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley"
    )
