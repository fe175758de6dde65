"""Ranked lexical search: the best documents of each item by the words they share.

Documents become postings (term, document, count) in buckets by term, rare terms whole and frequent ones cut
into parts. Items' terms are joined with them, each match is scored in integers, and scores are summed by item and
document. No result depends on a cut: before the large join a few rare terms of each item give ten documents whose
whole scores are a bound; terms that together can't reach it need not be joined, since a document that
has none of the others is out, and a document whose sum can't reach it with all of them is out too. What is
left is scored with all terms.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, ascii_lower, lean, new_path, ship, stage, unstage

TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERM, _BREAK = re.compile(TERMS), re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
#: Characters of a text that are split at once.
PART_CHARS = 1 << 20
BUCKETS = 64
#: Postings of a term that lie together; a more frequent term is cut into parts.
PART_ROWS = 100_000
#: Documents that hold an item's leading terms, about: enough to find a bound for its best ones.
LEAD = 2000
#: Fixed values of the score: parts in a thousand of the length that counts, and the scale of an impact.
LENGTH_SHARE, SCALE = 90, 1_000_000_000


def terms_of(text: str) -> Counter[str]:
    """Counts of the terms of a lower-cased text; a long one is taken in parts that end between terms."""
    found: Counter[str] = Counter()
    at = 0
    while at < len(text):
        to = _BREAK.search(text, at + PART_CHARS) if len(text) - at > PART_CHARS else None
        end = to.start() if to else len(text)
        found.update(_TERM.findall(text[at:end]))
        at = end
    return found


def impact(tf: Column, n: Column, n_docs: int, n_terms: int) -> Column:
    """What a term that a document of n terms holds tf times counts, before its weight."""
    div = lambda a, b: F.call_function("div", a, b)
    length = (100 - LENGTH_SHARE) + div(F.lit(LENGTH_SHARE).cast("long") * n * F.lit(n_docs).cast("long"), F.lit(max(1, n_terms)).cast("long"))
    return div(F.lit(SCALE).cast("long") * tf.cast("long"), 1000 * tf.cast("long") + 8 * length)


def weight(df: Column, n_docs: int) -> Column:
    """A term's weight by the documents that hold it."""
    return F.floor(1000 * F.log((2.0 * n_docs + 2) / (2 * df.cast("double") + 1))).cast("long")


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _narrow(df: DataFrame, rows: int) -> DataFrame:
    """A staged table of so many rows, broadcast if they are few enough; else joins shuffle it, and adaptive execution
    splits hot keys."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


@dataclass(frozen=True)
class Index:
    """documents: row, doc, n (its terms), terms (term, tf). postings: bucket, term, row, doc, impact. terms: term, bucket,
    df, most (its largest impact), w. All are staged, and only terms that were wanted are in them."""

    documents: DataFrame
    postings: DataFrame
    terms: DataFrame
    n_docs: int
    n_terms: int


def _counted(docs: DataFrame, wanted: DataFrame | None, text: str, key: str) -> DataFrame:
    """Documents that have terms, with the counts of the wanted ones. Workers look the wanted ones up if they are few;
    else all come and a join chooses."""
    spark = docs.sparkSession
    ship(spark)
    shared = None
    if wanted is not None:
        rows, size = wanted.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
        if rows <= BROADCAST_ROWS and size <= 100 * BROADCAST_ROWS:
            shared = spark.sparkContext.broadcast(frozenset(r.term for r in wanted.collect()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, n, offsets, terms, tfs = [], [], [0], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                found = terms_of(t)
                if found:
                    own = found.keys() & shared.value if shared else found.keys()
                    keep.append(i)
                    n.append(found.total())
                    terms += own
                    tfs += [found[x] for x in own]
                    offsets.append(len(terms))
            pairs = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(tfs, pa.int64())], names=["term", "tf"])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int32())), pa.array(n, pa.int64()), lists], names=["doc", "n", "terms"])

    schema = T.StructType([T.StructField("doc", docs.schema[key].dataType), *T.StructType.fromDDL("n long, terms array<struct<term: string, tf: long>>").fields])
    lowered = docs.select(F.col(key).alias("doc"), ascii_lower(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    out = stage(lowered.mapInArrow(lean(run), schema).withColumn("row", F.monotonically_increasing_id()), "counted")
    if wanted is None or shared is not None:
        return out
    all_terms = out.select("row", F.explode("terms").alias("t")).select("row", "t.*").join(wanted, "term", "left_semi")
    own = all_terms.groupBy("row").agg(F.collect_list(F.struct("term", "tf")).alias("terms"))  # one document's terms
    chosen = stage(out.drop("terms").join(own, "row", "left"), "counted")
    unstage(out)
    return chosen


def build_index(docs: DataFrame, wanted: DataFrame | None = None, text: str = "text", key: str = "doc_id") -> Index:
    """Postings of all documents, or of the wanted terms (column term, distinct, staged) only."""
    documents = _counted(docs, wanted, text, key)
    n_docs, n_terms = documents.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    matches = documents.select("row", "doc", "n", F.explode("terms").alias("t")).select("row", "doc", "t.term", impact(F.col("t.tf"), F.col("n"), n_docs, n_terms).alias("impact"))
    terms = matches.groupBy("term").agg(F.count("*").alias("df"), F.max("impact").alias("most"))
    terms = stage(terms.select("*", bucket_of(F.col("term")).alias("bucket"), weight(F.col("df"), n_docs).alias("w")), "terms")
    # a bucket is written in parts of about PART_ROWS postings, so that no frequent term makes a large one
    parts = terms.groupBy("bucket").agg(F.ceil(F.sum("df") / PART_ROWS).alias("parts"))  # BUCKETS rows
    placed = matches.withColumn("bucket", bucket_of(F.col("term"))).join(F.broadcast(parts), "bucket")
    placed = placed.withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts"))).repartition("bucket", "part").sortWithinPartitions("bucket", "term")
    path = new_path(docs.sparkSession, "postings")
    placed.select("bucket", "term", "row", "doc", "impact").write.partitionBy("bucket").parquet(path)
    schema = T.StructType([*(f for f in placed.schema if f.name in ("term", "row", "doc", "impact")), T.StructField("bucket", T.IntegerType())])
    return Index(documents, docs.sparkSession.read.schema(schema).parquet(path), terms, n_docs, n_terms)


def _sums(index: Index, asked: DataFrame, rows: int) -> DataFrame:
    """(item, row, doc, score) of the documents that hold any of the asked terms (item, bucket, term, w), by these alone."""
    met = index.postings.join(_narrow(asked, rows), ["bucket", "term"])
    return met.groupBy("item", "row").agg(F.first("doc").alias("doc"), F.sum(F.col("w") * F.col("impact")).alias("score"))


def _whole(index: Index, pairs: DataFrame, asked: DataFrame, rows: int) -> DataFrame:
    """(item, row, doc, score) of pairs of item and document by all terms of the item."""
    pairs = stage(pairs.select("item", "row"), "pairs")
    own = index.documents.join(_narrow(pairs, pairs.count()), "row").select("item", "row", "doc", "n", F.explode("terms").alias("t"))
    met = own.select("item", "row", "doc", "t.term", impact(F.col("t.tf"), F.col("n"), index.n_docs, index.n_terms).alias("impact"))
    met = met.join(_narrow(asked.select("item", "term", "w"), rows), ["item", "term"])
    return met.groupBy("item", "row").agg(F.first("doc").alias("doc"), F.sum(F.col("w") * F.col("impact")).alias("score"))


def _best(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc"), "row")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 10, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id") -> DataFrame:
    """(item_id, rank, doc_id, score): of each item the k documents with the highest scores above 0, or all, if
    fewer; equal scores by ascending doc_id, null last.

    Null and empty texts have no terms, so they are neither found nor find anything. Rows that repeat an id are
    documents, or items, of their own. Whole texts count, however long. Empty tables give no rows. Other columns are
    ignored."""
    lowered = ascii_lower(F.coalesce(F.col(item_text), F.lit("")))
    own = items.select(F.col(item_key).alias("item_id"), F.monotonically_increasing_id().alias("item"), F.array_distinct(F.regexp_extract_all(lowered, F.lit(TERMS), F.lit(0))).alias("terms"))
    own = stage(own, "items")
    asked = own.select("item", F.explode("terms").alias("term"))
    wanted = stage(asked.select("term").distinct(), "wanted")
    index = build_index(docs, wanted, text, key)
    asked = stage(asked.join(index.terms.filter("w > 0"), "term").withColumn("top", F.col("w") * F.col("most")), "asked")
    rows = asked.count()

    by_item = Window.partitionBy("item")  # an item's terms
    before = F.sum("df").over(by_item.orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1))
    lead = asked.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < LEAD).drop("before")
    first = _whole(index, _best(_sums(index, stage(lead, "lead"), rows), k), asked, rows)
    bounds = first.groupBy("item").agg(F.when(F.count("*") == k, F.min("score")).otherwise(0).alias("bound"))
    bounds = stage(bounds, "bounds")
    below = F.sum("top").over(by_item.orderBy("top", "term").rowsBetween(Window.unboundedPreceding, 0))
    split = asked.join(bounds, "item", "left").withColumn("bound", F.coalesce("bound", F.lit(0))).withColumn("needed", below >= F.col("bound"))
    split = stage(split, "split")
    rests = split.groupBy("item").agg(F.first("bound").alias("bound"), F.coalesce(F.sum(F.when(~F.col("needed"), F.col("top"))), F.lit(0)).alias("rest"))
    rests = stage(rests, "rests")
    needed = split.filter("needed").select("item", "bucket", "term", "w")
    near = _sums(index, needed, rows).join(_narrow(rests, rows), "item").filter(F.col("score") + F.col("rest") >= F.col("bound"))
    best = _best(_whole(index, near, asked, rows), k)
    return best.join(_narrow(own.select("item", "item_id"), own.count()), "item").select("item_id", "rank", F.col("doc").alias("doc_id"), "score")
