"""Exact and near deduplication against brute force."""

import math
import random
import re

import numpy as np
import pytest
from jobsift.llm import bloom_dedup, chosen_path
from jobsift.llm.bloom_dedup import exact_dedup
from jobsift.llm.chosen_path import near_duplicates
from jobsift.llm.common import join_groups, stage
from jobsift.llm.components import components
from jobsift.llm.queries import ORACLE_SQL, QUERIES
from jobsift.llm.shingles import shingle_sets
from pyspark.sql import functions as F
from tests.parity import assert_same, connect

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, kept string, _h int"


def lower(t):
    return "".join(c.lower() if c.isascii() else c for c in t)


def test_exact_equals_sql(spark):
    assert_same(QUERIES["op8_bloom_exact_dedup"](spark, SF), connect(SF), ORACLE_SQL["op8_bloom_exact_dedup"])


def test_exact_edges(spark):
    rows = [(1, "A b"), (2, "a B"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, "x" * 200_000), (8, "X" * 200_000), (None, "a b"), (9, "same"), (9, "same"), (9, "other"), (None, "alone")]
    df = spark.createDataFrame([(i, t, "old", 0) for i, t in rows], SCHEMA).repartition(3)
    got = exact_dedup(df)
    assert got.columns == ["doc_id", "text", "_h", "keep_id", "group_size", "kept", "text_sha256"]
    out = [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got.collect()]
    assert len(out) == len(rows)
    assert {(1, 2, 3, False), (2, 2, 3, True), (None, 2, 3, False), (3, 4, 2, False), (4, 4, 2, True), (5, 5, 1, True), (6, 6, 1, True)} <= set(out)
    assert {(7, 8, 2, False), (8, 8, 2, True), (None, None, 1, True)} <= set(out)
    nine = sorted(x for x in out if x[0] == 9)
    assert nine == [(9, 9, 1, True), (9, 9, 2, False), (9, 9, 2, True)]
    assert exact_dedup(df.limit(0)).count() == 0


@pytest.mark.parametrize("rows", [0, 200_000])
def test_components(spark, monkeypatch, rows):
    monkeypatch.setattr("jobsift.llm.components.BROADCAST_ROWS", rows)
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 130)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(5, 5), (1, 0), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    up = {}

    def find(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    nodes = {x for a, b in links if a is not None and a != b for x in (a, b)}
    assert got == {x: find(x) for x in nodes}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))


def brute(rows):
    """Smallest id reachable, by position."""
    sets = []
    for _, t in rows:
        w = words_of(t)
        sets.append(set(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 85 * len(sets[a] | sets[b]):
                up[find(a)] = find(b)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(least.get(find(i), key), key)
    return [len(s) for s in sets], [(least.get(find(i)) if sets[i] else rows[i][0]) for i in range(len(rows))]


def near_copies(n, seed):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(3000)}" for _ in range(rng.randrange(40, 200))] for _ in range(n // 8)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append((i * 3 + 1, rng.choice([" ", "\n"]).join(w)))
    return rows


def test_shingles_match_words():
    texts = ["a b c d e f", "A  b\tc\nd e f", "a b", None, "", "é É x y z w", "a b c d e", "a b c d e a b c d e", "x" * 3_000_000 + " y"]
    sets = shingle_sets(texts)
    assert (sets[0] == sets[1]).all() and len(sets[0]) == 2
    assert [len(s) for s in sets] == [2, 2, 1, 0, 0, 2, 1, 5, 1]
    whole = shingle_sets(["p q r s t u v"] * 3)
    assert (whole[0] == whole[2]).all() and len(shingle_sets([])) == 0


@pytest.mark.parametrize("node_rows", [chosen_path.NODE_ROWS, 8])
def test_near_equals_brute_force(spark, monkeypatch, node_rows):
    monkeypatch.setattr(chosen_path, "NODE_ROWS", node_rows)
    monkeypatch.setattr(chosen_path, "BLOCK_CLASSES", min(node_rows, 3))
    monkeypatch.setattr(chosen_path, "STRAYS", 2)
    rows = near_copies(240, 5) + [(None, "a b c d e f"), (2, "A b c d e f"), (5, ""), (6, None), (8, "a b c"), (11, "a B c"), (14, "a  b"), (17, "solo word"), (8, "one two three four five six"), (20, "é"), (23, "É")]
    df = spark.createDataFrame([(i, t, "old", 0) for i, t in rows], SCHEMA).repartition(3)
    sizes, want = brute(rows)
    got = near_duplicates(df)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    key = lambda x: tuple((v is None, v) for v in x)
    out = sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got.collect()], key=key)
    assert out == sorted([(r[0], n, c) for r, n, c in zip(rows, sizes, want, strict=True)], key=key)


def test_near_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert near_duplicates(spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string")).filter("kept").count() == 2


def test_near_query_equals_sql(spark):
    assert_same(QUERIES["op10_chosen_path_near_dedup"](spark, SF), connect(SF), ORACLE_SQL["op10_chosen_path_near_dedup"])


def test_near_query(spark):
    got = QUERIES["op10_chosen_path_near_dedup"](spark, "/root/testdata/sf0.001").toPandas().sort_values("doc_id")
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    sizes, want = brute([tuple(r) for r in rows])
    assert got.n_shingles.tolist() == sizes and got.component_id.tolist() == want


def test_near_stage_equals_brute_force_at_its_share(spark, monkeypatch):
    import corpus_pipeline as p

    rng = random.Random(3)
    rows = []
    for i in range(60):  # pairs with Jaccard similarities from 0.74 to 0.88 by words changed at the end
        w = [f"p{i}w{k}" for k in range(104)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[: 104 - (6 + i % 10)] + [f"x{rng.randrange(10**9)}" for _ in range(6 + i % 10)]))]
    sets = [set(zip(*[t.split()[k:] for k in range(5)])) for _, t in rows]
    share = [len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in range(0, len(rows), 2)]
    assert any(0.8 <= x < 0.85 for x in share) and any(x < 0.8 for x in share) and any(x >= 0.85 for x in share)
    want = {rows[i][0] for i in range(len(rows)) if i % 2 == 0 or share[i // 2] < 0.8}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in p.near_deduplicated(spark, docs, SF).collect()} == want
    monkeypatch.setattr(chosen_path, "NODE_ROWS", 8)
    assert {r.doc_id for r in p.near_deduplicated(spark, docs, SF).collect()} == want


def test_signatures_follow_the_share():
    for share in (0.5, 0.8, 0.85, 0.95):
        lost = sum(math.comb(128, k) * share**k * (1 - share) ** (128 - k) for k in range(129) if k < chosen_path._agree(share) * 128)
        assert lost < 5e-4


@pytest.mark.parametrize("share", [0.8, 0.85])
def test_trees_keep_pairs_in_large_nodes(share):
    """Pairs of just the wanted similarity in thousands of near copies, no node being small enough to compare."""
    rng, lost, pairs = np.random.default_rng(11), 0, 0
    roots = chosen_path._roots(share)
    assert len({p for p, _ in roots}) == len({i for _, i in roots}) == len(roots)
    for _ in range(20):
        agree = rng.random((1500, 128)) < share
        sig = rng.integers(0, 2**32, (1500, 128), dtype=np.uint32)
        who = np.concatenate([np.flatnonzero(agree[:, i]) for _, i in roots])
        path = np.concatenate([chosen_path._child(np.full(agree[:, i].sum(), p, np.uint64), np.full(agree[:, i].sum(), i), sig[agree[:, i], i]) for p, i in roots])
        for _ in range(chosen_path.DEPTH - 1):
            row, at = np.nonzero(chosen_path._chosen(path.view(np.uint64), share))
            met = agree[who[row], at]
            row, at = row[met], at[met]
            path, who = chosen_path._child(path.view(np.uint64)[row], at, sig[who[row], at]), who[row]
        kept = np.zeros(1500, bool)
        kept[who] = True
        lost += int((~kept | (agree.sum(axis=1) < chosen_path._agree(share) * 128)).sum())
        pairs += 1500
    assert lost <= 6, f"{lost} of {pairs}"


def test_near_group_of_thousands(spark, monkeypatch):
    """Pairs at 0.85 among copies of one text that are less similar to each other: one node holds all."""
    monkeypatch.setattr(chosen_path, "NODE_ROWS", 64)
    rng = random.Random(4)
    common, rows = [f"c{k}" for k in range(84)], []
    for i in range(1000):
        own = [f"p{i}w{k}" for k in range(11)]
        for j in (0, 1):
            rows.append((2 * i + j, " ".join(common + own + [f"x{rng.randrange(10**9)}" for _ in range(8)])))
    sets = [set(zip(*[t.split()[k:] for k in range(5)])) for _, t in rows]
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert 0.85 <= like(0, 1) < 0.86 and like(0, 2) < 0.85
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert all(r.component_id == r.doc_id // 2 * 2 for r in got.collect())


@pytest.mark.parametrize("ranges,part_blocks", [(1 << 16, 1 << 14), (50, 1)])
def test_filter_passes_unique_rows_in_any_number_of_parts(spark, monkeypatch, ranges, part_blocks):
    monkeypatch.setattr(bloom_dedup, "RANGE_ROWS", ranges)
    monkeypatch.setattr(bloom_dedup, "PART_BLOCKS", part_blocks)
    monkeypatch.setattr(bloom_dedup, "BLOCK_BITS", 32768 if part_blocks > 1 else 2048)
    rows = [(i, f"text {i // 2 if i < 1500 else i}") for i in range(3000)]  # 750 pairs
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    hashes = df.withColumn("h", F.xxhash64("text"))
    made, bits = bloom_dedup.repeat_filter(hashes.select("h"), 3000)
    parts = made.parts(hashes, bloom_dedup._short(F.col("h"), bits))
    assert len(parts) == made.blocks // part_blocks + (made.blocks % part_blocks > 0) and (part_blocks > 1) == (len(parts) == 1)
    got = [r for p in parts for r in p.collect()]
    assert sorted(r.doc_id for r in got) == list(range(3000))
    assert all(r._jobsift_maybe for r in got if r.doc_id < 1500)
    assert sum(r._jobsift_maybe for r in got if r.doc_id >= 1500) < 60
    assert sorted((r.keep_id, r.group_size) for r in exact_dedup(df).collect() if r.kept) == sorted([(2 * i + 1, 2) for i in range(750)] + [(i, 1) for i in range(1500, 3000)])


def test_first_pass_sends_lists_not_rows(spark):
    hashes = spark.range(0, 50_000, 1, 8).select(F.xxhash64("id").alias("h"))
    plan = bloom_dedup._maybe_repeated(hashes, 0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hash") == 1 and "partial_collect_list" in plan


@pytest.mark.parametrize("rows", [0, 200_000])
def test_without(spark, monkeypatch, rows):
    monkeypatch.setattr(bloom_dedup, "BROADCAST_ROWS", rows)
    df = spark.createDataFrame([(None if i % 10 == 3 else i, f"t{i}") for i in range(100)], "k long, text string").withColumn("key", F.struct("k", F.lit(1)))
    gone = stage(df.filter("k is null or k < 50").select("key").distinct(), "gone")
    assert sorted(r.k for r in bloom_dedup.without(df, gone, "key").collect()) == [i for i in range(50, 100) if i % 10 != 3]


def test_blocks_join_what_brute_force_joins(spark):
    """Groups of a large component, of small ones, and of sets that link across blocks only."""
    rng = random.Random(9)
    rows, truth = [], []
    for g in range(3):
        base = [rng.randrange(2**60) for _ in range(40)]
        for k in range(60):
            if g == 0 or g == 1 and k % 3:  # copies of one set; the others are like one other set at most
                s = set(base[: 39 + k % 2])
            else:
                s = {hash((g, k // 2, j)) & (2**62 - 1) for j in range(40)} | {k}
            rows.append((g, 100 * g + k, 60 // 7, np.array(sorted(s), np.uint64).tobytes()))
            truth.append((g, 100 * g + k, s))
    up = {}

    def find(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for i, (g, a, s) in enumerate(truth):
        for h, b, t in truth[:i]:
            if g == h and len(s & t) * 100 >= 85 * len(s | t):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    df = stage(spark.createDataFrame(rows, "grp long, rid long, blocks long, hashes binary").repartition(3), "sets")
    links = chosen_path.linked_in_blocks(df, chosen_path._by_sets, (85, 100), ["hashes"])
    got = {r.node: r.root for r in components(links).collect()}
    assert {a: got.get(a, a) for _, a, _ in truth} == {a: find(a) for _, a, _ in truth}
    assert links.count() < 3 * len(rows)


def test_hot_nodes_and_hubs_meet_by_broadcast(spark):
    """A key with a thousandth of all rows doesn't meet its one row in a shuffle."""
    rows = stage(spark.range(0, 4000).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("path"), "id"), "rows")
    counts = stage(rows.groupBy("path").agg(F.count("*").alias("members")), "counts")
    joined = join_groups(rows, counts, "path", "members", 4000)
    parts = joined.filter("path <> 7").groupBy(F.spark_partition_id()).count().collect()
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert joined.filter("path = 7").count() == 2001 and parts and "BroadcastHashJoin" in plan


def tasks_of(spark, work):
    """How many tasks work() takes where an exchange has 64 partitions that aren't joined together."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    name = f"tasks-{random.random()}"
    spark.sparkContext.setJobGroup(name, name)
    try:
        out, seen = work(), spark.sparkContext.statusTracker()
        stages = {s for j in seen.getJobIdsForGroup(name) for s in seen.getJobInfo(j).stageIds}
        return out, sum(x.numCompletedTasks for s in stages if (x := seen.getStageInfo(s)))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)


def test_few_links_and_groups_take_no_exchanges(spark):
    """A round of stars over a handful of links is four exchanges, of nearly only empty tasks."""
    links = stage(spark.range(0, 3000).select(F.col("id").alias("a"), (F.col("id") + F.when(F.col("id") % 10 < 9, 1).otherwise(0)).alias("b")), "chains")
    rows, tasks = tasks_of(spark, lambda: components(links).collect())
    assert {(r.node, r.root) for r in rows} == {(i, i // 10 * 10) for i in range(3000)} and len(rows) == 3000
    assert tasks < 64
    groups = stage(spark.range(0, 300).select(F.col("id").alias("a"), F.lit(10).alias("n")), "tens")
    rows, tasks = tasks_of(spark, lambda: join_groups(links, groups, "a", "n", 3000).collect())
    assert len(rows) == 300 and tasks < 64
