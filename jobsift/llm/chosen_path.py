"""Near-duplicate detection by a chosen-path set similarity join (Christiani, Pagh and Sivertsen, 2018).

Documents with the same shingle set form one class. Independent trees branch the classes by selected
minwise tokens; small nodes are compared exhaustively on their signatures, larger ones branch again.
Every tree begins at one position of its own and keeps a pair of the wanted similarity in 1.25 nodes a
level on average (a branching factor above 1 / threshold); as many trees grow as the wanted recall needs
when every node is large on every level. What a task finds similar it reduces to a spanning
forest, never a list of all pairs. The forests' components, candidate clusters, are then compared on
full shingle sets, and the confirmed links make the result. A node or cluster too large for one task is dealt
out in blocks; blocks meet the group's first one, and only what doesn't join the group's largest component
meets them all. So a large node of copies costs in proportion to its size and needs no branching, and a
large node of different texts branches.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom_dedup import KeyFilter
from .common import BROADCAST_ROWS, join_groups, lean, settle, ship, stage, together, unstage
from .components import Forest, components
from .shingles import minhashes, mix, set_key, shingle_sets

SIGNATURE = 128
#: A pair of just the wanted similarity may be lost so often, over all levels and the comparison of signatures.
MISS = 5e-5
#: Wanted similarity, and how often a pair of just that similarity is expected in the children of a node.
THRESHOLD, SURVIVE = (85, 100), 1.25
NODE_ROWS = 1024
DEPTH = 4
#: Signatures must agree in a share that lies so many standard deviations below the wanted similarity.
AGREE_DEVIATIONS = 5
#: A block of a large group has about so many classes; of a cluster, so many shingles in all at most.
BLOCK_CLASSES, BLOCK_SHINGLES = 128, 200_000
#: Strays that are compared with a block at once.
STRAYS = 1024

_FACTORS = np.random.default_rng(7).integers(1, 2**63, size=SIGNATURE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _agree(threshold: float) -> float:
    return threshold - AGREE_DEVIATIONS * (threshold * (1 - threshold) / SIGNATURE) ** 0.5


def _chosen(path: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the SIGNATURE positions each node branches on."""
    at = mix(path.astype(np.uint64)[:, None] + np.arange(1, SIGNATURE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (at >> np.uint64(11)) < np.uint64(int(2**53 * SURVIVE / (threshold * SIGNATURE)))


def _child(path: np.ndarray, position: np.ndarray, token: np.ndarray) -> np.ndarray:
    x = mix(path.astype(np.uint64) + np.uint64(0xA24BAED4963EE407) * (position.astype(np.uint64) + np.uint64(1)))
    return mix(x + token.astype(np.uint64)).astype(np.int64)


def miss(threshold: float, trees: int) -> float:
    """How often a pair of just this similarity is lost if all its nodes are large: its signatures agree too
    little, or no tree has a node for it at the last level."""
    p, lost = SURVIVE / (threshold * SIGNATURE), 0.0
    for k in range(SIGNATURE + 1):  # positions that agree
        gone = 0.0
        for _ in range(DEPTH - 1):
            gone = (1 - p + p * gone) ** k
        if k < _agree(threshold) * SIGNATURE:
            none = 1.0
        else:
            none = sum(comb(k, j) * comb(SIGNATURE - k, trees - j) * gone**j for j in range(trees + 1)) / comb(SIGNATURE, trees)
        lost += comb(SIGNATURE, k) * threshold**k * (1 - threshold) ** (SIGNATURE - k) * none
    return lost


@cache
def _trees(threshold: float) -> int:
    """The fewest trees that lose no more than MISS; all positions if none do."""
    return next((t for t in range(1, SIGNATURE) if miss(threshold, t) <= MISS), SIGNATURE)


def _roots(threshold: float) -> list[tuple[int, int]]:
    """A root and the one position that it branches on for each tree."""
    return [(int(mix(np.array([i + 1], np.uint64))[0]), i) for i in range(_trees(threshold))]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            sets = shingle_sets(part.column(1).to_pylist())
            cut = [s if len(s) else None for s in sets]
            signed = [None if s is None else minhashes(s, _FACTORS) for s in cut]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([None if s is None else set_key(s) for s in cut], pa.binary()),
                    pa.array([None if s is None else s.tobytes() for s in signed], pa.binary()),
                    pa.array([None if s is None else s.astype(np.uint8).tobytes() for s in signed], pa.binary()),
                ],
                names=["id", "n", "cid", "sig", "low"],
            )


def _branch(threshold: float, first: list[tuple[int, int]] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, SIGNATURE)
            rid = batch.column("rid").to_numpy()
            if first is not None:
                made = [_child(np.full(len(rid), p, np.uint64), np.full(len(rid), i), sig[:, i]) for p, i in first]
                path, who = np.concatenate(made), np.tile(rid, len(first))
            else:
                old = batch.column("path").to_numpy()
                row, position = np.nonzero(_chosen(old.view(np.uint64), threshold))
                path, who = _child(old.view(np.uint64)[row], position, sig[row, position]), rid[row]
            yield pa.RecordBatch.from_arrays([pa.array(path, pa.int64()), pa.array(who, pa.int64())], names=["path", "rid"])

    return run


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[pd.DataFrame]:
    """Whole groups, as many together as make up so many rows, from batches sorted by the keys."""
    held: list[pd.DataFrame] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch.to_pandas())
        size += batch.num_rows
        if size >= rows:
            whole = pd.concat(held, ignore_index=True)
            last = (whole[keys] == whole[keys].iloc[-1]).all(axis=1).to_numpy()
            cut = len(whole) - int(np.argmin(last[::-1])) if not last.all() else 0
            if cut:
                yield whole.iloc[:cut]
            held, size = [whole.iloc[cut:].reset_index(drop=True)], len(whole) - cut
    if size:
        yield pd.concat(held, ignore_index=True)


def _groups(frame: pd.DataFrame, keys: list[str]) -> list[tuple[int, int]]:
    new = (frame[keys].to_numpy()[1:] != frame[keys].to_numpy()[:-1]).any(axis=1)
    at = [0, *(np.flatnonzero(new) + 1).tolist(), len(frame)]
    return [(a, b) for a, b in zip(at[:-1], at[1:], strict=True) if b - a > 1]


def _edges(forest: Forest) -> pa.RecordBatch:
    stars = list(forest.stars())
    return pa.RecordBatch.from_arrays(
        [pa.array([x[0] for x in stars], pa.int64()), pa.array([x[1] for x in stars], pa.int64())], names=["a", "b"]
    )


def _compare_nodes(share: tuple[int, int]):
    """Similar pairs by signature and set size of each node; their spanning forest."""
    least = _agree(share[0] / share[1]) * SIGNATURE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for frame in _runs(batches, ["path"], 8192):
            sig = np.frombuffer(b"".join(frame["low"]), np.uint8).reshape(-1, SIGNATURE)
            rid, n = frame["rid"].to_numpy(), frame["n"].to_numpy()
            groups = _groups(frame, ["path"])
            two = np.array([a for a, b in groups if b - a == 2], dtype=np.int64)
            pairs = [(two, two + 1)] if len(two) else []
            for a, b in (g for g in groups if g[1] - g[0] > 2):
                for at in range(a, b, 64):
                    i, j = np.triu_indices(min(64, b - at), 1, b - at)
                    pairs.append((i + at, j + at))
            for i, j in pairs:
                fits = np.minimum(n[i], n[j]) * share[1] >= np.maximum(n[i], n[j]) * share[0]
                i, j = i[fits], j[fits]
                for at in range(0, len(i), 1 << 15):
                    x, y = i[at : at + (1 << 15)], j[at : at + (1 << 15)]
                    near = (sig[x] == sig[y]).sum(axis=1) >= least
                    for p, q in zip(rid[x[near]].tolist(), rid[y[near]].tolist(), strict=True):
                        forest.join(p, q)
        yield _edges(forest)

    return run


def _sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of those texts that are what their class was made from."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            cid = part.column("cid").to_pylist()
            sets = shingle_sets(part.column("text").to_pylist())
            own = [i for i, s in enumerate(sets) if len(s) and set_key(s) == cid[i]]
            yield pa.RecordBatch.from_arrays(
                [part.column(c).take(pa.array(own, pa.int64())) for c in ("grp", "rid", "blocks")] + [pa.array([sets[i].tobytes() for i in own], pa.binary())],
                names=["grp", "rid", "blocks", "hashes"],
            )


def _named_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [s for s in shingle_sets(batch.column(0).to_pylist()) if len(s)]
        yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["cid", "hashes"])


def _full_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(grp, rid, blocks, hashes) of the n wanted classes, staged as (grp, rid, blocks, cid, rep). Texts don't move. Up to
    BROADCAST_ROWS classes are broadcast. Of more, a filter of their documents' ids says which texts are read
    again; those texts' sets, one of each class, meet the classes by name, so an id that many rows have is no hot key."""
    if n <= BROADCAST_ROWS:
        there = docs.join(F.broadcast(wanted), docs["id"].eqNullSafe(wanted["rep"])).select("grp", "rid", "blocks", "cid", "text")
        return there.mapInArrow(lean(_sets_of), "grp long, rid long, blocks long, hashes binary")
    ids = KeyFilter(wanted.select(F.xxhash64("rep").alias("g")), n)
    tested = ids.parts(docs.withColumn("_jobsift_h", F.xxhash64("id")), F.col("_jobsift_h"))
    read = reduce(DataFrame.union, [t.filter("_jobsift_maybe").select("text") for t in tested])
    sets = read.mapInArrow(lean(_named_sets), "cid binary, hashes binary").groupBy("cid").agg(F.first("hashes").alias("hashes"))
    return wanted.drop("rep").join(sets, "cid").select("grp", "rid", "blocks", "hashes")


def _by_signature(part: pd.DataFrame, share: tuple[int, int]):
    """A test of row x against rows y: signatures agree as much as those of similar sets."""
    least = _agree(share[0] / share[1]) * SIGNATURE
    sig, n = np.frombuffer(b"".join(part["low"]), np.uint8).reshape(-1, SIGNATURE), part["n"].to_numpy()

    def test(x: int, y: np.ndarray) -> np.ndarray:
        y = y[np.minimum(n[y], n[x]) * share[1] >= np.maximum(n[y], n[x]) * share[0]]
        return y[(sig[y] == sig[x]).sum(axis=1) >= least]

    return test


def _by_sets(part: pd.DataFrame, share: tuple[int, int]):
    """A test of row x against rows y: full sets are similar."""
    sets = [np.frombuffer(x, np.uint64) for x in part["hashes"]]
    n = np.array([len(s) for s in sets])
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    at = np.concatenate(([0], np.cumsum(n)))[:-1]
    mark = np.zeros(int(codes.max()) + 1, dtype=np.int32)

    def test(x: int, y: np.ndarray) -> np.ndarray:
        y = y[np.minimum(n[y], n[x]) * share[1] >= np.maximum(n[y], n[x]) * share[0]]
        if not len(y):
            return y
        first = np.concatenate(([0], np.cumsum(n[y])))
        where = np.repeat(at[y] - first[:-1], n[y]) + np.arange(first[-1])
        mine = codes[at[x] : at[x] + n[x]]
        mark[mine] = 1
        common = np.add.reduceat(mark[codes[where]], first[:-1])
        mark[mine] = 0
        return y[common * share[1] >= (n[y] + n[x] - common) * share[0]]

    return test


def _spanning(part: pd.DataFrame, test) -> Iterator[tuple[int, int]]:
    """Links that join the rows of a task; rows of which it is known that they are joined aren't compared. If the
    task has two sides, only rows of different sides are."""
    rid, side, label = part["rid"].to_numpy(), part["side"].to_numpy(), part["label"].to_numpy().copy()
    two = bool(side.any())
    for x in np.flatnonzero(side == 0):
        can = label != label[x]
        if two:
            can &= side == 1
        else:
            can[:x] = False
        if can.any() and len(y := test(x, np.flatnonzero(can))):
            joined, one = np.unique(label[y], return_index=True)
            label[np.isin(label, joined)] = label[x]
            yield from ((int(rid[x]), int(rid[k])) for k in y[one])


_TASK = ["grp", "i", "j"]


def _compare_tasks(test_of, share: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in _runs(batches, _TASK, 2048):
            found = []
            for a, b in _groups(frame, _TASK):
                part = frame.iloc[a:b].drop_duplicates(["rid", "side"], ignore_index=True)
                found += _spanning(part, test_of(part, share))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def _upto(n: str) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.col(n) - 1)


def _compare(tasks: DataFrame, test_of, share: tuple[int, int]) -> DataFrame:
    return tasks.repartition(*_TASK).sortWithinPartitions(*_TASK).mapInArrow(lean(_compare_tasks(test_of, share)), "a long, b long")


def first_links(rows: DataFrame, test_of, share: tuple[int, int], more: list[str]) -> DataFrame:
    """Links (a, b) in groups dealt out in blocks; rows are (grp, rid, blocks, *more). Each block is compared with
    itself and with the group's first block."""
    own = F.pmod(F.xxhash64("rid"), F.col("blocks"))
    meets = F.explode(F.when(F.col("own") == 0, _upto("blocks")).otherwise(F.array(F.lit(0).cast("long"), "own"))).alias("other")
    tasks = rows.withColumn("own", own).select("*", meets).withColumns({
        "i": F.when(F.col("own") == 0, F.lit(0).cast("long")).otherwise(F.col("other")),
        "j": F.greatest("own", "other"),
        "label": F.col("rid"),
    })
    tasks = tasks.withColumn("side", (F.col("own") != F.col("i")).cast("int"))
    return _compare(tasks.select(*_TASK, "side", "label", "rid", *more), test_of, share)


def with_strays(members: DataFrame, links: DataFrame) -> DataFrame:
    """members (grp, rid, blocks, ...), staged, with label, the component they have by the links, and of their group
    the largest label and strays, how many members have another. Groups without strays are left out: all their
    members are joined."""
    joined = components(links).select(F.col("node").alias("rid"), F.col("root").alias("label"))
    named = stage(members.join(joined, "rid", "left").withColumn("label", F.coalesce("label", "rid")), "members")
    n = named.count()
    parts = together(named, n).groupBy("grp", "label").agg(F.count("*").alias("size"))
    largest = parts.groupBy("grp").agg(F.max_by("label", F.struct("size", "label")).alias("largest"), F.sum("size").alias("all"), (F.sum("size") - F.max("size")).alias("strays"))
    largest = stage(largest.filter("strays > 0"), "largest")
    return stage(join_groups(named, largest, "grp", "all", n).drop("all"), "strays")


def stray_links(known: DataFrame, payload: DataFrame, on: list[str], test_of, share: tuple[int, int], more: list[str]) -> DataFrame:
    """Links (a, b) of strays with what of their group has another label, in all blocks. known: from with_strays()."""
    known = known.withColumn("s_blocks", F.ceil(F.col("strays") / STRAYS))
    strays = known.filter("label <> largest").select("grp", "rid", "label", F.pmod(F.xxhash64(F.lit(1), "rid"), "s_blocks").alias("i"), F.explode(_upto("blocks")).alias("j"), F.lit(0).alias("side"))
    own = F.pmod(F.xxhash64("rid"), F.col("blocks"))
    others = known.select("grp", "rid", "label", F.explode(_upto("s_blocks")).alias("i"), own.alias("j"), F.lit(1).alias("side"))
    met = strays.unionByName(others).join(payload.select(*on, *more), on)
    return _compare(met.select(*_TASK, "side", "label", "rid", *more), test_of, share)


def linked_in_blocks(rows: DataFrame, test_of, share: tuple[int, int], more: list[str]) -> DataFrame:
    """Links (a, b) that join the similar rows of each group; rows are staged as (grp, rid, blocks, *more), each rid
    in one group.

    What is not in its group's largest component after first_links() (few rows, where a group is one of
    copies) is compared with all blocks, so no link between different components is missed, and no pair is
    met that is joined already."""
    links = stage(first_links(rows, test_of, share, more), "links")
    dealt = rows.filter("blocks > 1").select("grp", "rid", "blocks")
    if dealt.isEmpty():
        return links
    known = with_strays(dealt, links)
    return links.union(stray_links(known, rows, ["grp", "rid"], test_of, share, more))


def _large_nodes(large: DataFrame, n_large: int, signed: DataFrame, share: tuple[int, int], last: bool) -> tuple[DataFrame, DataFrame]:
    """Similar pairs (a, b) of nodes too large for one task, with n_large rows, and the rows (path, rid) of those nodes that
    must branch again.

    Each class is compared once first, in the largest of its nodes; that joins groups of copies. Of each node
    only strays from its largest component are then compared with all, unless there are too many of them:
    then the node is one of different texts that have a token in common, and branches, as long as it can."""
    blocks = lambda n: F.ceil(F.col(n) / BLOCK_CLASSES).alias("blocks")
    own = together(large, n_large).groupBy("rid").agg(F.max(F.struct("members", "path")).alias("at")).select("rid", F.col("at.path").alias("grp"))
    own = stage(own, "own")
    n_own = own.count()
    sizes = stage(together(own, n_own).groupBy("grp").agg(F.count("*").alias("members")), "sizes")
    dealt = join_groups(own, sizes, "grp", "members", n_own).select("grp", "rid", blocks("members"))
    if n_own <= BROADCAST_ROWS:
        dealt = F.broadcast(dealt)
    links = stage(first_links(signed.join(dealt, "rid"), _by_signature, share, ["n", "low"]), "links")
    known = with_strays(large.select(F.col("path").alias("grp"), "rid", blocks("members")), links)
    few = known if last else known.filter(F.col("strays") <= NODE_ROWS)
    found = links.union(stray_links(few, signed, ["rid"], _by_signature, share, ["n", "low"]))
    return stage(found, "similar"), known.filter(F.col("strays") > NODE_ROWS).select(F.col("grp").alias("path"), "rid")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", share: tuple[int, int] = THRESHOLD) -> DataFrame:
    """(key, n_shingles, component_id, kept) for every row.

    Rows whose 5-word shingle sets have a Jaccard similarity of at least share[0] / share[1] are linked;
    component_id is the smallest key reachable by links, the row's own included, and kept is key =
    component_id. Rows without words link with nothing. Null keys are allowed: they are never a
    component's name unless all its keys are null, and such rows are all kept. Rows that repeat a key
    are all kept if it names the component. Very long texts are read whole, an empty table gives no rows, and
    other columns are ignored, whatever their names. Lost links are those that no tree brings into a node or whose signatures agree too little: fewer than one in 10,000
    at the threshold itself, by miss(), however large the nodes are."""
    ship(docs.sparkSession)
    docs = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    id_type = docs.schema["id"].dataType.simpleString()
    sketch = stage(docs.mapInArrow(lean(_sketch), f"id {id_type}, n long, cid binary, sig binary, low binary"), "sketch")
    name_of = settle(lambda: _names(docs, sketch, share), "names")
    out = join_groups(sketch.select("id", "n", "cid"), name_of, "cid", "copies", sketch.count(), "left")
    component = F.when(F.col("_met"), F.col("component_id")).otherwise(F.col("id"))
    out = out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


def _names(docs: DataFrame, sketch: DataFrame, share: tuple[int, int]) -> DataFrame:
    """(cid, component_id, copies, _met) of each class whose rows don't just name themselves."""
    threshold = share[0] / share[1]
    classes = sketch.filter("cid is not null").groupBy("cid").agg(
        F.min("id").alias("rep"), F.max("n").alias("n"), F.count("*").alias("copies"), F.max("sig").alias("sig"), F.max("low").alias("low")
    )
    classes = stage(classes.withColumn("rid", F.monotonically_increasing_id()), "classes")
    n_classes = classes.count()
    leaves: list[DataFrame] = []
    found: list[DataFrame] = []
    signed = classes.select("rid", "n", "low")
    rows = classes.select("rid", "sig").mapInArrow(lean(_branch(threshold, _roots(threshold))), "path long, rid long")
    for depth in range(DEPTH):
        rows = stage(rows, "branches")
        counts = stage(rows.groupBy("path").agg(F.count("*").alias("members")).filter("members > 1"), "counts")
        met = stage(join_groups(rows, counts, "path", "members", rows.count()), "nodes")
        leaves.append(met.filter(F.col("members") <= NODE_ROWS).select("path", "rid"))
        n_large = counts.filter(F.col("members") > NODE_ROWS).agg(F.sum("members")).first()[0]
        unstage(rows, counts)
        if not n_large:
            break
        links, again = _large_nodes(met.filter(F.col("members") > NODE_ROWS), n_large, signed, share, depth == DEPTH - 1)
        found.append(links)
        if depth == DEPTH - 1 or again.isEmpty():
            break
        rows = again.join(classes.select("rid", "sig"), "rid").select("path", "rid", "sig").mapInArrow(lean(_branch(threshold, None)), "path long, rid long")
    nodes = reduce(DataFrame.union, leaves).join(signed, "rid")
    nodes = nodes.repartition("path").sortWithinPartitions("path").mapInArrow(lean(_compare_nodes(share)), "a long, b long")
    similar = reduce(DataFrame.union, [nodes, *found])
    clusters = components(similar).select(F.col("node").alias("rid"), F.col("root").alias("grp"))
    clusters = stage(clusters.join(classes.select("rid", "cid", "rep", "n"), "rid"), "clusters")
    n_clustered = clusters.count()
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_CLASSES), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks")
    sizes = stage(together(clusters, n_clustered).groupBy("grp").agg(blocks, F.count("*").alias("members")), "sizes")
    wanted = stage(join_groups(clusters, sizes, "grp", "members", n_clustered).select("grp", "rid", "blocks", "cid", "rep"), "wanted")

    sets = stage(_full_sets(docs, wanted, n_clustered), "sets")
    linked = components(linked_in_blocks(sets, _by_sets, share, ["hashes"])).withColumnRenamed("node", "rid")

    named = classes.select("rid", "cid", "rep", "copies").join(linked, "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    named = stage(named, "named")
    least = stage(together(named, n_classes).groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("members")), "least")
    alone = F.col("copies") == 1
    name_of = join_groups(named, least, "root", "members", n_classes).filter(~(alone & F.col("rep").eqNullSafe(F.col("component_id"))))
    return name_of.select("cid", "component_id", "copies", F.lit(True).alias("_met"))
