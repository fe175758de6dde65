"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors with cosine c or more are within a squared distance of 2 (1 - c). A random rotation spreads
that distance evenly, so of any pair within it at least one block of dimensions is within the block's
proportional share. Every block is range-joined under its share, and the union of what the blocks find is
verified exactly. Vectors lie in cells around pivots; a pair of cells is only joined if some block's balls
come close enough, and a large cell is dealt out in chunks. In a pair of chunks each block sorts its rows by
one coordinate and compares only rows within reach there. Equal vectors are one class, and a task reports
counts of links and a spanning forest, never all pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_groups, lean, ship, stage, unstage
from .components import components

BLOCK_DIMS = 16
#: Pivots are a sample of the vectors, one for each chunk of them and at most MAX_CELLS.
MAX_CELLS = 512
#: Least and most rows of a chunk. Between them chunks are as large as keeps all cores busy, TASKS_A_CORE pairs of
#: chunks for each, so that a vector travels no more often than that takes, whatever the number of vectors.
CHUNKS, TASKS_A_CORE = (2048, 65536), 4
#: Pairs of chunks are dealt out to so many partitions at most.
MAX_PARTITIONS = 20_000
#: Rows that are compared at once; a tile of distances stays in a core's own cache.
STRIPE, TILE = 128, 1024
#: Block distances are found in single precision; this covers its error.
SLACK = 2e-5


def _rotation(dims: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(11).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def _blocks(dims: int) -> list[slice]:
    return [slice(a, min(a + BLOCK_DIMS, dims)) for a in range(0, dims, BLOCK_DIMS)]


def _named(dims: int, kind: str):
    """(id, cid, vec): the vector in its own precision, and a name for it; null for those that can't link.
    Shorter vectors are filled up with zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column(1)
            n = pc.fill_null(pc.list_value_length(given), 0).to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(n)), n)
            x = np.zeros((len(n), dims), kind)
            x[row, np.arange(len(row)) - (np.cumsum(n) - n)[row]] = given.flatten().to_numpy(zero_copy_only=False)  # nulls become NaN
            x += 0  # no negative zeros
            own = np.isfinite(x).all(axis=1) & x.any(axis=1)
            vecs = [v.tobytes() if ok else None for v, ok in zip(x, own, strict=True)]
            cids = [None if v is None else hashlib.blake2b(v, digest_size=16).digest() for v in vecs]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cids, pa.binary()), pa.array(vecs, pa.binary())], names=["id", "cid", "vec"])

    return run


def _units(data: bytes, dims: int, kind: str) -> np.ndarray:
    """Unit vectors in doubles, scaled first so that no square overflows."""
    x = np.frombuffer(data, kind).reshape(-1, dims).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _assign(pivots: np.ndarray, dims: int, kind: str):
    """The nearest pivot of each vector, and its distance from it in each block."""
    blocks, turn = _blocks(dims), _rotation(dims)
    centres = pivots @ turn

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _units(b"".join(batch.column("vec").to_pylist()), dims, kind)
                cell = (x @ pivots.T).argmax(axis=1)
                off = x @ turn - centres[cell]
                far = [np.sqrt((off[:, b] ** 2).sum(axis=1)) for b in blocks]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("rid"), batch.column("copies"), pa.array(cell, pa.int64()), batch.column("vec"), *map(pa.array, far)],
                    names=["rid", "copies", "cell", "vec", *(f"far{i}" for i in range(len(blocks)))],
                )

    return run


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each chunk from rows sorted by cell and chunk."""
    key, held = None, ([], [], [])

    def out() -> pa.RecordBatch:
        rid, copies, vec = held
        blobs = [np.array(rid, np.int64).tobytes(), np.array(copies, np.int64).tobytes(), b"".join(vec)]
        return pa.RecordBatch.from_arrays(
            [pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), *(pa.array([b], pa.binary()) for b in blobs)],
            names=["cell", "chunk", "rids", "copies", "vecs"],
        )

    for batch in batches:
        for cell, chunk, *row in zip(*(batch.column(c).to_pylist() for c in ("cell", "chunk", "rid", "copies", "vec")), strict=True):
            if (cell, chunk) != key:
                if key is not None:
                    yield out()
                key, held = (cell, chunk), ([], [], [])
            for column, v in zip(held, row, strict=True):
                column.append(v)
    if key is not None:
        yield out()


def range_join(x: np.ndarray, y: np.ndarray, share: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows of one block within a squared distance of share, and perhaps a few just over it.

    Rows are sorted by the coordinate that spreads most, and a stripe of x only meets the rows of y that lie
    within reach of it there. Memory holds STRIPE x TILE distances at a time. If y is x itself, each pair of
    different rows comes once, in either order."""
    if not len(x) or not len(y):
        return
    same = y is x
    along = int(np.ptp(x if same else np.concatenate((x, y)), axis=0).argmax())
    own, other = np.argsort(x[:, along], kind="stable"), np.argsort(y[:, along], kind="stable")
    at, reach = y[other, along], np.sqrt(share + 2 * SLACK) + SLACK
    # p.q - |p|^2 / 2 - |q|^2 / 2 as one product
    p = np.column_stack((x, (x * x).sum(axis=1) / -2, np.ones(len(x)))).astype(np.float32)[own]
    q = np.column_stack((y, np.ones(len(y)), (y * y).sum(axis=1) / -2)).astype(np.float32)[other]
    for a in range(0, len(p), STRIPE):
        part = p[a : a + STRIPE]
        lo = a if same else int(np.searchsorted(at, x[own[a], along] - reach))
        hi = int(np.searchsorted(at, x[own[a + len(part) - 1], along] + reach, side="right"))
        for b in range(lo, hi, TILE):
            near = part @ q[b : min(b + TILE, hi)].T >= np.float32(-(share + 2 * SLACK) / 2)
            if near.any():
                i, j = np.nonzero(near)
                if same:
                    i, j = i[i + a < j + b], j[i + a < j + b]
                yield own[i + a], other[j + b]


def _first_block(x: np.ndarray, y: np.ndarray, blocks: list[slice], budget: float) -> np.ndarray:
    """The first block in which each pair of rows is within its share."""
    square = (x - y) ** 2
    within = [square[:, s].sum(axis=1) <= budget * (s.stop - s.start) / x.shape[1] + SLACK for s in blocks]
    return np.argmax(np.column_stack(within), axis=1)


def links_of(a: np.ndarray, b: np.ndarray, turn: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of unit vectors with at least this cosine, each once: every block is joined by range, what it
    finds is verified exactly, and a pair counts in the first block that finds it. If b is a itself, no vector
    meets itself, and a pair comes in either order."""
    budget, blocks = 2 * (1 - cosine), _blocks(a.shape[1])
    x = a @ turn
    y = x if b is a else b @ turn
    for k, s in enumerate(blocks):
        own = x[:, s]
        for i, j in range_join(own, own if b is a else y[:, s], budget * (s.stop - s.start) / a.shape[1]):
            for at in range(0, len(i), 1 << 16):
                p, q = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                true = np.einsum("ij,ij->i", a[p], b[q]) >= cosine
                p, q = p[true], q[true]
                new = _first_block(x[p], y[q], blocks, budget) == k
                yield p[new], q[new]


def _join(root: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
    """Union of members by links, root[x] being the smallest member known to be joined with x."""
    while True:
        u, v = root[p], root[q]
        apart = u != v
        if not apart.any():
            return
        p, q, u, v = p[apart], q[apart], u[apart], v[apart]
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while (root[root] != root).any():
            root[:] = root[root]


def _compare(dims: int, kind: str, cosine: float):
    """Counts of links (rid, links) and a spanning forest (a, b) of each pair of chunks, from rows sorted by task
    and side. A chunk that meets itself is there once."""
    turn = _rotation(dims)

    def pair(sides: list[dict]) -> Iterator[pa.RecordBatch]:
        same = len(sides) == 1
        rid = [np.frombuffer(s["rids"], np.int64) for s in sides]
        copies = [np.frombuffer(s["copies"], np.int64) for s in sides]
        unit = [_units(s["vecs"], dims, kind) for s in sides]
        every = np.concatenate(rid)
        links, root, shift = np.zeros(len(every), np.int64), np.arange(len(every)), 0 if same else len(rid[0])
        for p, q in links_of(unit[0], unit[-1], turn, cosine):
            np.add.at(links, p, copies[-1][q])
            np.add.at(links, q + shift, copies[0][p])
            _join(root, p, q + shift)
        some = np.flatnonzero(links)
        yield _found(rid=every[some], links=links[some])
        joined = np.flatnonzero(root != np.arange(len(root)))
        yield _found(a=every[joined], b=every[root[joined]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                held.append(row)
                if len(held) == row["sides"]:
                    yield from pair(held)
                    held = []

    return run


def _found(**columns: np.ndarray) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[c], pa.int64()) if c in columns else pa.nulls(n, pa.int64()) for c in ("rid", "links", "a", "b")], names=["rid", "links", "a", "b"]
    )


def _chunk_rows(n: int, cores: int) -> int:
    """A number c of chunks makes c * (c + 1) / 2 pairs."""
    return min(CHUNKS[1], max(CHUNKS[0], -(-n // math.ceil(math.sqrt(2 * TASKS_A_CORE * cores)))))


def _dealt(rows: int, chunk: int) -> int:
    """Chunks of a cell: the number that brings them nearest to the wanted size, so they may be half as large again."""
    return max(1, (rows + chunk // 2) // chunk)


def near_vectors(vectors: DataFrame, cosine: float = 0.95, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, n_links, component_id, kept) for every row.

    Vectors with a cosine of at least the given one are linked. n_links counts the other rows linked
    directly, component_id is the smallest key reachable by links, the row's own included, and kept is key
    = component_id. Null and zero vectors and those with null or non-finite components link with nothing;
    a shorter vector counts as filled up with zeros. Null keys are allowed and name a component only if all
    its keys are null. Rows that repeat a vector are linked with each other, whatever their keys. Pairs just at
    the cosine count as their product in doubles says. An empty table gives no rows; other columns are ignored,
    whatever their names."""
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).alias("v"))
    id_type = rows.schema["id"].dataType.simpleString()
    kind = "<f4" if rows.schema["v"].dataType.elementType.simpleString() == "float" else "<f8"
    dims = int(rows.agg(F.max(F.size("v"))).first()[0] or 0)
    dims = max(dims, 1)
    named_rows = stage(rows.mapInArrow(lean(_named(dims, kind)), f"id {id_type}, cid binary, vec binary"), "vectors")
    classes = named_rows.filter("cid is not null").groupBy("cid").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.max("vec").alias("vec"))
    classes = stage(classes.withColumn("rid", F.monotonically_increasing_id()), "classes")
    n_rows, n = named_rows.count(), classes.count()

    chunk = _chunk_rows(n, spark.sparkContext.defaultParallelism)
    cells = min(MAX_CELLS, -(-n // chunk))
    pivots = classes.orderBy(F.xxhash64(F.lit(5), "rid"), "rid").limit(cells).select("vec").toArrow().column(0)
    pivots = _units(b"".join(pivots.to_pylist()), dims, kind)
    blocks = _blocks(dims)
    far = [f"far{i}" for i in range(len(blocks))]
    placed = classes.select("rid", "copies", "vec").mapInArrow(
        lean(_assign(pivots, dims, kind)), "rid long, copies long, cell long, vec binary, " + ", ".join(f"{c} double" for c in far)
    )
    placed = stage(placed, "placed")
    found = placed.groupBy("cell").agg(F.count("*").alias("rows"), *[F.max(c).alias(c) for c in far]).collect()  # MAX_CELLS rows at most
    pairs = _close_cells(found, pivots @ _rotation(dims), blocks, 2 * (1 - cosine), dims, chunk)
    numbered, n_tasks = [], 0
    for c1, n1, c2, n2 in pairs:
        numbered.append((c1, n1, c2, n2, n_tasks))
        n_tasks += n1 * n2 if c1 != c2 else n1 * (n1 + 1) // 2
    pair_of = spark.createDataFrame(numbered or [(0, 0, 0, 0, 0)], "c1 long, n1 long, c2 long, n2 long, base long").filter("n1 > 0")

    size_of = F.broadcast(spark.createDataFrame([(r.cell, _dealt(r.rows, chunk)) for r in found] or [(-1, 1)], "cell long, n long"))
    dealt = placed.drop(*far).join(size_of, "cell").withColumn("chunk", F.pmod(F.xxhash64(F.lit(6), "rid"), F.col("n")))
    chunks = dealt.repartition("cell", "chunk").sortWithinPartitions("cell", "chunk").mapInArrow(lean(_chunks), "cell long, chunk long, rids binary, copies binary, vecs binary")
    chunks = stage(chunks, "chunks")
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    tasks = pair_of.withColumn("k1", upto("n1")).withColumn("k2", upto("n2")).filter("c1 <> c2 or k1 <= k2")
    tasks = tasks.withColumn("task", F.expr("base + if(c1 <> c2, k1 * n2 + k2, k2 * (k2 + 1) div 2 + k1)"))
    # every chunk goes once to each task that needs it, and tasks are dealt out by their number
    alone = F.expr("c1 = c2 and k1 = k2")
    first = F.struct(F.lit(0).alias("side"), F.col("c1").alias("cell"), F.col("k1").alias("chunk"))
    second = F.struct(F.lit(1).alias("side"), F.col("c2").alias("cell"), F.col("k2").alias("chunk"))
    needs = tasks.select("task", F.when(alone, 1).otherwise(2).alias("sides"), F.explode(F.when(alone, F.array(first)).otherwise(F.array(first, second))).alias("at"))
    met = needs.select("task", "sides", "at.*").join(chunks, ["cell", "chunk"]).select("task", "side", "sides", "rids", "copies", "vecs")
    met = met.repartitionById(max(1, min(n_tasks, MAX_PARTITIONS)), F.pmod("task", F.lit(MAX_PARTITIONS)).cast("int")).sortWithinPartitions("task", "side")
    said = stage(met.mapInArrow(lean(_compare(dims, kind, cosine)), "rid long, links long, a long, b long"), "links")

    links = said.filter("rid is not null").groupBy("rid").agg(F.sum("links").alias("links"))
    roots = components(said.filter("a is not null").select("a", "b")).withColumnRenamed("node", "rid")
    named = classes.select("rid", "cid", "rep", "copies").join(links, "rid", "left").join(roots, "rid", "left")
    named = stage(named.filter("copies > 1 or links is not null").withColumn("root", F.coalesce("root", "rid")), "named")
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    names = named.join(least, "root").select("cid", "component_id", "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = join_groups(named_rows.select("id", "cid"), stage(names, "names"), "cid", "copies", n_rows, "left")
    component = F.when(F.col("n_links").isNotNull(), F.col("component_id")).otherwise(F.col("id"))
    out = out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"))
    unstage(classes, placed, chunks, said, named)
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


def _close_cells(found: list, centres: np.ndarray, blocks: list[slice], budget: float, dims: int, chunk: int) -> list[tuple[int, int, int, int]]:
    """Pairs of cells, with their numbers of chunks, that some block can't tell apart."""
    out = []
    for x in range(len(found)):
        rest = found[x:]
        near = np.zeros(len(rest), bool)
        for k, s in enumerate(blocks):
            gap = np.sqrt(((centres[[r.cell for r in rest], s] - centres[found[x].cell, s]) ** 2).sum(axis=1))
            reach = np.sqrt(budget * (s.stop - s.start) / dims) + found[x][f"far{k}"] + np.array([r[f"far{k}"] for r in rest])
            near |= gap <= reach + 1e-9
        out += [(found[x].cell, _dealt(found[x].rows, chunk), r.cell, _dealt(r.rows, chunk)) for r, ok in zip(rest, near, strict=True) if ok]
    return out
