"""Hierarchical multi-length packing of token sequences.

Documents become token ids. Whole 1024-token windows are cut off first; what remains is routed to a tier
by its length (over 512, over 256, the rest). Each tier is packed into windows of its own size, best fit
first; gaps of longer windows are filled from shorter tiers, the last bit of a gap with a cut piece. Only
what is left at the end of a partition makes windows of smaller powers of two. Each partition packs its own
documents in a stream, holding no more than one pool of remainders, so nothing is shuffled.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import lean, ship
from .tokens import ids_of

WINDOW = 1024
TIERS = (1024, 512, 256)
#: Remainders that are packed together.
POOL = 2048
#: Tokens that a step takes; groups of sequences are dealt out to be near this.
STEP_TOKENS = 16 * 1024

_SCHEMA = "doc_id {id}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


class _Piece:
    """Ids of a document from start on, not yet placed."""

    __slots__ = ("doc", "ids", "start", "total")

    def __init__(self, doc: int, start: int, ids: np.ndarray, total: int) -> None:
        self.doc, self.start, self.ids, self.total = doc, start, ids, total

    def split(self, n: int) -> tuple[_Piece, _Piece]:
        return _Piece(self.doc, self.start, self.ids[:n], self.total), _Piece(self.doc, self.start + n, self.ids[n:], self.total)


class _Shelf:
    """Pieces in order of length."""

    def __init__(self, pieces: list[_Piece]) -> None:
        self.pieces = sorted(pieces, key=lambda p: (len(p.ids), p.doc is None, p.start))
        self.lengths = [len(p.ids) for p in self.pieces]

    def __len__(self) -> int:
        return len(self.pieces)

    def best(self, room: int) -> _Piece | None:
        """Take the longest piece that fits."""
        i = bisect_right(self.lengths, room) - 1
        return self.take(i) if i >= 0 else None

    def take(self, i: int) -> _Piece:
        del self.lengths[i]
        return self.pieces.pop(i)

    def put(self, p: _Piece) -> None:
        i = bisect_right(self.lengths, len(p.ids))
        self.lengths.insert(i, len(p.ids))
        self.pieces.insert(i, p)


def pack_pool(pieces: list[_Piece]) -> tuple[list[tuple[int, list[_Piece]]], list[_Piece]]:
    """Full windows (tier, pieces) of the pool, and the pieces of fewer than a window's ids that are left."""
    windows: list[tuple[int, list[_Piece]]] = []
    below = [*TIERS[1:], 0]
    shelves = [_Shelf([p for p in pieces if low < len(p.ids) <= tier]) for tier, low in zip(TIERS, below, strict=True)]
    for k, tier in enumerate(TIERS):
        own = shelves[k]
        while len(own):
            window = [own.take(len(own) - 1)]
            room = tier - len(window[0].ids)
            while room:
                for shelf in shelves[k:]:
                    if (p := shelf.best(room)) is not None:
                        break
                else:  # nothing fits whole: cut a piece of the shortest tier that has one
                    source = next((s for s in reversed(shelves[k:]) if len(s)), None)
                    if source is None:
                        break
                    p, rest = source.take(len(source) - 1).split(room)
                    shelves[next(j for j in reversed(range(len(TIERS))) if len(rest.ids) <= TIERS[j])].put(rest)
                window.append(p)
                room -= len(p.ids)
            if room:
                return windows, window
            windows.append((tier, window))
    return windows, []


def _last(pieces: list[_Piece]) -> list[tuple[int, list[_Piece]]]:
    """What is left, in windows of falling powers of two without padding."""
    windows = []
    left = sum(len(p.ids) for p in pieces)
    pieces = list(reversed(pieces))
    while left:
        size = min(WINDOW, 1 << (left.bit_length() - 1))
        window, room = [], size
        while room:
            p = pieces.pop()
            if len(p.ids) > room:
                p, rest = p.split(room)
                pieces.append(rest)
            window.append(p)
            room -= len(p.ids)
        windows.append((size, window))
        left -= size
    return windows


class _Steps:
    """Deal windows to step groups of about STEP_TOKENS, longest first to the lightest open group."""

    def __init__(self, first: int) -> None:
        self.next = first

    def deal(self, windows: list[tuple[int, list[_Piece]]]) -> list[int]:
        n = max(1, round(sum(w[0] for w in windows) / STEP_TOKENS))
        loads = [(0, g) for g in range(n)]
        groups = [0] * len(windows)
        for i in sorted(range(len(windows)), key=lambda i: -windows[i][0]):
            load, g = loads.pop(0)
            groups[i] = self.next + g
            insort(loads, (load + windows[i][0], g))
        self.next += n
        return groups


def pack(docs: DataFrame, tokenizer_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens,
    sequence_id, offset, tier (the window's tokens), step_group.

    A document's ids are those of its whole text, then 0; a null text is empty and so just that 0. Each id
    lies in one piece, windows have no gaps, and all are full: 1024, 512 or 256 tokens, or at the end of a
    partition a smaller power of two. Rows that repeat a key are separate documents, and null keys stay
    null. Other columns are ignored. An empty table gives no rows. Tokens that the tokenizer file adds count
    where a text holds them. A very long text, also one of white space only, is cut into full windows as it comes, so it never waits
    in a pool; remainders of equal length are taken in the order of their start, then as they come."""
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 36
        steps, sequence = _Steps(first), first
        pool: list[_Piece] = []
        full: list[tuple[int, list[_Piece]]] = []

        def out(windows: list[tuple[int, list[_Piece]]]) -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            if not windows:
                return
            rows: list[list] = [[] for _ in range(9)]
            for (tier, pieces), step in zip(windows, steps.deal(windows), strict=True):
                offset = 0
                for p in pieces:
                    for c, v in zip(rows, (p.doc, p.start, len(p.ids), p.ids.tobytes(), p.total, sequence, offset, tier, step), strict=True):
                        c.append(v)
                    offset += len(p.ids)
                sequence += 1
            kinds = [id_type, *[pa.int64()] * 2, pa.binary(), *[pa.int64()] * 3, pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=names)

        for batch in batches:
            id_type = batch.schema.field(0).type
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = ids_of(body, tokenizer_path)
                whole = len(ids) - len(ids) % WINDOW
                full += [(WINDOW, [_Piece(doc, at, ids[at : at + WINDOW], len(ids))]) for at in range(0, whole, WINDOW)]
                if whole < len(ids):
                    pool.append(_Piece(doc, whole, ids[whole:], len(ids)))
                if len(pool) >= POOL or len(full) >= POOL:
                    windows, pool = pack_pool(pool)
                    yield from out(full + windows)
                    full = []
        windows, pool = pack_pool(pool)
        yield from out(full + windows + _last(pool))

    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]
    schema = T.StructType([T.StructField("doc_id", kind), *T.StructType.fromDDL(_SCHEMA.format(id="long")).fields[1:]])
    return docs.select(key, text).mapInArrow(lean(run), schema)
