"""Token ids in files of fixed-width fields, and a data source that reads them.

An id takes the fewest bits that the vocabulary needs. A file has its ids in blocks of BLOCK ids, each
beginning at a byte, then the documents it holds as an Arrow table, the blocks' offsets, and a fixed tail that says where
these are. Blocks unpack by themselves with a few numpy operations, so any range of ids costs the blocks that hold
it. A folder's manifest names its files in the order of their ids. Writing has two phases: tasks write files
under names of their own, and only the driver's commit, which gets a line a file, makes the manifest; a
file that isn't in it, of a lost or repeated task, is never read.
"""

from __future__ import annotations

import json
import struct
import sys
import uuid
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import lean, ship
from .tokens import encoder, ids_of

MAGIC = b"JSBITS01"
#: Ids of a block; a multiple of eight, so that a full block fills its last byte.
BLOCK = 4096
#: Ids of a file, about.
FILE_IDS = 1 << 26
#: Ids that a reading or writing task holds at once, beside one document.
HELD_IDS, HELD_BYTES = 1 << 20, 4 << 20
MANIFEST = "_manifest.json"
#: The end of a file: ids, bits an id, ids a block, where documents and offsets begin, and MAGIC.
_TAIL = "<QIIQQ8s"
_TAIL_SIZE = struct.calcsize(_TAIL)


def bits_for(vocabulary: int) -> int:
    """The fewest bits that tell so many ids apart."""
    return max(1, (vocabulary - 1).bit_length())


def narrow(bits: int) -> str:
    """The type that ids of so many bits travel in."""
    return "<u2" if bits <= 16 else "<u4"


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids in so many bits each, the first in the lowest bits. Eight ids fill exactly bits bytes, so the ids of one
    place among eight all lie alike."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"id {int(ids.max())} needs more than {bits} bits")
    rows = -(-len(ids) // 8)
    lanes = np.zeros((rows, 8), np.uint64)
    lanes.ravel()[: len(ids)] = ids
    out = np.zeros((rows, bits), np.uint8)
    for lane in range(8):
        first, shift = divmod(lane * bits, 8)
        value = lanes[:, lane] << np.uint64(shift)
        for k in range((shift + bits + 7) // 8):
            out[:, first + k] |= ((value >> np.uint64(8 * k)) & np.uint64(0xFF)).astype(np.uint8)
    return out.tobytes()[: -(-len(ids) * bits // 8)]


def unpack_bits(data: bytes, bits: int, n: int) -> np.ndarray:
    """The first n ids of packed bytes."""
    rows = -(-n // 8)
    packed = np.zeros(rows * bits, np.uint8)
    given = np.frombuffer(data, np.uint8, -(-n * bits // 8))
    packed[: len(given)] = given
    packed = packed.reshape(rows, bits).astype(np.uint64)
    out = np.empty((rows, 8), np.uint32)
    for lane in range(8):
        first, shift = divmod(lane * bits, 8)
        value = np.zeros(rows, np.uint64)
        for k in range((shift + bits + 7) // 8):
            value |= packed[:, first + k] << np.uint64(8 * k)
        out[:, lane] = (value >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
    return out.ravel()[:n]


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """A path's file system, for which Arrow must have a client, and its name there."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    return pafs.LocalFileSystem(), path


class FileWriter:
    """One file, in a stream: blocks go out as they fill, documents are kept for the end."""

    def __init__(self, out: pa.NativeFile, bits: int, key: pa.DataType) -> None:
        self.out, self.bits, self.key = out, bits, key
        self.ids, self.at = 0, len(MAGIC)
        self.waiting: list[np.ndarray] = []
        self.n_waiting = 0
        self.offsets: list[int] = []
        self.documents: list[pa.RecordBatch] = []
        out.write(MAGIC)

    def add(self, keys: pa.Array, bodies: Sequence[bytes], kind: str = "<u4") -> None:
        """Documents, given as the bytes of little-endian unsigned ids."""
        size = np.dtype(kind).itemsize
        lengths = np.array([len(b) // size for b in bodies], np.int64)
        starts = self.ids + np.cumsum(lengths) - lengths
        self.documents.append(pa.RecordBatch.from_arrays([keys.cast(self.key), pa.array(starts), pa.array(lengths)], names=["key", "start", "n"]))
        self.ids += int(lengths.sum())
        for b in bodies:
            self.waiting.append(np.frombuffer(b, kind))
            self.n_waiting += len(b) // size
            if self.n_waiting >= HELD_IDS:
                self._blocks(self.n_waiting - self.n_waiting % BLOCK)

    def _blocks(self, n: int) -> None:
        whole = np.concatenate([np.zeros(0, np.uint32), *self.waiting])
        for at in range(0, n, BLOCK):
            data = pack_bits(whole[at : min(n, at + BLOCK)], self.bits)
            self.offsets.append(self.at)
            self.out.write(data)
            self.at += len(data)
        self.waiting, self.n_waiting = [whole[n:].copy()], len(whole) - n

    def close(self) -> None:
        self._blocks(self.n_waiting)
        sink = pa.BufferOutputStream()
        schema = pa.schema([("key", self.key), ("start", pa.int64()), ("n", pa.int64())])
        with pa.ipc.new_stream(sink, schema) as w:
            for batch in self.documents:
                w.write_batch(batch)
        body = sink.getvalue()
        self.out.write(body)
        self.out.write(np.array(self.offsets, "<u8").tobytes())
        self.out.write(struct.pack(_TAIL, self.ids, self.bits, BLOCK, self.at, self.at + body.size, MAGIC))


class FileReader:
    """One file: its documents, and any range of its ids."""

    def __init__(self, f: pa.NativeFile) -> None:
        self.f = f
        size = f.size()
        f.seek(size - _TAIL_SIZE)
        self.ids, self.bits, self.block, documents, offsets, magic = struct.unpack(_TAIL, f.read(_TAIL_SIZE))
        if magic != MAGIC:
            raise ValueError("not a file of packed ids")
        f.seek(documents)
        self.documents = pa.ipc.open_stream(f.read(offsets - documents)).read_all()
        self.offsets = np.frombuffer(f.read(size - _TAIL_SIZE - offsets), "<u8")
        self.end = documents

    def range(self, start: int, n: int) -> np.ndarray:
        """n ids from start on; reads and unpacks only the blocks that hold them."""
        if not n:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (start + n - 1) // self.block
        begin = int(self.offsets[first])
        self.f.seek(begin)
        data = self.f.read((int(self.offsets[last + 1]) if last + 1 < len(self.offsets) else self.end) - begin)
        held = min(self.ids, (last + 1) * self.block) - first * self.block  # full blocks fill their last byte
        ids = unpack_bits(data, self.bits, held)
        return ids[start - first * self.block :][:n]


@dataclass
class _Written(WriterCommitMessage):
    name: str
    part: int
    ids: int
    documents: int


class TokenWriter(DataSourceArrowWriter):
    """Writes rows (key, ids), sorted as they come: a file for each task that has rows. Ids come in two bytes each if
    bits are no more than 16, else in four."""

    def __init__(self, path: str, bits: int) -> None:
        self.path, self.bits = path, bits

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        fs, root = filesystem(self.path)
        part = TaskContext.get().partitionId()
        name, writer, out = f"ids-{part:06d}-{uuid.uuid4().hex[:12]}.bits", None, None
        n = 0
        for whole in iterator:
            rows = max(1, HELD_BYTES * whole.num_rows // max(1, whole.nbytes))
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                if writer is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/{name}")
                    writer = FileWriter(out, self.bits, batch.column(0).type)
                n += batch.num_rows
                writer.add(batch.column(0), batch.column(1).to_pylist(), narrow(self.bits))
        if writer is None:
            return _Written("", part, 0, 0)
        writer.close()
        out.close()
        return _Written(name, part, writer.ids, n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        files, start = [], 0
        for m in sorted((m for m in messages if m is not None and m.name), key=lambda m: m.part):
            files.append({"name": m.name, "start": start, "ids": m.ids, "documents": m.documents})
            start += m.ids
        with fs.open_output_stream(f"{root}/{MANIFEST}") as out:
            out.write(json.dumps({"bits": self.bits, "ids": start, "files": files}).encode())
        self._delete({f["name"] for f in files})

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._delete(set())

    def _delete(self, kept: set[str]) -> None:
        fs, root = filesystem(self.path)
        for x in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
            if x.base_name.endswith(".bits") and x.base_name not in kept:
                fs.delete_file(x.path)


@dataclass
class _File(InputPartition):
    name: str
    start: int


class TokenReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType) -> None:
        self.path, self.schema = path, schema

    def partitions(self) -> list[InputPartition]:
        return [_File(f["name"], f["start"]) for f in manifest(self.path)["files"]] or [_File("", 0)]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        if not partition.name:
            return
        fs, root = filesystem(self.path)
        kinds = to_arrow_schema(self.schema)
        with fs.open_input_file(f"{root}/{partition.name}") as f:
            file = FileReader(f)
            n = file.documents.column("n").to_numpy()
            ends = np.cumsum(n)
            at = 0
            while at < len(n):  # as many documents as make HELD_IDS ids, and one at least
                first = int(ends[at] - n[at])
                to = max(at + 1, int(np.searchsorted(ends, first + HELD_IDS, side="right")))
                ids = file.range(first, int(ends[to - 1]) - first).astype("<u4", copy=False) if "ids" in kinds.names else None
                rows = file.documents.slice(at, to - at)
                own = {"n_tokens": rows.column("n").combine_chunks(), "start": pa.array(rows.column("start").to_numpy() + partition.start)}
                if ids is not None:
                    own["ids"] = pa.array([ids[e - k - first : e - first].tobytes() for e, k in zip(ends[at:to], n[at:to], strict=True)], pa.binary())
                columns = [own.get(name, rows.column("key").combine_chunks()) for name in kinds.names]
                yield pa.RecordBatch.from_arrays([c.cast(k.type) for c, k in zip(columns, kinds, strict=True)], schema=kinds)
                at = to


class TokenDataSource(DataSource):
    """df.write.format("token_bits").option("bits", 16).save(path) of (key, ids), and spark.read.format("token_bits")."""

    @classmethod
    def name(cls) -> str:
        return "token_bits"

    def schema(self) -> str:
        return "doc_id long, start long, n_tokens long, ids binary"

    def reader(self, schema: T.StructType) -> TokenReader:
        return TokenReader(self.options["path"], schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> TokenWriter:
        return TokenWriter(self.options["path"], int(self.options["bits"]))


def _register(spark: SparkSession) -> None:
    ship(spark)
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the workers that plan and commit can't import this package
    spark.dataSource.register(TokenDataSource)


def manifest(path: str) -> dict:
    """What a written folder holds: bits, ids, and its files in order with the ids before each."""
    fs, root = filesystem(path)
    with fs.open_input_stream(f"{root}/{MANIFEST}") as f:
        return json.loads(f.read())


def _place(key: object, row: int) -> tuple[bool, object, int]:
    """A row's place in the order: null keys first, rows that repeat a key by their row numbers."""
    return key is not None, key, row


def _splitters(docs: DataFrame, key: str, files: int) -> list[tuple[bool, object, int]]:
    """The first place of each file but the first. Only keys and row numbers move; a row for each file reaches the driver."""
    if files < 2:
        return []
    placed = docs.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("row")).repartitionByRange(files, "key", "row")
    first = placed.groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct("key", "row")).alias("at"))
    return [_place(r["at"].key, r["at"].row) for r in sorted(first.collect(), key=lambda r: r.part)][1:]


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, text: str = "text", key: str = "doc_id", file_ids: int = FILE_IDS) -> None:
    """Write the ids of each whole text, and the END after them, in ascending order of the key, a whole number or a string.

    A null text is empty and has just the END. Null keys come first; rows that repeat a key are documents of their
    own, in no particular order among themselves. Very long texts are one document in one file, whatever
    file_ids says; files are counted by three bytes of text an id. An empty table makes a folder without files. Other
    columns are ignored. Texts don't move: keys are sampled first for where files begin, so that a repeated key may
    fill several, and then ids go to their file's task, two bytes or four each, and are sorted there."""
    spark = docs.sparkSession
    _register(spark)
    bits = bits_for(encoder(tokenizer_path).vocabulary)
    dtype = narrow(bits)
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text).cast("long")), F.lit(0))).first()[0]
    files = max(spark.sparkContext.defaultParallelism if size > BLOCK else 1, -(-size // (3 * file_ids)))
    shared = spark.sparkContext.broadcast(_splitters(docs, key, files))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [ids_of(t, tokenizer_path).astype(dtype).tobytes() for t in batch.column(1).to_pylist()]
            keys, rows = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            part = [bisect_right(shared.value, _place(k, r)) for k, r in zip(keys, rows, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(part, pa.int32()), pa.array(ids, pa.binary())], names=["key", "row", "part", "ids"])

    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), *T.StructType.fromDDL("row long, part int, ids binary").fields])
    made = docs.select(F.col(key).alias("key"), text, F.monotonically_increasing_id().alias("row")).mapInArrow(lean(encode), schema)
    ordered = made.repartitionById(len(shared.value) + 1, "part").sortWithinPartitions("key", "row").select("key", "ids")
    ordered.write.format("token_bits").option("bits", bits).mode("append").save(path)


def read_tokens(spark: SparkSession, path: str, columns: Sequence[str] = ("doc_id", "start", "n_tokens", "ids"), key: T.DataType | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of a written folder: how many ids are before a document, how many it has with
    its END, and the ids as little-endian unsigned 32-bit numbers. Without ids among the columns no
    block is read. key: the key's type, if it isn't a long."""
    _register(spark)
    kinds = {"doc_id": key or T.LongType(), "start": T.LongType(), "n_tokens": T.LongType(), "ids": T.BinaryType()}
    return spark.read.format("token_bits").schema(T.StructType([T.StructField(c, kinds[c]) for c in columns])).load(path)


def token_range(path: str, start: int, n: int) -> np.ndarray:
    """n ids of a written folder from start on, as if it were one long array; reads the blocks that hold them."""
    fs, root = filesystem(path)
    out = [np.zeros(0, np.uint32)]
    for f in manifest(path)["files"]:
        first, last = max(start, f["start"]), min(start + n, f["start"] + f["ids"])
        if first < last:
            with fs.open_input_file(f"{root}/{f['name']}") as raw:
                out.append(FileReader(raw).range(first - f["start"], last - first))
    return np.concatenate(out)
