"""Models on shared storage: a table of blocks of named arrays for each epoch.

An epoch counts once Spark has committed its table, so a driver that is lost comes back to the last whole one.
Executors read the blocks they need straight from storage; nothing of a model has to pass through the driver.
"""

from __future__ import annotations

import re
import sys

import numpy as np
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have this package
SCHEMA = "name string, kind string, shape array<long>, block int, data binary"
#: Numbers of a block.
BLOCK = 1 << 16
Arrays = dict[str, np.ndarray]


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    return pafs.LocalFileSystem(), path


def epoch_path(path: str, epoch: int) -> str:
    return f"{path.rstrip('/')}/epoch-{epoch:06d}"


def epochs(path: str) -> list[int]:
    """The committed epochs of a store, in order."""
    fs, root = filesystem(path)
    found = []
    for x in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
        m = re.fullmatch(r"epoch-(\d+)", x.base_name)
        if m and fs.get_file_info(f"{x.path}/_SUCCESS").type == pafs.FileType.File:
            found.append(int(m[1]))
    return sorted(found)


def write(blocks: DataFrame, path: str, epoch: int) -> None:
    """Commit a table of blocks as an epoch; one that was begun and not committed is replaced."""
    blocks.write.mode("overwrite").parquet(epoch_path(path, epoch))


def forget(path: str, keep: int) -> None:
    """Delete all but the last epochs."""
    fs, root = filesystem(path)
    for e in epochs(path)[:-keep]:
        fs.delete_dir(epoch_path(root, e))


def save(spark: SparkSession, arrays: Arrays, path: str, epoch: int = 0) -> None:
    """Store arrays that the driver has."""
    rows = []
    for name, a in sorted(arrays.items()):
        flat = np.ascontiguousarray(a).ravel()
        for k in range(max(1, -(-flat.size // BLOCK))):
            rows.append((name, a.dtype.str, list(a.shape), k, bytearray(flat[k * BLOCK : (k + 1) * BLOCK].tobytes())))
    write(spark.createDataFrame(rows, SCHEMA), path, epoch)


def load(path: str, epoch: int | None = None, names: list[str] | None = None) -> Arrays:
    """The arrays of an epoch, the last if none is named; read without Spark, so also on executors."""
    if epoch is None:
        known = epochs(path)
        if not known:
            raise FileNotFoundError(f"{path}: no committed epoch")
        epoch = known[-1]
    fs, root = filesystem(epoch_path(path, epoch))
    filters = None if names is None else [("name", "in", names)]
    rows = pq.read_table(root, filesystem=fs, filters=filters).sort_by([("name", "ascending"), ("block", "ascending")]).to_pylist()
    out: Arrays = {}
    for name in dict.fromkeys(r["name"] for r in rows):
        own = [r for r in rows if r["name"] == name]
        out[name] = np.frombuffer(b"".join(r["data"] for r in own), own[0]["kind"]).reshape(own[0]["shape"]).copy()
    return out
