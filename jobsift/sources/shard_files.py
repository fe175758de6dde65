"""A writer of text shards: one file a shard, with a byte-order mark, all or none of them.

Tasks write files under names of their own; the driver's commit renames them. A failed job leaves no shard.
"""

from __future__ import annotations

import csv
import io
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

MARK = b"\xef\xbb\xbf"
_PENDING = "_pending-"


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    return pafs.LocalFileSystem(), path


@dataclass
class _Written(WriterCommitMessage):
    files: dict[str, str]  # the shard's file by the name it was written under


class ShardWriter(DataSourceArrowWriter):
    """Rows sorted by their first column, which names the file and isn't written itself."""

    def __init__(self, path: str, names: list[str], sep: str, mark: bool) -> None:
        self.path, self.names, self.sep, self.mark = path, names, sep, mark

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = _filesystem(self.path)
        files: dict[str, str] = {}
        shard, out = None, None
        for batch in iterator:
            rows = zip(*[c.to_pylist() for c in batch.columns[1:]], strict=True)
            text = io.StringIO()
            for name, row in zip(batch.column(0).to_pylist(), rows, strict=True):
                if name != shard:
                    if out is not None:
                        out.write(text.getvalue().encode())
                        out.close()
                    shard, text = name, io.StringIO()
                    fs.create_dir(root, recursive=True)
                    files[f"{_PENDING}{uuid.uuid4().hex}"] = name
                    out = fs.open_output_stream(f"{root}/{list(files)[-1]}")
                    out.write(MARK if self.mark else b"")
                    self._lines(text).writerow(self.names)
                self._lines(text).writerow(row)
            if out is not None:
                out.write(text.getvalue().encode())
        if out is not None:
            out.close()
        return _Written(files)

    def _lines(self, text: io.StringIO):
        return csv.writer(text, delimiter=self.sep, lineterminator="\n")

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = _filesystem(self.path)
        for m in messages:
            for pending, name in (m.files if m else {}).items():
                fs.move(f"{root}/{pending}", f"{root}/{name}")
        self._clear(fs, root)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear(*_filesystem(self.path))

    def _clear(self, fs: pafs.FileSystem, root: str) -> None:
        for x in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
            if x.base_name.startswith(_PENDING):
                fs.delete_file(x.path)


class ShardFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shard_files"

    def writer(self, schema: T.StructType, overwrite: bool) -> ShardWriter:
        return ShardWriter(self.options["path"], schema.names[1:], self.options["sep"], self.options["mark"] == "true")


def write_shards(df: DataFrame, path: str, shard: str = "shard", pattern: str = "job_res_%s.csv", sep: str = "?", mark: bool = True) -> None:
    """Write the rows of each shard to one file, named by pattern, with a header and without the column shard. Fields
    that hold the separator, a quote or a line end are quoted; nulls are empty. A null shard is named by nothing. A shard's rows
    go to one task, as they go to one file, and stream through it; their order is that of nothing. A
    shard that is there already is replaced; the files of a job appear only when all have been written."""
    spark = df.sparkSession
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the workers that plan and commit can't import this package
    spark.dataSource.register(ShardFiles)
    name = F.format_string(pattern, F.coalesce(F.col(shard).cast("string"), F.lit("")))
    rows = df.select(name.alias("_file"), *[F.col(c).cast("string") for c in df.columns if c != shard])
    dealt = rows.repartition("_file").sortWithinPartitions("_file")
    dealt.write.format("shard_files").option("sep", sep).option("mark", str(mark).lower()).mode("append").save(path)
