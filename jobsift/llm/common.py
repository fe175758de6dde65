"""What the operators of this subpackage share: the shared folder, staged tables, size-checked joins."""

from __future__ import annotations

import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Rows that a Python worker works on at once. Batches arrive with at most 64 MB
#: (spark.sql.execution.arrow.maxBytesPerBatch) and are worked on in slices of so many rows and bytes.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20
#: A table of at most so many (narrow) rows may be broadcast: about 100 bytes a row, so 20 MB.
BROADCAST_ROWS = 200_000

_own_dir: str | None = None
#: Staged tables, and the thread that staged each: operators may run side by side.
_staged: dict[str, int] = {}
_shipping = threading.Lock()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver share: spark.checkpoint.dir; if that is unset, one beside
    a warehouse that isn't a local folder; in local mode a temporary folder. A cluster with none of these is
    refused, since each executor would write to its own disk."""
    global _own_dir
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        if "://" not in warehouse or warehouse.startswith("file:"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors and the driver share")
        return warehouse.rstrip("/") + "/_stages"
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="jobsift-")
    return _own_dir


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _staged[path] = threading.get_ident()
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back. This cuts lineage, so a lost executor
    costs no more than re-reading a file, and later steps see the very same rows. unstage() or sweep()
    deletes it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._jobsift_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _staged.pop(path, None)


def unstage(*tables: DataFrame) -> None:
    """Delete tables, as stage() returned them, that no later plan reads."""
    for df in tables:
        _delete(df.sparkSession, df._jobsift_path)


def sweep(spark: SparkSession) -> int:
    """Delete all tables that operators have staged and not deleted yet, once no result that was returned is
    needed any more; how many they were. What an operator returns reads such tables when it runs."""
    gone = [p for p in list(_staged) if p.startswith(shared_dir(spark))]
    for path in gone:
        _delete(spark, path)
    return len(gone)


def settle(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """Stage what make() returns and delete everything that this thread has staged on the way to it."""
    before, own = set(_staged), threading.get_ident()
    out = stage(make(), name)
    for path in [p for p, by in list(_staged.items()) if by == own and p not in before and p != out._jobsift_path]:
        _delete(out.sparkSession, path)
    return out


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, how: str = "inner") -> DataFrame:
    """Join rows to the one row of their group without a hot key meeting in one task. Groups with a
    thousandth of all rows or more, of which there are at most a thousand, are broadcast; the rest are
    shuffled. size: the column of groups that holds the group's rows. groups should be staged. If there are at
    most BROADCAST_ROWS rows, and so groups, all groups are broadcast."""
    if total <= BROADCAST_ROWS:
        return rows.join(F.broadcast(groups), key, how).select(*rows.columns, *[c for c in groups.columns if c != key])
    is_hot = F.col(size) * 1000 >= total
    hot = groups.filter(is_hot).select(key, F.struct(*[c for c in groups.columns if c != key]).alias("_jobsift_group"))
    marked = rows.join(F.broadcast(hot), key, "left")
    at_once = marked.filter("_jobsift_group is not null").select(*rows.columns, "_jobsift_group.*")
    dealt = marked.filter("_jobsift_group is null").drop("_jobsift_group").join(groups.filter(~is_hot), key, how)
    return at_once.unionByName(dealt)


def together(df: DataFrame, rows: int) -> DataFrame:
    """A table of so many narrow rows before it is grouped: at most BROADCAST_ROWS are grouped by the one bounded task
    that reads them, instead of by an exchange to tasks that nearly all get nothing."""
    return df.coalesce(1) if rows <= BROADCAST_ROWS else df


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII text takes the fast built-in path."""
    return F.when(F.octet_length(col) == F.length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def ship(spark: SparkSession) -> None:
    """Before an operator runs Python: see that workers can import this package in local mode. On a cluster it
    is installed, or given as --py-files."""
    sc = spark.sparkContext
    with _shipping:
        if sc.master.startswith("local[") and not getattr(sc, "_jobsift_shipped", False):
            package = Path(__file__).resolve().parent.parent
            made = Path(tempfile.mkdtemp(prefix="jobsift-")) / f"{package.name}.zip"
            with zipfile.ZipFile(made, "w") as z:
                for f in sorted(package.rglob("*.py")):
                    z.write(f, f.relative_to(package.parent))
            sc.addPyFile(str(made))
            sc._jobsift_shipped = True


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most BATCH_ROWS rows, and fewer where rows are long."""
    for batch in batches:
        a_row = batch.nbytes // max(1, batch.num_rows)
        rows = max(1, min(BATCH_ROWS, BATCH_BYTES // max(1, a_row)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A batch function that gets slices, and whose worker, which Spark keeps for later tasks, gives unused
    memory back."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(slices(batches))
        finally:
            pa.default_memory_pool().release_unused()

    return wrapped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def schema_with(df: DataFrame, **more: str) -> T.StructType:
    """The table's schema and further columns, given as name=type."""
    out = T.StructType(list(df.schema.fields))
    for name, kind in more.items():
        out = out.add(name, kind)
    return out
