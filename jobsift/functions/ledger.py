"""A ledger of answers: each distinct question is asked once, whatever is lost on the way.

Questions are keyed by a hash. A run asks only those that the ledger doesn't hold. While it asks, every few answers
go to a file of their own on shared storage, so a task that is tried again, or a run after one that failed, begins
with what was already said. When all are answered, the answers join the ledger in one commit of Spark's, and the
files go. What can be asked twice is what was on its way when a task was lost; the transport's idempotency key
covers that.
"""

from __future__ import annotations

import json
import sys
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have this package
#: Answers that are stored at a time, for each thread.
STORE = 4
#: Groups of questions of a run; a group's stored answers are read by the task that asks it.
GROUPS = 256
SCHEMA = "question_id string, question string, answer string"


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    return pafs.LocalFileSystem(), path


def answered(spark: SparkSession, path: str) -> DataFrame:
    """(question_id, question, answer) of the ledger at a path; nothing if there is none yet."""
    try:
        return spark.read.schema(SCHEMA).parquet(f"{path}/answers")
    except AnalysisException:
        return spark.createDataFrame([], SCHEMA)


def _stored(fs: pafs.FileSystem, folder: str) -> dict[str, str]:
    """What earlier tries of a group were told. A file that was cut short counts up to its last whole line."""
    said = {}
    for x in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
        with fs.open_input_stream(x.path) as f:
            for line in f.read().split(b"\n")[:-1]:
                key, answer = json.loads(line)
                said[key] = answer
    return said


def _store(fs: pafs.FileSystem, folder: str, said: list[tuple[str, str]]) -> None:
    fs.create_dir(folder, recursive=True)
    with fs.open_output_stream(f"{folder}/{uuid.uuid4().hex}") as f:
        f.write("".join(json.dumps(x) + "\n" for x in said).encode())


def ask(questions: DataFrame, path: str, answer: Callable[[str], str | None], question: str = "question", concurrency: int = 30, threads: int = 1) -> int:
    """Put the answers of all distinct questions into the ledger; how many had to be asked or taken over from
    a run that failed. At most concurrency calls run at a time, threads in each task.

    Null questions aren't asked. An answer of None is a failure that may be asked again by a later run. One run at a time
    may write a ledger, and tasks shouldn't be speculative."""
    spark = questions.sparkSession
    asked = questions.filter(F.col(question).isNotNull()).select(F.col(question).alias("question")).distinct()
    asked = asked.withColumn("question_id", F.sha2("question", 256))
    new = asked.join(answered(spark, path).select("question_id"), "question_id", "left_anti")
    group = F.pmod(F.xxhash64("question_id"), F.lit(GROUPS)).cast("int").alias("group")
    dealt = new.select(group, "question_id", "question").repartition(max(1, concurrency // threads), "group").sortWithinPartitions("group", "question_id")
    pending = f"{path}/pending"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(pending)
        last, said = None, {}
        with ThreadPoolExecutor(threads) as pool:
            for batch in batches:
                for at in range(0, batch.num_rows, STORE * threads):
                    rows = batch.slice(at, STORE * threads).to_pylist()
                    for r in rows:
                        if r["group"] != last:
                            last = r["group"]
                            said |= _stored(fs, f"{root}/{last}")
                    open_rows = [r for r in rows if r["question_id"] not in said]
                    told = zip(open_rows, pool.map(answer, [r["question"] for r in open_rows]), strict=True)
                    told = [(r["group"], r["question_id"], a) for r, a in told if a is not None]
                    for g in {g for g, _, _ in told}:
                        _store(fs, f"{root}/{g}", [(k, a) for own, k, a in told if own == g])
                    said |= {k: a for _, k, a in told}
                    found = [(r["question_id"], r["question"], said.pop(r["question_id"])) for r in rows if r["question_id"] in said]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*found, strict=True)] or [pa.array([], pa.string())] * 3, names=["question_id", "question", "answer"])

    before = answered(spark, path).count()
    dealt.mapInArrow(run, SCHEMA).write.mode("append").parquet(f"{path}/answers")
    fs, root = _filesystem(pending)
    if fs.get_file_info(root).type == pafs.FileType.Directory:
        fs.delete_dir(root)
    return answered(spark, path).count() - before


def with_answers(rows: DataFrame, path: str, question: str = "question") -> DataFrame:
    """The rows with the ledger's answer to their question, or null. The planner broadcasts a small ledger."""
    told = answered(rows.sparkSession, path).select(F.col("question_id").alias("_question_id"), "answer")
    return rows.join(told, F.sha2(F.col(question), 256) == F.col("_question_id"), "left").drop("_question_id")
