"""Questions answered as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from ..functions import ledger


def answer_stream(questions: DataFrame, path: str, checkpoint: str, answer: Callable[[str], str | None], question: str = "question", concurrency: int = 30, threads: int = 1) -> StreamingQuery:
    """Ask each micro-batch's new questions and put the answers into the ledger at path. A batch that is run again after
    a failure finds what it was told, so the stream and the ledger together ask once."""

    def run(batch: DataFrame, _: int) -> None:
        ledger.ask(batch, path, answer, question, concurrency, threads)

    return questions.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
