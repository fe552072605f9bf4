"""Verification of a stream of answers. An extension: each micro-batch uses the batch operators, which keep no state across questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.citations import verify


def verify_stream(answers: DataFrame, hits: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """`answers`: a stream of (qid, answer); `hits`: the rows retrieved. `sink(verified, batch)` writes each micro-batch."""
    return answers.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, number: sink(verify(batch, hits), number)).start()
