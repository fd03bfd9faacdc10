"""Change streams. The engine's queries are batch; what arrives as a stream are changes, which are committed batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..operators.changes import last_write


def commit_stream(changes: DataFrame, keys: list[str], order: list[str], apply: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """A writer that gives `apply` the last write of each key of every micro-batch, with the batch's number.

    A batch that is run again after a failure has the same number, by which `apply` can tell.
    """
    return changes.writeStream.foreachBatch(lambda batch, number: apply(last_write(batch, keys, order), number))
