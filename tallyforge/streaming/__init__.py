"""Code counts over an event stream, on the batch operator's plan.

The same two-level aggregate fed by Structured Streaming: each micro-batch becomes cells,
which are appended to a table and merged when read, so counts stay exact and state lives in
the table, not in executors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.counting import count_cells, subject_cells, union_cells


def stream_cells(events: DataFrame, keys: Sequence[str], folder: str, checkpoint: str) -> StreamingQuery:
    """Append the cells of each micro-batch below ``folder``; a replayed batch overwrites its own."""

    def write(batch: DataFrame, number: int) -> None:
        subject_cells(batch, keys).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    starter = events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return starter.trigger(availableNow=True).start()


def counts_so_far(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Exact counts per key from all cells written so far."""
    return count_cells(union_cells(cells, keys), keys)
