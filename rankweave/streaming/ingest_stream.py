"""Feeding the library from a stream of arriving pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.ingest import Library


def start_ingest(arrivals: DataFrame, library: Library, base_url: str, *, checkpoint: str | None = None) -> StreamingQuery:
    """Ingest all pages ``(line, href, html)`` that are there, then stop.

    A micro-batch is one batch of the library, so one that is replayed after a
    failure overwrites its own first attempt.
    """

    def add(rows: DataFrame, epoch: int) -> None:
        library.ingest(rows, epoch, base_url)

    return (
        arrivals.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint or f"{library.root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
