"""New image files as a stream, through the same operators as in batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_results(files: DataFrame, process: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Write process(files) as Parquet, exactly once, until no file is left unread.

    process works row by row (detection, cropping, recognition), so no state and no watermark are
    needed. The checkpoint and the output have to be in folders that all executors share.
    """
    return (
        process(files).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    )


def stream_counts(events: DataFrame, late: str, window: str) -> DataFrame:
    """Results per window and status, closed when the watermark passes it."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("window"), "status").agg(F.count("*").alias("n"))
