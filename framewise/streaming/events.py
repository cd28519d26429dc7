"""Micro-batch forms of operators that need no state across batches: each event is mapped by itself, and each file of scores is one medium."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.remap import map_events
from ..operators.signal import filled, intervals, judged


def remap_stream(events: DataFrame, segments: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Map a stream of events (``media_id, event_id, start, end``) to the output clock; ``sink`` gets each batch and its number, so that a batch
    that is tried again can be written over."""
    return events.writeStream.foreachBatch(lambda df, n: sink(map_events(df, segments), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def interval_stream(scores: DataFrame, fps: float, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Intervals of whole media that arrive in one batch each. Votes look at following frames, so a medium must not be split over batches."""
    rows = scores.select("media_id", "display_idx", F.col("raw").cast("double").alias("raw"))
    return rows.writeStream.foreachBatch(lambda df, n: sink(intervals(filled(judged(df, fps))), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
