"""Streaming extensions: windowed event counts, sessions and scoring of arriving results.

The batch operators are reused unchanged; only the windows and the sink are new.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docscore.operators import aggregate as A
from docscore.operators import score as C


def event_windows(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Count and sum of values by event type in tumbling or sliding windows; later events than ``late`` are dropped."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "n", "total"
    )


def event_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Events of a user no further apart than ``gap`` as one session."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select(
        "user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n"
    )


def score_stream(facts: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Score arriving fact rows batch by batch; ``sink`` gets the engine counters of each batch with its number."""

    def each(batch: DataFrame, number: int) -> None:
        sink(A.engine_counters(C.scored(batch)), number)

    return facts.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
