"""Incremental work on streams: repeated keys of a session, and builds for commit events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def commit_events(events: DataFrame) -> DataFrame:
    """Tool events (tool_name, tool_input) that are a shell command with a commit."""
    return events.where((F.col("tool_name") == "Bash") & F.coalesce(F.col("tool_input")["command"].contains("git commit"), F.lit(False)))


def first_of_session(events: DataFrame, keys: list[str], ts: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Each key of a session once: of a table the earliest event by the time column, of equals the least
    row; without a time column any. On a stream, with a time column, keys are forgotten after the delay."""
    if events.isStreaming and ts:
        return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)
    if events.isStreaming or not ts:
        return events.dropDuplicates(keys)
    rest = [c for c in events.columns if c not in keys]
    first = F.min(F.struct(ts, *[c for c in rest if c != ts])).alias("_first")
    return events.groupBy(*keys).agg(first).select(*keys, "_first.*").select(*events.columns)


def build_on_commit(events: DataFrame, build: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs ``build(commits, batch_id)`` for every micro-batch with a commit. The checkpoint makes a
    restart go on where it was; a batch may be built again, so builds must be repeatable."""

    def each(batch: DataFrame, batch_id: int) -> None:
        commits = commit_events(batch)
        if not commits.isEmpty():
            build(commits, batch_id)

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
