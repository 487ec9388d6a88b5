"""Streams over the ledger: events counted once, windows of savings, and decisions that stay as first made.

A watermark bounds what is held for late rows. Counting by certificate is exact within it; the batch ledger is
exact without. State of frozen decisions has a time to live instead of being cleared as a whole."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATE = "1 hour"


def with_time(events: DataFrame, late: str = LATE) -> DataFrame:
    return events.withColumn("ts", F.timestamp_millis("at_ms")).withWatermark("ts", late)


def count_once(events: DataFrame, late: str = LATE) -> DataFrame:
    """Each certificate's first event within the watermark. Events have a non-empty cert."""
    return with_time(events.where("coalesce(kept_reason, '') = ''"), late).dropDuplicatesWithinWatermark(["cert"])


def saved() -> F.Column:
    return F.when(F.col("transform") == "resolve", -F.col("reopened_tokens")).otherwise(F.greatest(F.col("input_tokens") - F.col("output_tokens"), F.lit(0)))


def windows(events: DataFrame, size: str = "1 hour", slide: str | None = None, start: str | None = None) -> DataFrame:
    """start, events, saved of each window. Weeks from Monday: size and slide `7 days`, start `4 days`."""
    w = F.window("ts", size, slide or size, start) if start else F.window("ts", size, slide or size)
    return events.groupBy(w).agg(F.count("*").alias("events"), F.sum(saved()).alias("saved")).select(F.col("window.start").alias("start"), "events", "saved")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    w = F.session_window("ts", gap)
    return events.groupBy(w, "tenant").agg(F.count("*").alias("events"), F.sum(saved()).alias("saved")).select("tenant", F.col("session_window.start").alias("start"), "events", "saved")


def freeze(blocks: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """blocks (id, wire): id, wire and first_seen. The first decision on an id is given again, byte by byte, to all that follow.

    With ttl_ms an id's state goes that long after its last row. Such a stream runs until it is stopped, also
    with the availableNow trigger, as Spark keeps looking for states that time out."""
    timeout = GroupStateTimeout.NoTimeout if ttl_ms is None else GroupStateTimeout.ProcessingTimeTimeout

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        for rows in batches:
            known = state.exists
            wire = state.get[0] if known else rows["wire"].iloc[0]
            if not known:
                state.update((wire,))
            if ttl_ms is not None:
                state.setTimeoutDuration(ttl_ms)
            yield pd.DataFrame({"id": rows["id"], "wire": wire, "first_seen": [not known and i == 0 for i in range(len(rows))]})

    return blocks.groupBy("id").applyInPandasWithState(decide, "id string, wire string, first_seen boolean", "wire string", "append", timeout)


def freeze_batch(blocks: DataFrame) -> DataFrame:
    """The same over a table: of an id's rows in order of seq the first decides."""
    first = blocks.groupBy("id").agg(F.min_by("wire", "seq").alias("wire"), F.min("seq").alias("__first"))
    return blocks.drop("wire").join(first, "id").withColumn("first_seen", F.col("seq") == F.col("__first")).drop("__first")
