"""Structured Streaming forms of the traffic operators, with event-time watermarks."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def daily_counts(visits: DataFrame, late: str = "30 minutes", zone_hours: int = 9) -> DataFrame:
    """(day, pageviews): local days as tumbling windows; a day settles ``late`` after its last event."""
    start = f"{(24 - zone_hours) % 24} hours"
    w = F.window("ts", "1 day", "1 day", start)
    return visits.withWatermark("ts", late).groupBy(w).agg(F.count("*").alias("pageviews")).select(F.to_date(F.col("window.start") + F.expr(f"INTERVAL {zone_hours} HOURS")).alias("day"), "pageviews")


def sessions(visits: DataFrame, minutes: int = 30, late: str = "30 minutes") -> DataFrame:
    """(anon_id, start, end, events): sessions by gap, emitted when the watermark passes their end."""
    w = F.session_window("ts", f"{minutes} minutes")
    return visits.withWatermark("ts", late).groupBy("anon_id", w).agg(F.count("*").alias("events"), F.min("ts").alias("start"), F.max("ts").alias("end")).select("anon_id", "start", "end", "events")


def bursts(visits: DataFrame, ids: int = 8, late: str = "30 minutes") -> DataFrame:
    """(slot, visitors): minutes with many visitors; the distinct count is approximate, as exact sets would grow without bound."""
    w = F.window("ts", "1 minute")
    counts = visits.withWatermark("ts", late).groupBy(w).agg(F.approx_count_distinct("anon_id", 0.01).alias("visitors"))
    return counts.where(F.col("visitors") >= ids).select(F.col("window.start").alias("slot"), "visitors")


def distinct_events(visits: DataFrame, keys: list[str], late: str = "30 minutes") -> DataFrame:
    """Events without repeats of a key that arrive within the watermark."""
    return visits.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def first_touch(visits: DataFrame) -> DataFrame:
    """(anon_id, first_src, first_seen, last_seen, visits): visitor state, in update mode."""
    return visits.groupBy("anon_id").agg(F.min_by("src", "ts").alias("first_src"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("visits"))


def limited(visits: DataFrame, most: int = 5, seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    """(anon_id, ts, allowed): a fixed-window rate limiter with custom state; a window opens with its first event.

    A visitor's state goes once the watermark has passed the end of its window.
    """

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        opened, n = state.get if state.exists else (None, 0)
        # moments of all the visitor's Arrow batches in one order: 8 bytes each
        moments, allowed = pd.concat([batch["ts"] for batch in batches]).sort_values(), []
        for ts in moments:
            at = ts.timestamp()
            if opened is None or at >= opened + seconds:
                opened, n = at, 0
            n += 1
            allowed.append(n <= most)
        yield pd.DataFrame({"anon_id": key[0], "ts": moments.to_numpy(), "allowed": allowed})
        if opened is not None:
            state.update((opened, n))
            state.setTimeoutTimestamp(max(int((opened + seconds) * 1000), state.getCurrentWatermarkMs()) + 1)

    return visits.withWatermark("ts", late).groupBy("anon_id").applyInPandasWithState(step, "anon_id long, ts timestamp, allowed boolean", "opened double, n long", "append", GroupStateTimeout.EventTimeTimeout)
