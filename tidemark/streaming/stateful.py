"""Streams with state of their own: visitors with an age limit, verdicts when a day settles, exact bursts.

All state is bounded: by timers of event time that remove it, and by counts that stop at the number that decides. These need
the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``), which keeps state outside the heap.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.traffic import SEARCH_ENGINES
from tidemark.sources import files
from tidemark.sources.snapshots import SnapshotTable

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS, MINUTE_MS = 86_400_000, 60_000


# ---------------------------------------------------------------- visitors


TOUCHES = "anon_id long, since long, first_us long, first_src string, last_us long, visits long"


def visitor_touches(visits: DataFrame, keep: str = "30 days", late: str = "30 minutes") -> DataFrame:
    """Changed visitors of each batch: (anon_id, since, first_us, first_src, last_us, visits).

    ``visits`` has (anon_id, ts, src). A visitor has one row for each span of ``keep`` with events, told apart by ``since``, its
    beginning; the state of a span goes when the watermark passes its end. So a row (anon_id, since) only grows, and writing
    it again is harmless. The state is that of an aggregation: rows are added up before they reach it, and none goes to Python.
    """
    us = F.unix_micros("ts")
    rows = visits.withWatermark("ts", late).groupBy("anon_id", F.window("ts", keep).alias("span")).agg(
        F.min(F.struct(us.alias("us"), F.coalesce("src", F.lit("")).alias("known"), "src")).alias("first"), F.max(us).alias("last_us"), F.count("*").alias("visits")
    )
    return rows.select("anon_id", F.unix_micros("span.start").alias("since"), F.col("first.us").alias("first_us"), F.col("first.src").alias("first_src"), "last_us", "visits")


def into_table(table: SnapshotTable, name: str):
    """A function for ``foreachBatch`` that upserts a batch by the keys of a stored table. A batch that is sent again after a
    failure is known by its number and changes nothing. Rows are written first and then merged: the state of a batch is made once."""

    def write(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        path = files.scratch(spark, f"{name}-batch")
        rows.write.parquet(path)
        table.upsert(spark.read.schema(rows.schema).parquet(path), f"{name}-{batch}")
        files.drop(spark, path)

    return write


def first_touch_of(table: DataFrame) -> DataFrame:
    """(anon_id, first_src, first_seen, last_seen, visits) of stored touches, all rows of a visitor together."""
    return table.groupBy("anon_id").agg(
        F.min_by("first_src", "first_us").alias("first_src"), F.timestamp_micros(F.min("first_us")).alias("first_seen"), F.timestamp_micros(F.max("last_us")).alias("last_seen"), F.sum("visits").alias("visits")
    )


# ---------------------------------------------------------------- verdicts

_EVIDENCE = "searched boolean, mobile boolean, page string, pages boolean"


def _with(a: tuple, b: tuple) -> tuple:
    """Evidence (searched, mobile, a page, whether there are two) of two spans together."""
    page = a[2] if a[2] is not None else b[2]
    two = a[3] or b[3] or (a[2] is not None and b[2] is not None and a[2] != b[2])
    return a[0] or b[0], a[1] or b[1], page, two


class _Settled(StatefulProcessor):
    """A visitor is one value of state, read and written once for a batch and once for a timer: its open days, the evidence of
    settled ones, and the moment of its only timer, which settles all days that are due."""

    def __init__(self, zone_ms: int, after_ms: int, keep_days: int) -> None:
        self.zone_ms, self.after_ms, self.keep_days = zone_ms, after_ms, keep_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", f"open array<struct<day int, {_EVIDENCE}, events long>>, {_EVIDENCE}, days boolean, last int, timer long")

    def _settles(self, day: int) -> int:
        return (day + 1) * DAY_MS - self.zone_ms + self.after_ms

    def _read(self) -> tuple[dict[int, tuple], tuple | None, int | None]:
        """Open days, the evidence of settled ones with (days, last), and the timer."""
        held = self.seen.get()
        if held is None:
            return {}, None, None
        return {d[0]: tuple(d)[1:] for d in held[0]}, tuple(held)[1:7] if held[6] is not None else None, held[7]

    def _write(self, days: dict[int, tuple], past: tuple | None, timer: int | None) -> None:
        if not days and past is None:
            self.seen.clear()
            return
        due = min(self._settles(d) for d in (*days, *([past[5] + self.keep_days] if past is not None else [])))
        if timer is None or due < timer:
            self.handle.registerTimer(due)
            timer = due
        self.seen.update(([(d, *days[d]) for d in sorted(days)], *(past if past is not None else (False, False, None, False, False, None)), timer))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        days, past, timer = self._read()
        for _, _, day, searched, mobile, path in rows:
            held = days.get(day)
            days[day] = (searched, mobile, path, False, 1) if held is None else (*_with(held[:4], (searched, mobile, path, False)), held[4] + 1)
        self._write(days, past, timer)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        days, past, timer = self._read()
        out = []
        for day in sorted(d for d in days if self._settles(d) <= now):
            *own, events = days.pop(day)
            if past is not None and past[5] + self.keep_days < day:  # nothing for so long: the visitor was forgotten
                past = None
            searched, mobile, page, pages = _with(past[:4] if past is not None else (False, False, None, False), tuple(own))
            several = past is not None and (past[4] or past[5] != day)
            past = searched, mobile, page, pages, several, day
            out.append(Row(anon_id=key[0], day=day, events=events, bot=not (searched or mobile or pages or several)))
        if past is not None and self._settles(past[5] + self.keep_days) <= now:
            past = None
        self._write(days, past, timer if timer is not None and timer > now else None)
        return iter(out)


def day_verdicts(visits: DataFrame, agent: str = "user_agent", zone_hours: int = 9, after: int = 30, keep_days: int = 30, late: str = "30 minutes") -> DataFrame:
    """(anon_id, day, events, bot): for each visitor and local day, once, ``after`` minutes after the day's end.

    A visitor without any sign of a person up to that day is a bot: no search engine, no phone, one page, one day. Days settle
    in order, each by what belongs to it and earlier ones, so events of the next morning do not count; events that are late
    by no more than ``late`` do. After ``keep_days`` without events a visitor is forgotten.
    """
    day = F.floor((F.unix_millis("ts") + zone_hours * 3_600_000) / DAY_MS).cast("int")
    mobile = F.coalesce(agent, F.lit("")).rlike("(?i)Mobile|iPhone|Android")
    rows = visits.withWatermark("ts", late).select("anon_id", "ts", day.alias("day"), F.coalesce(F.col("src").isin(*SEARCH_ENGINES), F.lit(False)).alias("searched"), mobile.alias("mobile"), "path")
    out = rows.groupBy("anon_id").transformWithState(_Settled(zone_hours * 3_600_000, after * MINUTE_MS, keep_days), "anon_id long, day int, events long, bot boolean", "append", "EventTime")
    return out.withColumn("day", F.date_from_unix_date("day"))


# ---------------------------------------------------------------- bursts


class _Bursts(StatefulProcessor):
    def __init__(self, ids: int) -> None:
        self.ids = ids

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("ids", "anon_id long", "one boolean")
        self.hot = handle.getValueState("hot", "hot boolean")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        slot = key[0]
        hot = self.hot.exists()
        held = set() if hot else {k[0] for k in self.held.keys()}  # noqa: SIM118
        if not hot and not held:
            self.handle.registerTimer(slot + MINUTE_MS)
        sent: set[int] = set()
        for r in rows:
            i = r["anon_id"]
            if hot:
                if i not in sent:
                    sent.add(i)
                    yield Row(slot=slot, anon_id=i)
                continue
            if i in held:
                continue
            held.add(i)
            self.held.updateValue((i,), (True,))
            if len(held) >= self.ids:
                hot = True
                self.hot.update((True,))
                self.held.clear()
                for x in sorted(held):
                    sent.add(x)
                    yield Row(slot=slot, anon_id=x)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        self.held.clear()
        self.hot.clear()
        return iter(())


def burst_visitors(visits: DataFrame, prefix: str = "/c/", ids: int = 8, late: str = "30 minutes") -> DataFrame:
    """(slot, anon_id) of visitors seen in a minute in which ``ids`` or more visitors opened pages of one kind; exact.

    A minute holds at most ``ids`` visitors: when it has so many they are sent, and further ones at once without being held,
    so a visitor may be sent again in a later batch. What a minute holds goes when the watermark passes its end. Null
    visitors do not count.
    """
    own = visits.where(F.col("path").startswith(prefix) & F.col("anon_id").isNotNull()).withWatermark("ts", late)
    rows = own.select("anon_id", "ts", F.unix_millis(F.date_trunc("minute", "ts")).alias("slot_ms"))
    out = rows.groupBy("slot_ms").transformWithState(_Bursts(ids), "slot long, anon_id long", "append", "EventTime")
    return out.select(F.timestamp_millis("slot").alias("slot"), "anon_id")
