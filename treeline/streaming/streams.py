"""Call counts, change bursts, continuous maintenance and call pairs on streams. Each takes a streaming or a batch DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def call_counts(events: DataFrame) -> DataFrame:
    """events(src, tgt) -> src, tgt, cnt."""
    return events.filter("src is not null and tgt is not null and src != tgt").groupBy("src", "tgt").agg(F.count("*").alias("cnt"))


def windowed_counts(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts by event time, tumbling or sliding; events later than `late` are dropped by the watermark."""
    when = F.window("ts", size, slide) if slide else F.window("ts", size)
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).filter("src is not null and tgt is not null and src != tgt")
    return rows.groupBy(when.alias("w"), "src", "tgt").agg(F.count("*").alias("cnt")).select(F.col("w.start").alias("start"), "src", "tgt", "cnt")


def bursts(changes: DataFrame, by: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """changes(ts, by, path): runs of events nearer than the gap, with their paths; the debounce of a watcher as session windows."""
    rows = changes.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if changes.isStreaming else changes
    grouped = rows.groupBy(by, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"), F.array_sort(F.collect_set("path")).alias("paths"))
    return grouped.select(by, F.col("w.start").alias("start"), "events", "paths")


class LastEvent(StatefulProcessor):
    """Holds each session's last event name and gives (before, this) pairs."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "name string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        part = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        names = part["name"].tolist()
        before = [self.last.get()[0] if self.last.exists() else None, *names[:-1]]
        self.last.update((names[-1],))
        pairs = [(key[0], a, b) for a, b in zip(before, names, strict=True) if a is not None and a != b]
        yield pd.DataFrame(pairs, columns=["session", "src", "tgt"])

    def close(self) -> None:
        pass


def call_pairs(events: DataFrame) -> DataFrame:
    """A stream of events(session, ts, event_id, name) -> session, src, tgt. Order holds within a micro-batch and between them."""
    return events.groupBy("session").transformWithStateInPandas(LastEvent(), "session long, src string, tgt string", "Append", "None")


class WaitingEvents(StatefulProcessor):
    """Holds a session's events until the watermark has passed them, then gives their (before, this) pairs in order.

    New events are appended to the state as they come; it is read once when a timer fires, which stands right behind
    the earliest event that waits. So the state holds the events of one delay, whatever the session's length.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "name string")
        self.waiting = handle.getListState("waiting", "at long, event_id long, name string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        for part in rows:
            part = part[part["at"] > passed]
            if len(part):
                self.waiting.appendList(list(zip(part["at"].tolist(), part["event_id"].tolist(), part["name"].tolist(), strict=True)))
                self.handle.registerTimer(int(part["at"].min()) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        events = sorted(tuple(e) for e in self.waiting.get()) if self.waiting.exists() else []
        ready = [e for e in events if e[0] <= passed]
        kept = events[len(ready) :]
        if ready:
            names = [e[2] for e in ready]
            before = [self.last.get()[0] if self.last.exists() else None, *names[:-1]]
            self.last.update((names[-1],))
            if kept:
                self.waiting.put(kept)
                self.handle.registerTimer(kept[0][0] // 1000 + 1)
            else:
                self.waiting.clear()
            pairs = [(key[0], a, b) for a, b in zip(before, names, strict=True) if a is not None and a != b]
            if pairs:
                yield pd.DataFrame(pairs, columns=["session", "src", "tgt"])

    def close(self) -> None:
        pass


def ordered_call_pairs(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """A stream of events(session, ts, event_id, name) -> session, src, tgt, in the order of (ts, event_id) over all micro-batches.

    Events wait until the watermark, the latest time seen less `late`, has passed them; those that come later still are
    dropped. What lies within `late` of the latest event stays in the state until a later one comes, so a finite stream
    ends with an event that is later by more than `late`. Events without a session, time, id or name do not count.
    """
    rows = events.filter("session is not null and ts is not null and event_id is not null and name is not null").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    rows = rows.select("session", "ts", F.unix_micros("ts").alias("at"), F.col("event_id").cast("long").alias("event_id"), "name")
    return rows.groupBy("session").transformWithStateInPandas(WaitingEvents(), "session long, src string, tgt string", "Append", "EventTime")


def maintain(files: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs apply(changed files, batch id) on each micro-batch; the batch id lets a repeated batch be told."""
    return files.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
