"""Entries with a time to live as a stream's state: the latest of each key until its time has passed.

State and timers live in Spark's state store, so a stream that starts again from its checkpoint knows
what was live and when it ends. Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


class Entries(StatefulProcessor):
    """The latest entry (at in milliseconds, id) of a key; a row when it changes, and one when it has expired.

    ttl: milliseconds of event time from an entry on. idle: milliseconds of the clock after which a
    key's state goes even if the stream stands still, or None.
    """

    def __init__(self, keys: list[str], ttl: int, idle: int | None = None) -> None:
        self.keys, self.ttl, self.idle = keys, ttl, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at bigint, id bigint", **({"ttlDurationMs": self.idle} if self.idle else {}))

    def _row(self, key: tuple, at: int, entry: int, live: bool) -> pd.DataFrame:
        return pd.DataFrame({**{c: [v] for c, v in zip(self.keys, key, strict=True)}, "at": [at], "id": [entry], "live": [live]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        before = self.last.get() if self.last.exists() else None
        best = tuple(before) if before is not None else None
        for part in rows:
            for at, entry in zip(part["at"].tolist(), part["id"].tolist(), strict=True):
                best = (at, entry) if best is None else max(best, (at, entry))
        if before is not None and best == tuple(before):
            return
        if before is not None:
            self.handle.deleteTimer(before[0] + self.ttl)
        self.last.update(best)
        self.handle.registerTimer(best[0] + self.ttl)
        yield self._row(key, *best, True)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        if self.last.exists():
            at, entry = self.last.get()
            if at + self.ttl <= expiredTimerInfo.getExpiryTimeInMs():
                self.last.clear()
                yield self._row(key, at, entry, False)

    def close(self) -> None:
        pass


def live_stream(stream: DataFrame, keys: list[str], ts: str, id_col: str, ttl: dt.timedelta, late: str = "0 seconds", idle: int | None = None) -> DataFrame:
    """keys, at, id, live of a stream: changes of what is live. ttl: the time to live; late: how far behind events may come.

    An entry ends once the watermark has passed its time and the time to live. Entries that are late
    beyond the watermark are dropped; of entries of one time the largest id counts.
    """
    length = int(ttl.total_seconds() * 1000)
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    small = timed.select(*keys, F.col(ts), F.unix_millis(F.col(ts)).alias("at"), F.col(id_col).cast("bigint").alias("id"))
    kinds = ", ".join(f"{c} {small.schema[c].dataType.simpleString()}" for c in keys)
    return small.groupBy(*keys).transformWithStateInPandas(Entries(keys, length, idle), f"{kinds}, at bigint, id bigint, live boolean", "Update", "EventTime")


def live_now(changes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, at, id of what is live after all changes that live_stream has made."""
    last = changes.groupBy(*keys).agg(F.max_by(F.struct("at", "id", "live"), F.struct("at", "id", ~F.col("live"))).alias("x"))
    return last.where("x.live").select(*keys, "x.at", "x.id")
