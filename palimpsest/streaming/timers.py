"""Stateful streams with several state variables and timers: debounced rows, and what a task remembers.

Needs the RocksDB state store (`use_rocksdb`). Timers are of event time: they fire once the
watermark has passed them, so that a stream that is read until its end ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.decisions import SUCCEEDING

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Set the session's state store to one that holds several variables and timers."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def in_order(frames: Iterator[pd.DataFrame], *columns: str) -> list[tuple]:
    """All rows of a key in a batch, by the first columns that say so, nulls as None."""
    rows = [r for pdf in frames for r in pdf[list(columns)].astype(object).where(pdf[list(columns)].notna(), None).itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: r[:2])


class Debounce(StatefulProcessor):
    """Holds the last row of a burst until a pause of `quiet_ms` has passed by rows or by the watermark."""

    def __init__(self, quiet_ms: int, session: str):
        self.quiet_ms, self.session = quiet_ms, session

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "at bigint, o bigint")

    def made(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], o, pd.Timestamp(at + self.quiet_ms, unit="ms")) for at, o in rows], columns=[self.session, "o", "fires_at"])

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        got = in_order(rows, "at", "o")
        last = self.held.get() if self.held.exists() else None
        known = sorted([*([tuple(map(int, last))] if last else []), *((int(a), int(o)) for a, o in got)])
        if last:
            self.handle.deleteTimer(int(last[0]) + self.quiet_ms)
        out = [x for x, y in zip(known[:-1], known[1:], strict=True) if y[0] - x[0] >= self.quiet_ms]
        self.held.update(known[-1])
        self.handle.registerTimer(known[-1][0] + self.quiet_ms)
        yield self.made(key, out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        last = self.held.get() if self.held.exists() else None
        self.held.clear()
        yield self.made(key, [tuple(map(int, last))] if last else [])

    def close(self) -> None:
        return


def debounced(events: DataFrame, session: str, time: str, order: str, quiet_ms: int = 400, late: str = "1 hour") -> DataFrame:
    """A stream of (session, order, fires_at): the last row of each burst, once nothing of its session has followed for quiet_ms.

    Rows that come later than `late` behind the watermark are dropped by it; so are those without a session, time or order.
    """
    kind = dict(events.dtypes)[session]
    rows = events.filter(F.col(session).isNotNull() & F.col(time).isNotNull() & F.col(order).isNotNull()).withWatermark(time, late).select(session, time, F.unix_millis(F.col(time).cast("timestamp")).alias("at"), F.col(order).cast("bigint").alias("o"))
    out = rows.groupBy(session).transformWithStateInPandas(Debounce(quiet_ms, session), f"{session} {kind}, o bigint, fires_at timestamp", "Append", "eventTime")
    return out.withColumnRenamed("o", order)


class Memory(StatefulProcessor):
    """Counts of attempts, what blocked since the last success, and the last confirmations, each a variable of its own."""

    def __init__(self, session: str, blockers: int, confirmations: int):
        self.session, self.most_blockers, self.most_confirmations = session, blockers, confirmations

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "attempted bigint, succeeded bigint")
        self.blockers = handle.getListState("blockers", "line string")
        self.confirmations = handle.getListState("confirmations", "line string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        attempted, succeeded = map(int, self.counts.get()) if self.counts.exists() else (0, 0)
        blocked = [b for (b,) in self.blockers.get()] if self.blockers.exists() else []
        confirmed = [b for (b,) in self.confirmations.get()] if self.confirmations.exists() else []
        out = []
        for _, o, good, blocker, confirmation in in_order(rows, "at", "o", "good", "blocker", "confirmation"):
            attempted += 1
            succeeded += int(bool(good))
            blocked = [] if good else [*blocked, blocker][-self.most_blockers :] if blocker else blocked
            confirmed = [*confirmed, confirmation][-self.most_confirmations :] if confirmation is not None else confirmed
            out.append((key[0], int(o), attempted, succeeded, attempted - succeeded, list(blocked), list(confirmed)))
        self.counts.update((attempted, succeeded))
        for state, lines in ((self.blockers, blocked), (self.confirmations, confirmed)):
            if lines:
                state.put([(x,) for x in lines])
            else:
                state.clear()
        yield pd.DataFrame(out, columns=[self.session, "o", "attempted", "succeeded", "failed", "blockers", "confirmations"])

    def close(self) -> None:
        return


def task_memory(events: DataFrame, session: str, time: str, order: str, outcome: Column, blocker: Column, confirmation: Column, late: str = "1 hour", blockers: int = 3, confirmations: int = 5) -> DataFrame:
    """A stream of (session, order, attempted, succeeded, failed, blockers, confirmations) for each row of a stream.

    Within a batch rows go by time, then order; a row of a later batch counts after those before. Rows without a session, time or order are left out.
    """
    kind = dict(events.dtypes)[session]
    good = F.coalesce(outcome.isin(SUCCEEDING), F.lit(False))
    rows = events.filter(F.col(session).isNotNull() & F.col(time).isNotNull() & F.col(order).isNotNull()).withWatermark(time, late)
    rows = rows.select(session, time, F.unix_micros(F.col(time).cast("timestamp")).alias("at"), F.col(order).cast("bigint").alias("o"), good.alias("good"), F.nullif(blocker, F.lit("")).alias("blocker"), confirmation.alias("confirmation"))
    out = rows.groupBy(session).transformWithStateInPandas(Memory(session, blockers, confirmations), f"{session} {kind}, o bigint, attempted bigint, succeeded bigint, failed bigint, blockers array<string>, confirmations array<string>", "Append", "eventTime")
    return out.withColumnRenamed("o", order)
