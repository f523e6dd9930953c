"""Streaming forms: last actions of a session, throttles, cooldowns, receipts, checkpoints as upserts.

State is dropped by event time, an hour after a session's last row and the watermark; a stream
that is read until its end so ends, which processing-time timers would prevent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

HOUR_MS = 3_600_000


def keyed(rows: DataFrame, session: str, time: str, late: str, step: Callable[[list, list[tuple]], tuple[list, list[tuple]]], out: str, state: str, *columns: str) -> DataFrame:
    """Runs step(state, rows in order of time) -> (state, output rows) for each session of a stream. Rows without a time or session are left out."""
    kind = dict(rows.dtypes)[session]
    names = [session, *(c.split()[0] for c in out.split(", "))]

    def run(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        got = [r for pdf in frames for r in pdf[["__at", *columns]].astype(object).where(pdf[["__at", *columns]].notna(), None).itertuples(index=False, name=None)]
        got.sort(key=lambda r: (r[0], *((x is not None, x) for x in r[1:])))
        kept, made = step(list(held.get[0]) if held.exists else [], got)
        held.update((kept,))
        held.setTimeoutTimestamp(max(max(r[0] for r in got) // 1000, held.getCurrentWatermarkMs()) + HOUR_MS)
        yield pd.DataFrame([(key[0], *m) for m in made], columns=names)

    stream = rows.filter(F.col(time).isNotNull() & F.col(session).isNotNull()).withWatermark(time, late).select(session, time, F.unix_micros(F.col(time).cast("timestamp")).alias("__at"), *(c for c in columns if c not in (session, time)))
    return stream.groupBy(session).applyInPandasWithState(run, f"{session} {kind}, {out}", f"held array<{state}>", "append", GroupStateTimeout.EventTimeTimeout)


def last_actions(events: DataFrame, session: str, time: str, order: str, value: str, n: int = 20, late: str = "1 hour") -> DataFrame:
    """A stream of (session, values): the last n values of each session by time, then `order` (a number), whenever it gets rows. Null values stay."""

    def step(held: list, got: list[tuple]) -> tuple[list, list[tuple]]:
        rows = [tuple(h) for h in held] + [(a, int(o), v) for a, o, v in got]
        rows = sorted(rows, key=lambda r: r[:2])[-n:]
        return rows, [([v for _, _, v in rows],)]

    return keyed(events.withColumn(value, F.col(value).cast("string")), session, time, late, step, "values array<string>", "struct<at:bigint,o:bigint,v:string>", order, value)


def throttle(events: DataFrame, session: str, time: str, order: str, gap_ms: int = 600, late: str = "1 hour") -> DataFrame:
    """A stream of (session, order): rows that come more than gap_ms after the last one kept of their session."""

    def step(held: list, got: list[tuple]) -> tuple[list, list[tuple]]:
        made, last = [], held[0] if held else None
        for at, o in got:
            if last is None or at // 1000 - last > gap_ms:
                made.append((int(o),))
                last = at // 1000
        return [last], made

    return keyed(events, session, time, late, step, f"{order} bigint", "bigint", order)


def drained(events: DataFrame, session: str, time: str, order: str, value: str, drain: str, n: int = 20, late: str = "1 hour") -> DataFrame:
    """A stream of (session, values) at each row whose value is `drain`: the last n values since the drain before."""

    def step(held: list, got: list[tuple]) -> tuple[list, list[tuple]]:
        rows, made = list(held), []
        for _, _, v in got:
            if v == drain:
                made.append((rows,))
                rows = []
            else:
                rows = [*rows, v][-n:]
        return rows, made

    return keyed(events.withColumn(value, F.col(value).cast("string")), session, time, late, step, "values array<string>", "string", order, value)


def breaker(events: DataFrame, session: str, time: str, order: str, failed: Column, cooldown_ms: int = 60_000, late: str = "1 hour") -> DataFrame:
    """A stream of (session, order, open): open rows come within cooldown_ms after a failure and are not tried, so that they cannot fail."""

    def step(held: list, got: list[tuple]) -> tuple[list, list[tuple]]:
        made, until = [], held[0] if held else None
        for at, o, bad in got:
            closed = until is None or at // 1000 >= until
            made.append((int(o), not closed))
            if closed and bad:
                until = at // 1000 + cooldown_ms
        return [until], made

    return keyed(events.withColumn("__bad", F.coalesce(failed, F.lit(False))), session, time, late, step, f"{order} bigint, open boolean", "bigint", order, "__bad")


def totals(events: DataFrame, time: str, value: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Event-time receipts: count and sum of a value by window, with late rows up to `late`."""
    return events.withWatermark(time, late).groupBy(F.window(time, window)).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), "n", "total")


def sessions(events: DataFrame, session: str, time: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Visits of each session, parted by pauses of `gap`: (session, start, end, n)."""
    w = F.session_window(time, gap)
    return events.withWatermark(time, late).groupBy(session, w).agg(F.count(F.lit(1)).alias("n")).select(session, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def upsert(key: str, order: str, path: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: one row of each key with the last row's columns, saved_at and updated_at, merged with the batches before.

    Rows are kept in `buckets` folders by key; a batch rewrites those that it touches, as a new
    version beside the old one, and names the version of each bucket in a small index that is
    written last, so that readers see whole versions and a batch that runs again begins from the
    one before it. `current` reads the table.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = batch.filter(F.col(key).isNotNull()).withColumn("saved_at", F.col(order)).withColumn("updated_at", F.col(order)).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        touched = [r[0] for r in rows.select("bucket").distinct().collect()]  # `buckets` at most
        before = versions(spark, path, epoch)
        old = [f"{path}/version={v}/bucket={b}" for b, v in before.items() if b in touched]
        names = [c for c in rows.columns if c != "bucket"]
        if old:
            rows = rows.unionByName(spark.read.parquet(*old).select(names).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")))
        rest = [c for c in names if c not in (key, "saved_at", "updated_at")]
        last = rows.groupBy("bucket", key).agg(F.min("saved_at").alias("saved_at"), F.max("updated_at").alias("updated_at"), F.max_by(F.struct(*rest), F.struct("updated_at", *(c for c in rest if c == order))).alias("r"))
        last.select("bucket", key, "saved_at", "updated_at", "r.*").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/version={epoch}")
        index = before | dict.fromkeys(touched, epoch)
        spark.createDataFrame([(b, v) for b, v in index.items()], "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{path}/index/epoch={epoch}")

    return write


def versions(spark, path: str, before: int | None = None) -> dict[int, int]:
    """The version of each bucket, as the last index says; of the epochs below `before` where it is given."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/index")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return {}
    epochs = [int(s.getPath().getName().partition("=")[2]) for s in fs.listStatus(folder) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    done = [e for e in epochs if before is None or e < before]
    return {r["bucket"]: r["version"] for r in spark.read.parquet(f"{path}/index/epoch={max(done)}").collect()} if done else {}


def current(spark, path: str) -> DataFrame:
    """The table that upsert keeps."""
    return spark.read.parquet(*(f"{path}/version={v}/bucket={b}" for b, v in sorted(versions(spark, path).items())))
