"""What a session remembers: attempts, blockers, confirmations, throttles, cooldowns, visits. One row of events in, one or fewer out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .decisions import SUCCEEDING
from .sequences import by


def millis(at: Column | str) -> Column:
    """Milliseconds of a time, with or without a zone."""
    return F.unix_millis((F.col(at) if isinstance(at, str) else at).cast("timestamp"))


def counts(rows: DataFrame, session: str, order: list[str], outcome: Column) -> DataFrame:
    """Adds attempted, succeeded and failed up to each row."""
    w = by(session, *order).rowsBetween(Window.unboundedPreceding, 0)
    good = F.coalesce(outcome.isin(SUCCEEDING), F.lit(False)).cast("int")
    return rows.withColumn("attempted", F.count(F.lit(1)).over(w)).withColumn("succeeded", F.sum(good).over(w)).withColumn("failed", F.col("attempted") - F.col("succeeded"))


def blockers(rows: DataFrame, session: str, order: list[str], outcome: Column, details: Column, most: int = 3) -> DataFrame:
    """Adds blockers: what went wrong since the last success, the last `most` details, oldest first."""
    good = F.coalesce(outcome.isin(SUCCEEDING), F.lit(False))
    marked = rows.withColumn("__run", F.sum(good.cast("int")).over(by(session, *order).rowsBetween(Window.unboundedPreceding, 0))).withColumn("__d", F.when(~good, F.nullif(details, F.lit(""))))
    w = Window.partitionBy(session, "__run").orderBy(*order)
    # rows without details take no place among the last ones
    marked = marked.withColumn("__n", F.count("__d").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.collect_list(F.when(F.col("__d").isNotNull(), F.struct("__n", "__d"))).over(Window.partitionBy(session, "__run").orderBy("__n").rangeBetween(1 - most, 0))
    return marked.withColumn("blockers", F.transform(F.array_sort(last), lambda s: s["__d"])).drop("__run", "__d", "__n")


def confirmations(rows: DataFrame, session: str, order: list[str], line: Column, most: int = 5) -> DataFrame:
    """Adds confirmations: the last `most` lines up to each row, oldest first; rows of null line add none."""
    marked = rows.withColumn("__l", line).withColumn("__n", F.count("__l").over(by(session, *order).rowsBetween(Window.unboundedPreceding, 0)))
    last = F.collect_list(F.when(F.col("__l").isNotNull(), F.struct("__n", "__l"))).over(Window.partitionBy(session).orderBy("__n").rangeBetween(1 - most, 0))
    return marked.withColumn("confirmations", F.transform(F.array_sort(last), lambda s: s["__l"])).drop("__l", "__n")


def step_latency(rows: DataFrame, session: str, order: list[str], ts: str) -> DataFrame:
    """Adds latency_ms since the row before, null for the first."""
    return rows.withColumn("latency_ms", millis(ts) - millis(F.lag(ts).over(by(session, *order))))


def waits(rows: DataFrame, session: str, order: list[str], waiting: Column, most: int = 3) -> DataFrame:
    """Adds waits (rows in a row that wait, up to this one) and gives_up, from the one after `most` on."""
    bad = F.coalesce(waiting, F.lit(False)).cast("int")
    marked = rows.withColumn("__w", bad).withColumn("__run", F.sum(1 - F.col("__w")).over(by(session, *order).rowsBetween(Window.unboundedPreceding, 0)))
    out = marked.withColumn("waits", F.sum("__w").over(Window.partitionBy(session, "__run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumn("gives_up", F.col("waits") > most).drop("__w", "__run")


def retries(rows: DataFrame, session: str, order: list[str], failed: Column, most: int = 2) -> DataFrame:
    """Adds retries (failed verifications so far) and accepted: whether this one is let pass, failed or not, as no retry is left."""
    n = F.sum(F.coalesce(failed, F.lit(False)).cast("int")).over(by(session, *order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("retries", n).withColumn("accepted", ~F.coalesce(failed, F.lit(False)) | (F.col("retries") > most))


def throttled(rows: DataFrame, session: str, ts: str, order: list[str], gap_ms: int = 600) -> DataFrame:
    """The rows of a session that come more than gap_ms after the last one kept.

    Which row is kept depends on the one kept before, so the times of a session are folded; they
    are cut where a pause of more than gap_ms makes the next row certain, and a fold sees one
    such burst.
    """
    w = by(session, ts, *order)
    far = F.coalesce(millis(ts) - millis(F.lag(ts).over(w)) > gap_ms, F.lit(True))
    burst = rows.withColumn("__b", F.sum(far.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    times = F.array_sort(F.collect_set(millis(ts)))
    none = F.array().cast("array<bigint>")
    kept = F.aggregate(times, none, lambda a, t: F.when((F.size(a) == 0) | (t - F.element_at(a, -1) > gap_ms), F.concat(a, F.array(t))).otherwise(a))
    chosen = burst.groupBy(session, "__b").agg(kept.alias("t")).select(session, "__b", F.explode("t").alias("__t"))
    first = burst.withColumn("__t", millis(ts)).withColumn("__k", F.row_number().over(Window.partitionBy(session, "__b", "__t").orderBy(*order))).filter("__k = 1")
    return first.join(chosen, [session, "__b", "__t"]).drop("__b", "__t", "__k")


def scroll_direction(rows: DataFrame, session: str, order: list[str], y: str) -> DataFrame:
    """Adds direction: up where y is less than in the row before, else down."""
    return rows.withColumn("direction", F.when(F.col(y) < F.lag(y).over(by(session, *order)), "up").otherwise("down"))


def debounced(rows: DataFrame, session: str, ts: str, order: list[str], quiet_ms: int = 400) -> DataFrame:
    """The last row of each burst: rows that no other of the session follows within quiet_ms. Adds fires_at."""
    following = F.lead(ts).over(by(session, ts, *order))
    quiet = following.isNull() | (millis(following) - millis(ts) >= quiet_ms)
    return rows.withColumn("__q", quiet).filter("__q").drop("__q").withColumn("fires_at", F.timestamp_millis(millis(ts) + quiet_ms))


def cooled_down(rows: DataFrame, session: str, ts: str, order: list[str], failed: Column, cooldown_ms: int = 60_000) -> DataFrame:
    """Adds open: whether a row comes within cooldown_ms after an earlier failure of the session, and so would not be tried.

    A failure within a cooldown is one that the breaker does not see: a row that is not tried
    cannot fail. Failures that start a cooldown are found as in a throttle.
    """
    bad = rows.filter(F.coalesce(failed, F.lit(False)))
    starts = throttled_at(bad, session, ts, order, cooldown_ms).select(session, millis(ts).alias("__t"))
    marks = rows.withColumn("__t", millis(ts)).unionByName(starts.withColumn("__start", F.col("__t")), allowMissingColumns=True)
    last = F.max("__start").over(Window.partitionBy(session).orderBy("__t").rangeBetween(Window.unboundedPreceding, -1))
    out = marks.withColumn("__last", last).filter(F.col("__start").isNull())
    return out.withColumn("open", F.coalesce(F.col("__t") - F.col("__last") < cooldown_ms, F.lit(False))).drop("__t", "__start", "__last")


def throttled_at(rows: DataFrame, session: str, ts: str, order: list[str], gap_ms: int) -> DataFrame:
    """As throttled, with a row exactly gap_ms after the last one kept being kept too."""
    return throttled(rows, session, ts, order, gap_ms - 1)


def reconciled(rows: DataFrame, key: list[str], client: str, server: str) -> DataFrame:
    """The client's value of each key where it has one, else the server's."""
    return rows.select(*key, F.coalesce(client, server).alias("value"))
