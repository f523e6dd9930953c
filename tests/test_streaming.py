"""Streams read until their end give what the batch forms give."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import memory
from palimpsest.streaming import state, timers

T0 = datetime(2024, 1, 1)


@pytest.fixture()
def events(spark, tmp_path):
    """Two files, so that two batches meet the state."""
    rows = [(u, i, T0 + timedelta(milliseconds=250 * i), f"{'drain' if i % 7 == 6 else 'a'}{'' if i % 7 == 6 else i}", i % 5 == 0) for i in range(40) for u in (1, 2)]
    schema = "u long, i long, ts timestamp, what string, bad boolean"
    spark.createDataFrame(rows[:50], schema).coalesce(1).write.parquet(str(tmp_path / "in/0"))
    spark.createDataFrame(rows[50:], schema).coalesce(1).write.parquet(str(tmp_path / "in/1"))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    return rows, stream, tmp_path


def run(df, tmp_path, mode="append", name="out"):
    path = str(tmp_path / name)
    q = df.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", path + "-c").trigger(availableNow=True).start(path)
    assert q.awaitTermination(120), "the stream did not end"
    return df.sparkSession.read.parquet(path).collect()


def test_last_actions(spark, events):
    rows, stream, tmp = events
    got = run(state.last_actions(stream(), "u", "ts", "i", "what"), tmp)
    want = [w for u, _, _, w, _ in rows if u == 1][-20:]
    assert max((r["values"] for r in got if r["u"] == 1), key=lambda v: want == v) == want and all(len(r["values"]) <= 20 for r in got)


def test_throttle_drain_and_breaker(spark, events):
    rows, stream, tmp = events
    kept, last = [], None
    for _, i, t, _, _ in (r for r in rows if r[0] == 1):
        if last is None or t - last > timedelta(milliseconds=600):
            kept.append(i)
            last = t
    assert sorted(r["i"] for r in run(state.throttle(stream(), "u", "ts", "i"), tmp, name="t") if r["u"] == 1) == kept
    drained = [r["values"] for r in run(state.drained(stream(), "u", "ts", "i", "what", "drain"), tmp, name="d") if r["u"] == 1]
    assert len(drained) == 5 and ["a0", "a1", "a2", "a3", "a4", "a5"] in drained
    open_ = {r["i"]: r["open"] for r in run(state.breaker(stream(), "u", "ts", "i", F.col("bad"), 1000), tmp, name="b") if r["u"] == 1}
    # failures at 0, 5, 10, ...: each closes four rows, a quarter of a second apart, but the failing row itself
    assert open_ == {i: i % 5 in (1, 2, 3) for i in range(40)}


def test_totals_and_sessions(spark, events):
    rows, stream, tmp = events
    got = run(state.totals(stream(), "ts", "i", "1 second", "0 seconds"), tmp, name="w")
    assert got and all(r["n"] == 8 for r in got)
    assert isinstance(run(state.sessions(stream(), "u", "ts", "1 second", "0 seconds"), tmp, name="s"), list)


def test_upsert(spark, events):
    rows, stream, tmp = events
    path = str(tmp / "table")
    write = state.upsert("i", "ts", path, buckets=4)
    q = stream().withColumn("i", F.col("i") % 6).writeStream.foreachBatch(write).option("checkpointLocation", str(tmp / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = {r["i"]: (r["saved_at"], r["updated_at"]) for r in state.current(spark, path).collect()}
    by_key = {}
    for _, i, t, _, _ in rows:
        by_key.setdefault(i % 6, []).append(t)
    assert got == {k: (min(v), max(v)) for k, v in by_key.items()}
    # a batch that runs again changes nothing
    last = max(state.versions(spark, path).values())
    write(spark.createDataFrame(rows[50:], "u long, i long, ts timestamp, what string, bad boolean").withColumn("i", F.col("i") % 6), last)
    assert {r["i"]: (r["saved_at"], r["updated_at"]) for r in state.current(spark, path).collect()} == got


def test_debounce_with_timers(spark, tmp_path):
    """A stream read in several batches gives the bursts that the batch form gives; the watermark ends the last ones."""
    timers.use_rocksdb(spark)
    rows = [(u, i, T0 + timedelta(milliseconds=(130 if i % 6 else 900) * i + u * 7)) for i in range(60) for u in (1, 2, 3)]
    rows.sort(key=lambda r: r[2])
    schema = "u long, i long, ts timestamp"
    late = [(9, 999, T0 + timedelta(hours=3))]
    for n, part in enumerate((rows[:70], rows[70:130], rows[130:], late)):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    got = run(timers.debounced(stream, "u", "ts", "i", 400, "1 second"), tmp_path)
    want = memory.debounced(spark.createDataFrame(rows, schema), "u", "ts", ["i"], 400).select("u", "i", "fires_at").collect()
    assert sorted((r["u"], r["i"], r["fires_at"]) for r in got) == sorted((r["u"], r["i"], r["fires_at"]) for r in want) and len(want) > 10


def test_task_memory_stream(spark, tmp_path):
    timers.use_rocksdb(spark)
    outcomes = ["FAILED", "SUCCEEDED", None, "NO_EFFECT", "FAILED", "FAILED", "FAILED", "PAGE_CHANGED"]
    rows = [(u, i, T0 + timedelta(seconds=i), outcomes[(i * 3 + u) % 8], f"b{i}" if i % 5 else "", f"c{i}" if i % 3 == 0 else None) for i in range(50) for u in (1, 2)]
    schema = "u long, i long, ts timestamp, outcome string, blocker string, confirmed string"
    for n in range(3):
        spark.createDataFrame([r for r in rows if r[1] // 17 == n], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    got = run(timers.task_memory(stream, "u", "ts", "i", F.col("outcome"), F.col("blocker"), F.col("confirmed")), tmp_path)
    df = spark.createDataFrame(rows, schema)
    batch = memory.confirmations(memory.blockers(memory.counts(df, "u", ["i"], F.col("outcome")), "u", ["i"], F.col("outcome"), F.col("blocker")), "u", ["i"], F.col("confirmed"))
    names = ("u", "i", "attempted", "succeeded", "failed", "blockers", "confirmations")
    assert sorted(tuple(r[n] for n in names) for r in got) == sorted(tuple(r[n] for n in names) for r in batch.collect())
