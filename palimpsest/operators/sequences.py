"""Operators over ordered actions of a session: memory, loops, islands, transitions, diffs, receipts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by(session: str, *order: str) -> WindowSpec:
    return Window.partitionBy(session).orderBy(*order)


def recent(rows: DataFrame, session: str, order: list[str], value: str, n: int = 6, name: str = "recent") -> DataFrame:
    """Adds the last n values up to each row, oldest first."""
    return rows.withColumn(name, F.collect_list(value).over(by(session, *order).rowsBetween(1 - n, 0)))


def loops(rows: DataFrame, session: str, order: list[str], action: str, signature: Column | None = None, changed: Column | None = None, goes_to: Column | None = None, at: Column | None = None) -> DataFrame:
    """Adds loop: what the last actions of a session amount to, or null. wait and done rows are left out.

    NAVIGATION: a navigate to the page it is on (goes_to, at); then, on rows without a change of
    the page, STAGNANT_SCROLL: two scrolls in a row; REPEAT: one signature three times;
    OSCILLATION: two signatures twice in turn. Where `changed` isn't given no page ever changes.
    """
    s = F.col("__sig")
    w = by(session, *order)
    rows = rows.filter(~F.coalesce(F.col(action).isin("wait", "done"), F.lit(False))).withColumn("__sig", F.coalesce(signature if signature is not None else F.col(action), F.lit("")))
    lag = lambda k: F.lag(s, k).over(w)
    still = ~F.coalesce(changed, F.lit(True)) if changed is not None else F.lit(True)
    stays = (F.col(action) == "navigate") & ((goes_to == at) | at.startswith(goes_to)) & (goes_to != "") if goes_to is not None and at is not None else F.lit(False)
    scroll = (F.col(action) == "scroll") & (F.lag(action).over(w) == "scroll")
    repeat, swing = (s == lag(1)) & (s == lag(2)), (s == lag(2)) & (lag(1) == lag(3)) & (s != lag(1))
    return rows.withColumn("loop", F.when(stays, "NAVIGATION").when(still & scroll, "STAGNANT_SCROLL").when(still & repeat, "REPEAT").when(still & swing, "OSCILLATION")).drop("__sig")


def failure_runs(rows: DataFrame, session: str, order: list[str], failed: Column, halt_at: int = 3) -> DataFrame:
    """Adds failures (failed rows in a row, up to this one) and halted."""
    w = by(session, *order)
    bad = F.coalesce(failed, F.lit(False))
    island = rows.withColumn("__bad", bad.cast("int")).withColumn("__island", F.sum(1 - F.col("__bad")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = island.withColumn("failures", F.sum("__bad").over(Window.partitionBy(session, "__island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumn("halted", F.col("failures") >= halt_at).drop("__bad", "__island")


def first_visits(rows: DataFrame, session: str, order: list[str], url: str) -> DataFrame:
    """The first row of each URL (without fragment) in a session, and the URL visited first before it."""
    page = F.substring_index(F.col(url), "#", 1)
    first = rows.withColumn("page", page).filter(F.col("page").isNotNull()).withColumn("__k", F.row_number().over(Window.partitionBy(session, "page").orderBy(*order))).filter("__k = 1").drop("__k")
    return first.withColumn("from_page", F.lag("page").over(by(session, *order)))


def transitions(rows: DataFrame, session: str, order: list[str], state: str, edges: DataFrame) -> DataFrame:
    """Adds is_valid: whether (state before, state) is among edges(src, dst); a first row is valid. edges is a small fixed table."""
    stepped = rows.withColumn("src", F.lag(state).over(by(session, *order)))
    known = edges.select(F.col("src").alias("__s"), F.col("dst").alias("__d")).distinct().withColumn("__ok", F.lit(True))
    joined = stepped.join(known, (F.col("src") == F.col("__s")) & (F.col(state) == F.col("__d")), "left")
    return joined.withColumn("is_valid", F.coalesce("__ok", F.col("src").isNull())).drop("__s", "__d", "__ok")


def consecutive_distinct(rows: DataFrame, session: str, order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the row before."""
    return rows.withColumn("__p", F.lag(value).over(by(session, *order))).filter(~F.col("__p").eqNullSafe(F.col(value)) | F.col("__p").isNull()).drop("__p")


def diff(before: DataFrame, after: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Full outer diff of snapshots: keys, status (added, removed, changed, same), changed column names."""
    a = before.select(*keys, *(F.col(v).alias(f"__a_{v}") for v in values), F.lit(True).alias("__in_a"))
    b = after.select(*keys, *(F.col(v).alias(f"__b_{v}") for v in values), F.lit(True).alias("__in_b"))
    both = a.join(b, keys, "full_outer")
    moved = F.array_compact(F.array(*(F.when(~F.col(f"__a_{v}").eqNullSafe(F.col(f"__b_{v}")), v) for v in values)))
    status = F.when(F.col("__in_a").isNull(), "added").when(F.col("__in_b").isNull(), "removed").when(F.size(moved) > 0, "changed").otherwise("same")
    return both.select(*keys, status.alias("status"), F.when(status == "changed", moved).otherwise(F.array().cast("array<string>")).alias("changes"))


def latest(rows: DataFrame, key: str, order: str, *values: str) -> DataFrame:
    """Last write of each key, with the time of its first and last."""
    return rows.groupBy(key).agg(F.min(order).alias("saved_at"), F.max(order).alias("updated_at"), *(F.max_by(v, order).alias(v) for v in values))


def value_bucket(value: Column) -> Column:
    """A whole number that never falls as the value rises, about a hundredth of its size wide."""
    return F.floor(F.signum(value) * F.log1p(F.abs(value)) * 64).cast("long")


def latency(rows: DataFrame, key: str, value: str) -> DataFrame:
    """n, least, median, p95, most and mean of a value by key; quantiles are the value at floor(p * (n - 1)) in order. Nulls don't count.

    Equal values are counted first and counts dealt to buckets in order; the buckets' sizes say
    which one holds a quantile, and only the values of these are put in order, so no key's values
    meet in one place.
    """
    x = F.col(value).cast("double")
    n = rows.filter(x.isNotNull()).select(key, x.alias("x")).groupBy(key, "x").agg(F.count(F.lit(1)).alias("c")).withColumn("bucket", value_bucket(F.col("x")))
    sizes = n.groupBy(key, "bucket").agg(F.sum("c").alias("size"), F.min("x").alias("least"), F.max("x").alias("most"), F.sum(F.col("x") * F.col("c")).alias("total"))
    before = F.sum("size").over(Window.partitionBy(key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    placed = sizes.withColumn("before", F.coalesce(before, F.lit(0)))
    whole = sizes.groupBy(key).agg(F.sum("size").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"), F.sum("total").alias("total"))
    asked = whole.select(key, F.explode(F.array(*(F.struct(F.lit(q).alias("q"), F.floor(p * (F.col("n") - 1)).cast("long").alias("at")) for q, p in (("median", 0.5), ("p95", 0.95))))).alias("a")).select(key, "a.q", "a.at")
    target = asked.join(placed, key).filter("at >= before and at < before + size").select(key, "bucket", "q", (F.col("at") - F.col("before")).alias("inside"))
    w = Window.partitionBy(key, "bucket", "q").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hit = n.join(target, [key, "bucket"]).withColumn("upto", F.sum("c").over(w)).filter("inside < upto and inside >= upto - c")
    found = hit.groupBy(key).agg(F.max(F.when(F.col("q") == "median", F.col("x"))).alias("median"), F.max(F.when(F.col("q") == "p95", F.col("x"))).alias("p95"))
    return whole.join(found, key).select(key, "n", "least", "median", "p95", "most", (F.col("total") / F.col("n")).alias("mean"))


def scores(rows: DataFrame, expected: Column, found: Column, *keys: str) -> DataFrame:
    """Confusion counts, precision, recall and F1 by keys. Nothing expected or found counts as 1."""
    e, f = F.coalesce(expected, F.lit(False)), F.coalesce(found, F.lit(False))
    n = rows.groupBy(*keys).agg(F.count_if(e & f).alias("tp"), F.count_if(~e & f).alias("fp"), F.count_if(e & ~f).alias("fn"), F.count_if(~e & ~f).alias("tn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(1.0)
    n = n.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return n.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
