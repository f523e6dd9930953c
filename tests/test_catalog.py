"""Every catalogue query against DuckDB on the smallest tables; those without SQL must run with a stable schema."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from palimpsest.plans import agents, pictures, places, registry, rules, said, screens  # noqa: F401
from palimpsest.plans import catalog  # noqa: F401

DATA = "/root/testdata/sf0.001"


def shown(df: pd.DataFrame) -> list[tuple]:
    def cell(x):
        if x is None or (pd.api.types.is_scalar(x) and pd.isna(x)):
            return "NULL"
        return f"{x:.9g}" if isinstance(x, float) else str(x)

    df = df[sorted(df.columns)]
    return sorted(tuple(map(cell, r)) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).split('.')[0]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    got = df.toPandas()
    assert len(set(df.columns)) == len(df.columns)
    if name in registry.SQL:
        want = duck.execute(registry.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert shown(got) == shown(want)


def test_plans_stay_in_the_jvm(spark):
    for name in ("entities_by_lang", "page_entities", "compliance_score", "action_loops", "event_diff_daily"):
        plan = registry.QUERIES[name](spark, DATA)._jdf.queryExecution().toString()
        assert "Python" not in plan and "CartesianProduct" not in plan, name


def test_every_day_is_compared(spark):
    """All pairs of days take part."""
    events = spark.read.parquet(f"{DATA}/events.parquet").toPandas()
    events["day"] = events.ts.dt.strftime("%Y-%m-%d")
    days = sorted(events.day.unique())
    got = registry.QUERIES["event_diff_daily"](spark, DATA).toPandas()
    assert sorted(got.day.unique()) == days[1:]
    seen = {d: set(zip(g.user_id, g.event_type, strict=True)) for d, g in events.groupby("day")}
    assert len(got) == sum(len(seen[a] | seen[b]) for a, b in zip(days[:-1], days[1:], strict=True))
