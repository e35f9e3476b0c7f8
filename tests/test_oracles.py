"""Queries against DuckDB over the smallest tables; the driver compares all of them at a larger size."""

import datetime as dt
import math
import random
from pathlib import Path

import duckdb
import pandas as pd
import pytest

SF = "/root/testdata/sf0.001"
PICKED = [
    "w06_rolling_skew", "w08_high_volatility", "w25_island_lengths", "w32_around_transitions", "w34_sign_flips", "w_blocked_rolling", "g01_tf1", "g04_tf4", "g14_phase_router",
    "flagship_trade_metrics", "j01_attach_daily", "j13_as_of", "j14_fold_members", "a02_daily_features", "a09_walk_forward_means", "a12_grouping_sets", "a19_trimmed_mean",
    "a29_entropy", "a31_confidence_collapse", "s02_smooth_labels", "s05_walk_forward", "t01_recommendations", "u02_keep_last", "q06_ranges", "q13_archive_validation", "pf04_normalised_pair",
    "pf27_tolerant_casts", "w15_wilder_rsi", "src10_discovery", "src11_manifests", "src13_logs", "src14_benchmark", "q16_benchmark",
]

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    return c


def text(v) -> str:
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return repr(float(v)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", PICKED)
def test_query_equals_sql(spark, duck, name):
    from tidemark.plans import registry

    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = duck.sql(registry.ORACLE_SQL[name])
    at = [found.columns.index(c) for c in columns]
    assert sorted(tuple(text(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(text(r[i]) for i in at) for r in found.fetchall())


def equal_on(spark, folder, name, events) -> list[tuple]:
    """The query's rows on a table of `events` (event_id, ts, event_type, value), as they are by its SQL."""
    from tidemark.plans import registry

    pd.DataFrame(events, columns=["event_id", "ts", "event_type", "value"]).astype({"ts": "datetime64[us]"}).to_parquet(folder / "events.parquet", index=False)
    c = duckdb.connect()
    c.execute(f"create view events as select * from '{folder}/events.parquet'")
    df = registry.QUERIES[name](spark, str(folder))
    want = sorted(c.execute(f"select {', '.join(df.columns)} from ({registry.ORACLE_SQL[name]})").fetchall(), key=str)
    assert sorted((tuple(r) for r in df.collect()), key=str) == want
    return want


def test_events_of_one_pair_and_time_are_one_key(spark, tmp_path):
    at = dt.datetime(2024, 1, 1, 12)
    near = at + dt.timedelta(microseconds=1)
    events = [(1, at, "a", 1.0), (2, at, "a", 2.0), (3, near, "a", 1.0), (4, at, "b", 1.0), (5, at, "a", 1.0)]
    assert equal_on(spark, tmp_path, "st04_without_duplicates", events) == [("a", "2024-01-01 12:00:00", 1)] * 2 + [("b", "2024-01-01 12:00:00", 1)]


def test_positions_go_by_time_and_id_however_rows_lie(spark, tmp_path):
    at, rng = dt.datetime(2024, 1, 1), random.Random(7)
    events = [(k, at + dt.timedelta(minutes=k // 4), "a", rng.choice([5.0, 50.0, 95.0])) for k in range(12_000)]  # four of each time
    events += [(20_000, at, "b", 95.0), (20_001, at, "b", 50.0), (20_002, at, "b", 5.0), (20_003, None, "b", 95.0), (20_004, at, None, 50.0)]
    rng.shuffle(events)
    found = sorted((r for r in equal_on(spark, tmp_path, "st07_held_positions", events) if r[0] != "a"), key=str)
    assert found == [("b", "2024-01-01 00:00:00", 0, 3), ("b", "2024-01-01 00:00:00", 1, 1), ("b", "2024-01-01 00:00:00", 1, 2), ("b", None, 1, 4), (None, "2024-01-01 00:00:00", 0, 1)]
