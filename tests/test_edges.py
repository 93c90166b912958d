"""Points on the very edge of a box, where rounding of sums would decide, against the SQL."""

import datetime as dt
import json
import random

import pytest
from helpers import canonical

from reelmark import registry


@pytest.fixture(scope="module")
def edges(spark, tmp_path_factory):
    rng, rows, start = random.Random(4), [], dt.datetime(2024, 1, 1)
    for k in range(0, 4000, 2):
        v = round(rng.uniform(1, 400), 2)
        by = rng.choice([37.5, 90.0, -37.5 if v > 40 else 37.5, -90.0 if v > 95 else 90.0])
        rows += [(k, start + dt.timedelta(seconds=k), k // 100, "view", v, json.dumps({"k": 5})), (k + 1, start + dt.timedelta(seconds=k + 1), k // 100, "click", round(v + by, 2), json.dumps({"k": 5}))]
    root = str(tmp_path_factory.mktemp("edges"))
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").coalesce(1).write.parquet(f"{root}/events.parquet")
    return root


@pytest.mark.parametrize("name", ["motion_states", "saucer_locf", "cup_on_saucer", "nested_tracks"])
def test_points_on_edges(spark, edges, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{edges}/events.parquet/*.parquet'")
    assert canonical(registry.QUERIES[name](spark, edges).toPandas()) == canonical(con.execute(registry.ORACLE_SQL[name]).df())
