"""Sums, steps and medians walked range by range, against plain Python."""

import math
import random
import statistics
from itertools import groupby

import pytest

from reelmark.operators import evaluation as ev
from reelmark.operators import ranges


def rows_of(n=600, seed=3):
    rng = random.Random(seed)
    # a third of the rows have one value of the order, and a key may be null
    return [(rng.choice(["a", "a", "b", None]), rng.choice([7.0, rng.uniform(0, 20), float(rng.randrange(20))]), i, rng.randrange(5)) for i in rng.sample(range(10 * n), n)]


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("own", [False, True])
def test_running_sums(spark, descending, own):
    rows = rows_of()
    df = spark.createDataFrame(rows, "g string, x double, i bigint, v int")
    got = {r["i"]: (r["s"], r["s_all"]) for r in ranges.running_sums(df, ["g"], "x", {"s": "v"}, tie="i", descending=descending, own=own).collect()}
    want, at = {}, lambda r: (str(r[0]), -r[1] if descending else r[1], r[2])
    for _, group in groupby(sorted(rows, key=at), key=lambda r: str(r[0])):
        group, so_far = list(group), 0
        for _, _, i, v in group:
            want[i] = (so_far + v * own, sum(r[3] for r in group))
            so_far += v
    assert got == want


def test_a_value_that_is_common_is_cut_by_ties(spark):
    df = spark.createDataFrame(rows_of(), "g string, x double, i bigint, v int")
    chunks = ranges._dealt(df, [], "x", "i", None).groupBy("_range", "_tie").agg({"x": "count"}).collect()
    assert len({r["_tie"] for r in chunks}) > 2 and max(r[2] for r in chunks) < 200


def test_ranges_are_ordered(spark):
    cuts = [1, 3, 3, 3, 5]
    df = spark.createDataFrame([(x,) for x in (None, 0, 1, 2, 3, 4, 5, 6)], "x int")
    assert [r[0] for r in df.select(ranges.range_of("x", cuts)).collect()] == [0, 0, 0, 2, 3, 4, 4, 6]
    assert ranges.cut_points(df.filter("x > 9"), "x") == []
    assert ranges.cut_points(df, "x", 1) == []


def test_empty_and_null_sums(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 3)], "g string, x int, v int")
    assert ranges.running_sums(df.filter("x > 9"), ["g"], "x", {"s": "v"}).collect() == []
    assert [(r["s"], r["s_all"]) for r in ranges.running_sums(df, ["g"], "x", {"s": "v"}).orderBy("x").collect()] == [(0, 3), (3, 3)]


def test_step_lengths(spark):
    rng = random.Random(5)
    rows = [(rng.choice([1, 1, None]), i, rng.choice([None, *[rng.uniform(-1, 1)] * 9]), rng.uniform(-1, 1)) for i in range(300)]
    df = spark.createDataFrame(rows, "g int, i int, x double, y double")
    got = {r["i"]: r["step"] for r in ranges.step_lengths(df, ["x", "y"], ["g"], "i").collect()}
    last = {}
    for g, i, x, y in rows:
        before = last.get(g)
        want = None if before is None or None in (x, before[0]) else math.hypot(x - before[0], y - before[1])
        assert (got[i] is None) == (want is None) and (want is None or math.isclose(got[i], want)), i
        last[g] = (x, y)


@pytest.mark.parametrize("values", [[], [2.0], [1.0, 2.0], [3.0, 3.0, 1.0], [None, 4.0, 1.0, None, 1.0, 4.0], [r[1] for r in rows_of(501)], [r[1] for r in rows_of(500)]])
def test_median(spark, values):
    got = ranges.median(spark.createDataFrame([(v,) for v in values], "x double"), "x").collect()
    known = [v for v in values if v is not None]
    assert [r[0] for r in got] == [statistics.median(known) if known else None]


def test_roc_of_many_ties(spark):
    rows = [(g, x, i, v % 2) for g, x, i, v in rows_of()]
    df = spark.createDataFrame(rows, "g string, x double, i bigint, y int")
    got = {(r["g"], r["point"]): (r["fpr"], r["tpr"]) for r in ev.roc_points(df, ["g"], "x", "y", "i").collect()}
    assert len(got) == len(rows) + 3
    for g in ("a", "b", None):
        fp = tp = 0
        group = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        pos = sum(r[3] for r in group)
        for k, (_, _, _, y) in enumerate(group, 1):
            fp, tp = fp + 1 - y, tp + y
            assert got[g, k] == pytest.approx((fp / (len(group) - pos), tp / pos))
