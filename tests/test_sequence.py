"""Windows over frames, against plain loops and hand-made cases."""

import random

import pytest
from pyspark.sql import functions as F

from reelmark.operators import sequence as seq

K = ["ep"]


def frame(spark, values, ep="a", name="v", kind="double"):
    return spark.createDataFrame([(ep, i, v) for i, v in enumerate(values)], f"ep string, idx int, {name} {kind}")


def by_idx(df, col):
    return [r[col] for r in df.orderBy("idx").collect()]


def test_quarters(spark):
    for n, q in ((1, 1), (3, 1), (4, 1), (7, 1), (8, 2)):
        out = seq.quarters(frame(spark, [0.0] * n), K, "idx")
        assert sum(by_idx(out, "in_first")) == q == sum(by_idx(out, "in_last"))


def test_stride_and_cap(spark):
    f = frame(spark, [0.0] * 10)
    assert by_idx(seq.stride_sample(f, "idx", 3), "idx") == [0, 3, 6, 9]
    assert seq.stride_sample(f, "idx", 0).count() == 10
    assert seq.frame_cap(f, K, "idx", 4).count() == 4 and seq.frame_cap(f, K, "idx", 0).count() == 10


def test_even_pick(spark):
    assert by_idx(seq.even_pick(frame(spark, [0.0] * 10), K, "idx", 3), "idx") == [0, 3, 6]
    assert seq.even_pick(frame(spark, [0.0] * 2), K, "idx", 3).count() == 2


def test_prefer(spark):
    f = frame(spark, [0.0, 1.0, 0.0]).union(frame(spark, [0.0, 0.0], "b"))
    assert seq.prefer(f, K, F.col("v") > 0).groupBy("ep").count().orderBy("ep").collect() == [("a", 1), ("b", 2)]


def test_carried_with_look_ahead(spark):
    f = frame(spark, [None, None, 2.0, None, 5.0, None])
    out = f.select("idx", seq.carried("v", K, "idx").alias("c"), seq.carried_or_last("v", K, "idx").alias("l"))
    assert by_idx(out, "c") == [None, None, 2.0, 2.0, 5.0, 5.0]
    assert by_idx(out, "l") == [5.0, 5.0, 2.0, 2.0, 5.0, 5.0]


def test_settled(spark):
    f = frame(spark, [0.0, 0.0, 0.0, 0.25, 0.0, 0.0, 0.2])
    assert by_idx(f.select("idx", seq.moved_less("v", K, "idx", 3, 0.25).alias("s")), "s") == [False, False, False, False, True, True, True]


def test_gradient(spark):
    assert by_idx(frame(spark, [1.0, 2.0, 4.0, 8.0]).select("idx", seq.gradient("v", K, "idx").alias("g")), "g") == [1.0, 1.5, 3.0, 4.0]
    assert by_idx(frame(spark, [1.0]).select("idx", seq.gradient("v", K, "idx").alias("g")), "g") == [None]


def naive_runs(flags):
    out, start = [], None
    for i, f in enumerate([*flags, False]):
        if f and start is None:
            start = i
        elif not f and start is not None:
            out.append((start, i))
            start = None
    return out


def test_islands_and_longest(spark):
    rng = random.Random(5)
    rows, want, best = [], {}, {}
    for e in range(20):
        flags = [rng.random() < 0.6 for _ in range(rng.randint(1, 30))]
        rows += [(f"e{e:02}", i, f) for i, f in enumerate(flags)]
        want[f"e{e:02}"] = naive_runs(flags)
    df = spark.createDataFrame(rows, "ep string, idx int, flag boolean")
    runs = seq.islands(df, K, "idx", "flag")
    got = {}
    for r in runs.orderBy("ep", "run_start").collect():
        got.setdefault(r["ep"], []).append((r["run_start"], r["run_end"]))
    assert got == {k: v for k, v in want.items() if v}
    best = {k: max(v, key=lambda se: se[1] - se[0]) for k, v in want.items() if v}
    assert {r["ep"]: (r["run_start"], r["run_end"]) for r in seq.longest_run(runs, K).collect()} == best


def test_interpolate_clamps(spark):
    t = spark.createDataFrame([("a", x) for x in (0, 2, 3, 5, 9)] + [("b", 1)], "ep string, at int")
    s = spark.createDataFrame([("a", 2, 1.0), ("a", 4, 3.0), ("a", 6, 0.0)], "ep string, at int, v double")
    out = {(r["ep"], r["at"]): r["v"] for r in seq.interpolate(t, s, K, "at", "v").collect()}
    assert out == {("a", 0): 1.0, ("a", 2): 1.0, ("a", 3): 2.0, ("a", 5): 1.5, ("a", 9): 0.0, ("b", 1): None}


def test_held(spark):
    t = spark.createDataFrame([("a", x) for x in (0, 2, 3, 9)], "ep string, at int")
    s = spark.createDataFrame([("a", 2, 1.0), ("a", 4, 3.0)], "ep string, at int, v double")
    assert {r["at"]: r["v"] for r in seq.held(t, s, K, "at", "v").collect()} == {0: 1.0, 2: 1.0, 3: 1.0, 9: 3.0}


def test_progress_and_prefix(spark):
    f = frame(spark, [1.0, 2.0, 3.0])
    assert by_idx(seq.progress(f, K, "idx"), "progress") == [0.0, 0.5, 1.0]
    assert by_idx(seq.progress(frame(spark, [1.0]), K, "idx"), "progress") == [0.0]
    assert by_idx(seq.prefix_trace(f, K, "idx", "v"), "trace") == [[1.0], [1.0, 2.0], [1.0, 2.0, 3.0]]


def test_offsets(spark):
    f = frame(spark, [5, 0, 7], name="n", kind="bigint")
    assert by_idx(seq.running_offset(f, K, "idx", "n"), "offset") == [0, 5, 5]


def test_windows_shuffle_once(spark):
    f = frame(spark, [0.0] * 8).repartition(3)
    out = seq.quarters(f, K, "idx").withColumn("c", seq.carried("v", K, "idx")).groupBy("ep").agg(F.max("c"))
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("n", [0])
def test_empty(spark, n):
    f = frame(spark, [])
    assert seq.islands(f.withColumn("flag", F.lit(True)), K, "idx", "flag").count() == 0
    assert seq.interpolate(f.select("ep", "idx"), f, K, "idx", "v").count() == 0
