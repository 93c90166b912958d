"""Writers, guards, sampled scans, packed masks and chart tables on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelmark.operators import evaluation as ev
from reelmark.operators import fusion, loading
from reelmark.operators.scoring import pack_masks, unpack_masks
from reelmark.plans import audit
from reelmark.sources import sinks


def test_exactly_one():
    assert loading.exactly_one(a=None, b=0) == "b"
    for bad in ({"a": None, "b": None}, {"a": 1, "b": 2}):
        with pytest.raises(ValueError, match="exactly one of a, b"):
            loading.exactly_one(**bad)


def test_written_episodes_are_skipped(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "episode string, x int")
    sinks.write_episodes(rows, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out/data").count() == 3
    done = spark.read.parquet(f"{tmp_path}/out/complete")
    todo = spark.createDataFrame([("a",), ("b",), ("c",)], "episode string")
    assert [r[0] for r in loading.skip_completed(todo, done, "episode", complete="complete").collect()] == ["c"]


def test_sampled_frames(spark):
    frames = spark.createDataFrame([(e, i) for e in "ab" for i in range(10 if e == "a" else 1)] + [("c", 1)], "episode string, frame int")
    attrs = spark.createDataFrame([("a", 30.0)], "episode string, fps double")
    ok = loading.sampled_frames(frames.filter("episode <> 'c'"), attrs, "episode", "frame", stride=3, most=3)
    assert sorted((r["episode"], r["frame"], r["sample"], r["n_sampled"], r["fps"]) for r in ok.collect()) == [("a", 0, 0, 3, 30.0), ("a", 3, 1, 3, 30.0), ("a", 6, 2, 3, 30.0), ("b", 0, 0, 1, None)]
    with pytest.raises(Exception, match="no frames sampled in episode c"):
        loading.sampled_frames(frames, attrs, "episode", "frame", stride=3).collect()


def test_clips_of(spark):
    traces = spark.createDataFrame([("a",), ("b",)], "episode string")
    clips = spark.createDataFrame([("a", "/x/a.mp4")], "clip string, path string")
    assert sorted((r["episode"], r["path"]) for r in loading.clips_of(traces, clips).collect()) == [("a", "/x/a.mp4"), ("b", None)]


def test_masks_round_trip(spark):
    rng = np.random.default_rng(3)
    bits = {n: rng.random(shape) < 0.4 for n, shape in (("m", (5, 7)), ("z", (3, 3)))}
    bits["z"][:] = False
    rows = [(n, y, x, bool(b[y, x])) for n, b in bits.items() for y in range(b.shape[0]) for x in range(b.shape[1])]
    packed = pack_masks(spark.createDataFrame(rows, "id string, y int, x int, on boolean"), ["id"])
    got = {r["id"]: r for r in unpack_masks(packed.withColumn("text", sinks.mask_text())).withColumn("back", F.unbase64("text")).collect()}
    for n, b in bits.items():
        assert bytes(got[n]["mask"]) == np.packbits(b).tobytes() == bytes(got[n]["back"]) and (got[n]["height"], got[n]["width"]) == b.shape
        assert got[n]["area"] == b.sum()


def test_chart_tables(spark):
    s = spark.createDataFrame([("d", 3, 1), ("e", 0, 0)], "dataset string, n_success bigint, n_failure bigint")
    assert sorted(tuple(r) for r in ev.prevalence_bars(s, ["dataset"]).collect()) == sorted([("d", "failure", 1, 0.25), ("d", "success", 3, 0.75), ("e", "failure", 0, None), ("e", "success", 0, None)], key=lambda r: r[:2])
    t = spark.createDataFrame([("d", "x", [1, 2]), ("d", "y", [2, 3]), ("d", "x", None)], "dataset string, mode string, ids array<int>")
    assert [tuple(r) for r in ev.in_use(t, ["dataset"], "mode", "ids").collect()] == [("d", ["x", "y"], 3)]


def test_reports(spark):
    scores = spark.createDataFrame([("a", "m", 0.9), ("a", "n", 0.7), ("b", "m", 0.1)], "episode string, model string, score double")
    seg = spark.createDataFrame([("a", 1.0), ("b", 0.2), ("c", 0.8)], "episode string, seg_score double")
    v = fusion.verdicts(scores, seg, key="episode").withColumn("label", F.lit(None).cast("string"))
    lines = list(audit.verdict_markdown(v, scores, ["m", "n"], title="set"))
    assert lines[1] == "3 episodes, 2 with model scores (m, n), the rest by boxes alone" and lines[2] == "**2 success / 1 failure: 33% failure**"
    assert lines[3] == "On the 2 episodes with all signals: 1 success / 1 failure"
    assert lines[-3:] == ["| a | — | 1.00 | 0.90 | 0.70 | 0.90 | 3/3 | success |", "| b | — | 0.20 | 0.10 | — | 0.15 | 0/2 | failure |", "| c | — | 0.80 | — | — | 0.80 | 1/1 | success |"]
    rest = [("e", 0, 30, False, 0.0, None, 0.0, 2.9, 0.1), ("e", 40, 70, True, 1.0, None, 4.0, 6.9, 0.1), ("e", 80, 99, False, 0.0, None, 8.0, 9.8, 0.1)]
    rests = spark.createDataFrame(rest, "episode string, rest_start int, rest_end int, on boolean, seg double, vlm double, start_at double, last_at double, dt double")
    from reelmark.operators import attempts as att

    lines = list(audit.split_markdown(rests, att.attempts(rests, ["episode"]), "e"))
    assert lines[1] == "**1 attempts: 1 success / 0 failure**, 1 returns, 3 rests (1 on the target)" and lines[-1] == "| 1 | 2.90 | 4.00 | 1.10 | 1.00 | — | success |"
    rows = spark.createDataFrame([("d", "m", "a", "success", 0.9, 0.9, "success", "success", "success", 1.0)], "dataset string, model string, episode string, label string, p_done_late double, p_done_max double, pred string, pred_late string, pred_max string, seg_score double")
    lines = list(audit.report_markdown(rows, ["m"], rows.select("dataset", "episode", "seg_score")))
    assert "| d | 1 | 1 | 0 | 0.00 |" in lines and lines[-1] == "| d | a | success | success | success | 2/2 |"
