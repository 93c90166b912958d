"""Hand-made cases of features, fusion and evaluation."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelmark.functions import any_word, first_filled, label_of, mean_present, split_prompts, tag_above, tag_from, to_camera
from reelmark.operators import attempts as att
from reelmark.operators import confidence as conf
from reelmark.operators import detections as det
from reelmark.operators import evaluation as ev
from reelmark.operators import fusion, gripper, loading, presets, scoring
from reelmark.plans import audit
from reelmark.sources import sinks, traces
from reelmark.streaming import traces as streaming


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_curve_lengths(spark):
    curves = [[], [0.4], [0.1, 0.2, 0.6], [0.0, 0.0, 0.0, 1.0], [0.0] * 6 + [1.0], [0.0] * 6 + [0.5, 1.0], None]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(curves)], "i int, p_yes array<double>")
    got = [r["p_done_late"] for r in conf.add_curve_statistics(df).orderBy("i").collect()]
    assert got == [None, 0.4, 0.6, 1.0, 1.0, 0.75, None]


def test_auroc_ties_and_single_class(spark):
    df = spark.createDataFrame([("t", 0.5, 1), ("t", 0.5, 0), ("one", 0.3, 1), ("o", 0.9, 1), ("o", 0.1, 0), ("o", 0.9, 0)], "g string, s double, y int")
    assert {r["g"]: r["auroc"] for r in ev.auroc(df, ["g"], "s", "y").collect()} == {"t": 0.5, "one": None, "o": 0.75}


def test_auroc_against_pairs(spark):
    rng = np.random.default_rng(3)
    s, y = rng.integers(0, 12, 200), rng.integers(0, 2, 200)
    want = np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y, strict=True)], "s double, y int")
    assert math.isclose(ev.auroc(df, [], "s", "y").first()["auroc"], want)


def test_thresholds(spark):
    r = one(spark, tag_above(F.lit(0.5)).alias("a"), tag_from(F.lit(0.5)).alias("b"), tag_from(F.lit(None).cast("double")).alias("c"))
    assert (r["a"], r["b"], r["c"]) == ("failure", "success", None)


def test_labels(spark):
    df = spark.createDataFrame([(None, "x_success"), (None, "x_failure"), (None, "x"), (None, None), ("failure", "x_success"), ("maybe", "x_success")], "l string, n string")
    assert [r[0] for r in df.select(label_of("l", "n")).collect()] == ["success", "failure", None, None, "failure", "success"]


def test_strings(spark):
    r = one(spark, first_filled(F.lit(""), F.lit(None).cast("string"), F.lit("x")).alias("a"), split_prompts(F.lit(" cup, ,saucer,")).alias("b"), any_word(F.lit("Red CUP"), ["cup"]).alias("c"), any_word(F.lit(None).cast("string"), ["cup"]).alias("d"))
    assert (r["a"], r["b"], r["c"], r["d"]) == ("x", ["cup", "saucer"], True, False)


def test_mean_present(spark):
    n = F.lit(None).cast("double")
    r = one(spark, mean_present(n, F.lit(0.5)).alias("a"), mean_present(n, n).alias("b"), mean_present(F.lit(1.0), F.lit(0.0)).alias("c"))
    assert (r["a"], r["b"], r["c"]) == (0.5, None, 0.5)


def test_camera(spark):
    m = [[0.0, -1.0, 0.0, 0.3], [1.0, 0.0, 0.0, -0.2], [0.0, 0.0, 1.0, 1.0], [0.0, 0.0, 0.0, 1.0]]
    df = spark.createDataFrame([([0.1, 0.2, 0.3], m), ([0.1, 0.2, 0.3], None)], "p array<double>, t array<array<double>>")
    a, b = (r[0] for r in df.select(to_camera("p", "t")).collect())
    assert np.allclose(a, (np.linalg.inv(np.array(m)) @ [0.1, 0.2, 0.3, 1])[:3]) and b is None


def test_logits_and_logprobs(spark):
    x = [2.0, 1.0, 0.5, -1.0, 3.0]
    e = np.exp(x)
    assert math.isclose(one(spark, conf.yes_from_logits(F.array(*map(F.lit, x)), [0, 1], [2]).alias("p"))["p"], (e[0] + e[1]) / (e[0] + e[1] + e[2]))
    assert one(spark, conf.yes_from_logits(F.array(F.lit(0.0), F.lit(-800.0)), [1], [7]).alias("p"))["p"] == 0.5
    t = spark.createDataFrame([("a", " Yes", -1.0), ("a", "YES", -2.0), ("a", "no ", -1.0), ("b", "maybe", -0.1)], "e string, token string, logprob double")
    got = {r["e"]: (r["p_yes"], r["unresolved"]) for r in conf.yes_from_logprobs(t, ["e"]).collect()}
    yes = math.exp(-1) + math.exp(-2)
    assert math.isclose(got["a"][0], yes / (yes + math.exp(-1))) and got["b"] == (0.5, True)


# --- boxes -----------------------------------------------------------------------------------------------------------
def obj(i, score, centre, box=(0.0, 0.0, 10.0, 10.0)):
    return {"object_id": i, "score": score, "box_xyxy": list(box), "area": 1, "centroid_xy": centre}


def seg_trace(frames, **more):
    return {"episode": "x", "fps": 2.0, "stride": 1, "total_frames": len(frames), "source_indices": list(range(100)), "frames": frames} | more


def frame(objects, cups=(), saucers=()):
    return {"objects": objects, "prompt_to_obj_ids": {"a cup": list(cups), "Saucer": list(saucers)}}


@pytest.fixture
def folder(tmp_path):
    def write(name, docs, raw=None):
        d = tmp_path / name
        d.mkdir(parents=True)
        for k, v in docs.items():
            (d / f"{k}.json").write_text(json.dumps(v))
        for k, v in (raw or {}).items():
            (d / f"{k}.json").write_text(v)
        return str(d)

    return write


def seg_of(spark, folder, **docs):
    return det.seg_features(traces.read_traces(spark, folder("seg", docs), "seg")).collect()


def test_box_look_ahead_and_missing_cup(spark, folder):
    # four frames: the last quarter is frame 10, keys sort as numbers, the saucer is seen only in frame 9.
    f = {"2": frame([obj(1, 0.9, [5.0, 5.0])], [1]), "10": frame([obj(1, 0.9, [12.5, 5.0])], [1]), "9": frame([obj(2, 0.5, None)], (), [2]), "3": frame([])}
    edge = {"0": frame([obj(1, 0.9, [12.5, 5.0])], [1]), "1": frame([obj(2, 0.5, None)], (), [2])}
    got = {r["episode"]: r for r in seg_of(spark, folder, a=seg_trace(f), b=seg_trace(edge), c=seg_trace({}))}
    assert set(got) == {"a", "b"}
    assert got["a"]["seg_score"] == 1.0 and got["a"]["seg_mode"] == "cup_on_saucer" and got["a"]["cup_track_ids"] == 1
    assert got["b"]["seg_score"] == 0.0 and got["b"]["cup_present_end"] == 0.0


def test_best_cup(spark, folder):
    f = {"0": frame([obj(1, 0.9, None), obj(2, 0.5, [3.0, 4.0]), obj(3, 0.5, [9.0, 9.0])], [1, 2, 3])}
    t = traces.read_traces(spark, folder("seg", {"a": seg_trace(f)}), "seg")
    r = det.frame_tracks(det.explode_frames(t)).first()
    assert (r["cup_x"], r["cup_y"], r["cup_ids"]) == (3.0, 4.0, [1, 2, 3])


def test_fallback(spark, folder):
    f = {"0": frame([obj(1, 0.9, [0.0, 0.0])], [1]), "1": frame([]), "2": frame([]), "3": frame([]), "4": frame([]), "5": frame([]), "6": frame([]), "7": frame([obj(1, 0.9, [51.2, 0.0])], [1])}
    r = seg_of(spark, folder, a=seg_trace(f))[0]
    assert (r["cup_present_end"], r["cup_settled"], r["seg_mode"]) == (0.5, 1.0, "cup_settled(fallback)") and math.isclose(r["seg_score"], 0.5)


def test_traces_strict_and_lenient(spark, folder, tmp_path):
    d = folder("vlm", {"a": {"p_yes": [0.1, 0.9], "task_name": "t_success"}}, {"bad": "{not json"})
    assert [(r["episode"], r["label"]) for r in traces.read_traces(spark, d, "vlm").collect()] == [("a", "success")]
    with pytest.raises(Exception):
        traces.read_traces(spark, d, "vlm", strict=True).collect()
    assert traces.read_traces(spark, str(tmp_path / "none"), "vlm").count() == 0


def test_store_and_models(spark, folder, tmp_path):
    for e, n in (("e1", 10), ("e2", 20)):
        (tmp_path / "eps" / "sub" / e).mkdir(parents=True)
        (tmp_path / "eps" / "sub" / e / "zarr.json").write_text(json.dumps({"attributes": {"total_frames": n, "task_name": "x"}}))
    got = traces.read_episode_store(spark, str(tmp_path / "eps")).orderBy("episode").collect()
    assert [(r["episode"], r["total_frames"], r["fps"]) for r in got] == [("e1", 10, 30.0), ("e2", 20, 30.0)]
    folder("m/qwen", {"a": {"p_yes": [0.5]}})
    (tmp_path / "m" / "empty").mkdir()
    assert [(r["model_dir"], r["episode"]) for r in traces.read_model_traces(spark, str(tmp_path / "m")).collect()] == [("qwen", "a")]


def test_a_label_comes_along_with_box_features(spark, folder):
    """Features are those without it; a trace without frames, empty or missing, has its label and no feature."""
    on = frame([obj(1, 0.9, [5.0, 5.0]), obj(2, 0.9, None)], [1], [2])
    s = {"a": seg_trace({"0": on, "1": on}, label="success"), "b": seg_trace({"0": on}), "none": seg_trace({}, label="failure"), "gone": {"label": "success"}}
    seg = traces.read_traces(spark, folder("seg", s), "seg")
    plain = det.seg_features(seg)
    got = {r["episode"]: r.asDict() for r in det.seg_features(seg, carry="label").collect()}
    assert {e: r["label"] for e, r in got.items()} == {r["episode"]: r["label"] for r in seg.collect()} and len(got) == 4
    assert {e: {c: got[e][c] for c in plain.columns} for e in ("a", "b")} == {r["episode"]: r.asDict() for r in plain.collect()}
    assert all(got[e][c] is None for e in ("none", "gone") for c in plain.columns if c != "episode")


def test_fused_audit_end_to_end(spark, folder):
    v = {e: {"p_yes": [p] * 4, "label": lab} for e, p, lab in (("a", 0.9, "success"), ("b", 0.2, "failure"), ("c", 0.6, "failure"))}
    on, off = frame([obj(1, 0.9, [5.0, 5.0]), obj(2, 0.9, None)], [1], [2]), frame([obj(1, 0.9, [90.0, 5.0]), obj(2, 0.9, None)], [1], [2])
    s = {"a": seg_trace({"0": on}), "b": seg_trace({"0": off}), "d": seg_trace({"0": on}, label="success")}
    g = {"a": {"features": {"bimanual": {"any_hold": True}}}, "c": {"features": {"bimanual": {"any_hold": False}}}, "b": {"features": {}}}
    vlm, seg, geo = (traces.read_traces(spark, folder(n, d), n) for n, d in (("vlm", v), ("seg", s), ("geo", g)))
    rows = audit.fused_audit(vlm, seg, geo)
    got = {r["episode"]: r for r in rows.collect()}
    assert got["a"]["threshold"] == pytest.approx(0.6)
    assert got["a"]["fused_score"] == pytest.approx((0.5 + 0.5 * 0.9 / 1.2 + 1.0) / 2)
    assert got["b"]["fused_score"] == pytest.approx((0.5 * 0.2 / 1.2) / 2) and got["b"]["geo_any_hold"] is None
    assert got["c"]["fused_score"] == 0.0 and got["c"]["pred_fused"] == "failure" and got["c"]["pred_vlm"] == "failure"
    assert got["d"]["fused_score"] == 1.0 and got["d"]["pred_vlm"] is None and got["d"]["label"] == "success"
    scores = {r["criterion"]: r for r in audit.audit_scores(rows).collect()}
    assert scores["fused"]["n"] == 4 and scores["fused"]["accuracy"] == 1.0 and scores["fused"]["auroc"] == 1.0
    assert tuple(audit.audit_prevalence(rows).first()) == (4, 2, 2, 0.5)
    assert tuple(audit.vetoes(rows).first()) == (1, ["c"])
    assert any("50% failure" in x for x in audit.audit_markdown(rows))


def test_calibration_of_zero(spark):
    df = spark.createDataFrame([(0.0, None, None)], "late double, seg double, hold boolean")
    r = fusion.calibrated_fusion(df, late="late", seg="seg", any_hold="hold", threshold=0.0).first()
    assert r["fused_score"] == 0.0 and r["pred_vlm"] == "failure"
    assert fusion.calibration(df.filter("late > 1"), "late").first()[0] == 0.5


def test_verdicts(spark):
    m = spark.createDataFrame([("a", "m1", 0.9), ("a", "m2", 0.5), ("v", "m1", 0.5)], "ep string, model string, score double")
    s = spark.createDataFrame([("a", 0.1), ("s", 0.7), ("n", None)], "ep string, seg_score double")
    got = {r["ep"]: (r["final"], r["tag"], r["votes"]) for r in fusion.verdicts(m, s, key="ep").collect()}
    assert got == {"a": (pytest.approx(0.4), "failure", "2/3"), "v": (0.5, "success", "1/1"), "s": (0.7, "success", "1/1"), "n": (None, None, None)}


def test_consensus(spark):
    df = spark.createDataFrame([("a", "success"), ("a", "success"), ("a", "failure"), ("a", "failure"), ("b", "failure")], "ep string, tag string")
    assert {r["ep"]: (r["consensus"], r["votes"]) for r in fusion.consensus_of(df, ["ep"], "tag").collect()} == {"a": ("split", "2/4"), "b": ("failure", "0/1")}


def test_report(spark, folder):
    vlm = traces.read_traces(spark, folder("vlm", {"a": {"p_yes": [1.0, 0.2], "label": "success", "last_frame_top_tokens": [["Yes", "0.9"]]}, "b": {"p_yes": [0.1, 0.5], "label": "failure"}}), "vlm").withColumn("model_dir", F.lit("qwen"))
    seg = traces.read_traces(spark, folder("seg", {"a": seg_trace({"0": frame([obj(1, 0.9, [5.0, 5.0]), obj(2, 0.9, None)], [1], [2])})}), "seg")
    rows = audit.report_rows({"aria": (vlm, seg, "max"), "eva": (vlm, seg, "late")})
    got = {(r["dataset"], r["episode"]): (r["pred"], r["pred_late"], r["pred_max"]) for r in rows.collect()}
    assert got == {("aria", "a"): ("success", "failure", "success"), ("aria", "b"): ("failure", "failure", "failure"), ("eva", "a"): ("failure", "failure", "success"), ("eva", "b"): ("failure", "failure", "failure")}
    assert {r["dataset"]: (r["accuracy"], r["auroc"]) for r in audit.report_summary(rows).collect()} == {"aria": (1.0, 0.0), "eva": (0.5, 0.0)}
    assert {(r["dataset"], r["episode"]): (r["SEG"], r["consensus"]) for r in audit.report_consensus(rows, ["qwen"]).collect()}[("eva", "a")] == ("success", "split")
    assert audit.first_top_tokens(rows).count() == 2 and audit.trace_chart(rows).count() == 8
    assert audit.final_verdicts(seg, vlm).count() == 2


# --- gripper ---------------------------------------------------------------------------------------------------------
def arm(values, cmd=None, fps=30.0):
    return [("a", i, v, c, fps) for i, (v, c) in enumerate(zip(values, cmd or [0.1] * len(values), strict=True))]


def holds(spark, values, cmd=None):
    df = spark.createDataFrame(arm(values, cmd), "ep string, idx int, obs double, cmd double, fps double")
    m = gripper.mark_holds(df, ["ep"], "idx")
    return m.groupBy("ep").agg(*gripper.hold_features(m, ["ep"])).first()


def test_hold_length(spark):
    # three frames settle, so a plateau of 3 + 8 frames is too short and one of 3 + 9 is a hold
    assert holds(spark, [0.9] + [0.05] * 11 + [0.9])["n_holds"] == 0
    assert holds(spark, [0.9] + [0.05] * 12 + [0.9])["n_holds"] == 1


def test_hold_endings(spark):
    hold = [0.05] * 15
    open_ = [0.1] * 15 + [0.9] * 5
    assert holds(spark, hold + [0.9] * 5, open_)["n_releases"] == 1
    r = holds(spark, hold + [0.006] * 5)
    assert (r["n_slips"], r["first_slip_frame"]) == (1, 15)
    assert holds(spark, hold + [0.008] * 5)["n_ambiguous_ends"] == 1
    r = holds(spark, hold)
    assert r["n_holds"] == 1 and r["n_releases"] + r["n_slips"] + r["n_ambiguous_ends"] == 0


def test_missing_commands(spark):
    r = holds(spark, [0.05] * 15 + [0.9] * 5, [None] * 20)
    assert not r["cmd_gripper_available"] and r["n_holds"] == 1 and r["n_releases"] == 0 and r["n_ambiguous_ends"] == 1
    # a missing command after a hold is no release
    assert holds(spark, [0.05] * 15 + [0.9] * 5, [0.1] * 15 + [None] * 5)["n_releases"] == 0


def proprio(episode, side, obs, xyz, cmd=0.1):
    return [(episode, side, i, o, cmd, list(p), list(p)) for i, (o, p) in enumerate(zip(obs, xyz, strict=True))]


SCHEMA = "episode string, arm string, frame_idx int, obs_gripper double, cmd_gripper double, obs_xyz array<double>, cmd_xyz array<double>"


def test_geometric(spark):
    n = 60
    eye = np.eye(4).tolist()
    left = [0.05] * n
    right = [0.9] * 5 + [0.05] * 20 + [0.9] * 5 + [0.05] * 20 + [0.9] * 10
    xyz = [(0.01 * i, 0.0, 0.0) for i in range(n)]
    rows = proprio("e", "left", left + [0.05] * 4, xyz + [(9.0, 9.0, 9.0)] * 4) + proprio("e", "right", right, [(x, 0.1, 0.0) for x, _, _ in xyz])
    rows += proprio("f", "left", left, xyz) + proprio("f", "right", [float("nan")] + right[1:], xyz)
    eps = spark.createDataFrame([("e", n, 30.0, {"left": eye, "right": eye}, "t_success"), ("f", n, 0.0, {"left": eye}, "t_failure")], "episode string, total_frames int, fps double, extrinsics map<string,array<array<double>>>, task_name string")
    got = {r["episode"]: r for r in audit.geometric_features(spark.createDataFrame(rows, SCHEMA), eps).collect()}
    e, f = got["e"], got["f"]
    assert e["label"] == "success" and e["nan_fields"] == [] and f["nan_fields"] == ["right.obs_gripper"]
    # both plateaus of the right hand have 17 settled frames: the first one counts as the longest
    b = e["bimanual"]
    assert (b["n_handover_candidates"], b["handover_frame"], b["any_hold"]) == (2, (8 + 25) // 2, True)
    assert math.isclose(b["longest_handover_s"], 17 / 30) and math.isclose(b["hand_distance_at_handover_m"], 0.1) and b["last_hold_end_frame"] == 60
    assert e["left"]["n_holds"] == 1 and math.isclose(e["left"]["ee_path_length_m"], 0.59) and math.isclose(e["left"]["ee_speed_mean"], 0.3)
    assert f["bimanual"]["min_hand_distance_m"] is None and not f["bimanual"]["handover_detected"] and f["bimanual"]["any_hold"]


def test_separation(spark):
    rows = [("success", 1.0, 1.0, 5.0), ("success", 2.0, None, 5.0), ("failure", 3.0, 1.0, 5.0), ("failure", 5.0, 2.0, 5.0)]
    df = spark.createDataFrame(rows, "label string, a double, b double, c double")
    got = ev.separation(df, "label", ["a", "b", "c"]).collect()
    assert [r["feature"] for r in got] == ["a"] and math.isclose(got[0]["gap"], (1.5 - 4.0) / np.std([1, 2, 3, 5]))
    assert ev.separation(df.limit(3), "label", ["a"]).count() == 0


def test_agreement_and_gap(spark):
    df = spark.createDataFrame([("e1", "a", "success"), ("e1", "b", "failure"), ("e2", "a", "success"), ("e2", "b", "success"), ("e3", "c", "failure")], "ep string, model string, tag string")
    got = {(r["model_a"], r["model_b"]): (r["n_common"], r["agreement"]) for r in ev.agreement(df, "ep", "model", "tag", ["a", "b", "c"]).collect()}
    assert got[("a", "b")] == (2, 0.5) and got[("a", "a")] == (2, 1.0) and got[("a", "c")] == (0, None)


# --- attempts --------------------------------------------------------------------------------------------------------
def test_attempts(spark):
    # rests: off, on, off, off, with a moving frame between
    plan = [(True, 0.0)] * 3 + [(False, None)] + [(True, 1.0)] * 3 + [(False, None)] + [(True, 0.0)] * 3 + [(False, None)] + [(True, 0.0)] * 3
    df = spark.createDataFrame([("a", i, s, x, 1.0) for i, (s, x) in enumerate(plan)], "ep string, idx int, still boolean, inside double, dt double")
    rest = att.rests(df, ["ep"], "idx", least_s=2.0)
    moves = att.transitions(rest, ["ep"]).orderBy("rest_start").collect()
    assert [r["kind"] for r in moves] == ["attempt", "return", "attempt"]
    got = att.attempts(rest, ["ep"]).orderBy("attempt").collect()
    assert [(r["attempt"], r["tag"], r["start_at"], r["settle_at"], r["carry_s"]) for r in got] == [(1, "success", 2, 4, 2.0), (2, "failure", 10, 12, 2.0)]


def test_half_even_durations(spark):
    assert one(spark, att.rounded_frames(2.5, F.lit(1.0)).alias("a"), gripper.frames_for(0.3, F.lit(30.0)).alias("b"))[:] == (2, 9)


def test_split_plan(spark, folder):
    on, off = frame([obj(1, 0.9, [5.0, 5.0]), obj(2, 0.9, None)], [1], [2]), frame([obj(1, 0.9, [900.0, 5.0]), obj(2, 0.9, None)], [1], [2])
    f = {str(i): (off if i < 4 else on) for i in range(9)}
    seg = traces.read_traces(spark, folder("seg", {"a": seg_trace(f)}), "seg")
    vlm = traces.read_traces(spark, folder("vlm", {"a": {"source_indices": [0, 8], "p_yes": [0.0, 0.8]}}), "vlm")
    rest, got = audit.split_attempts(seg, vlm)
    assert rest.count() == 2
    r = got.first()
    assert (r["tag"], r["seg"], r["start_at"], r["settle_at"]) == ("success", 1.0, 1.5, 2.5) and math.isclose(r["vlm"], np.mean([0.5, 0.6, 0.7, 0.8]))


# --- loading ---------------------------------------------------------------------------------------------------------
def test_rates_and_padding(spark):
    rows = [("a", 0, [1.0]), ("a", 5, [1.0, 2.0]), ("b", 7, None), ("c", 3, [4.0])]
    df = spark.createDataFrame(rows, "episode string, frame int, pose array<double>")
    g = loading.group_to_sequence(df, ["episode"], "frame", ["pose"]).select("episode", loading.episode_rate(F.col("frame")).alias("fps"))
    assert {r["episode"]: r["fps"] for r in g.collect()} == {"a": 6.0, "b": 1.0, "c": 1.0}
    assert {r["episode"]: r["rows"] for r in loading.pad_ragged(df, ["episode"], "frame", "pose").collect()} == {"a": [[1.0, None], [1.0, 2.0]], "c": [[4.0]]}


def test_bulk(spark):
    ok = spark.createDataFrame([("a", 2, (b"x", "p")), ("a", 0, (b"y", "p"))], "episode string, frame int, image struct<bytes:binary,path:string>")
    r = loading.bulk_episodes(ok).first()
    assert (r["total_frames"], r["fps"], r["frames"]) == (2, 15.0, [0, 2])
    bad = spark.createDataFrame([("a", 2, (None, "p"))], ok.schema)
    with pytest.raises(Exception, match="without bytes"):
        loading.bulk_episodes(bad).collect()
    assert loading.pose_columns(["left_obs_ee_pose", "image", "obs_eye_gaze"]) == {"left_obs_ee_pose": "left.obs_ee_pose", "obs_eye_gaze": "obs_eye_gaze"}


def test_skip_and_presets(spark):
    todo = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    done = spark.createDataFrame([("a", True), ("b", False)], "k string, complete boolean")
    assert [r[0] for r in loading.skip_completed(todo, done, "k", complete="complete").orderBy("k").collect()] == ["b", "c"]
    assert loading.skip_completed(todo, done, "k", force=True).count() == 3
    sets = {"ab": [presets.contains_any("k", ["a", "b"]), presets.one_of("k", ["b", "c"])]}
    assert [r[0] for r in presets.apply_preset(todo, sets, "ab").collect()] == ["b"]
    assert presets.apply_preset(todo, sets, None).count() == 3
    with pytest.raises(ValueError, match="ab"):
        presets.apply_preset(todo, sets, "nope")


def test_scorer_errors_are_rows(spark):
    class Half:
        def score(self, task, frames):
            if task == "bad":
                raise RuntimeError("no")
            return [len(f) / 2 for f in frames]

    df = spark.createDataFrame([("a", "t", [b"xy", b"x"]), ("b", "bad", [b"x"]), ("c", "t", [])], "episode string, task string, frames array<binary>")
    out = scoring.score_episodes(df, Half, name="half")
    got = {r["episode"]: (r["p_yes"], r["error"]) for r in out.collect()}
    assert got == {"a": ([1.0, 0.5], None), "b": (None, "RuntimeError: no"), "c": (None, "ValueError: no frames")}
    assert tuple(scoring.run_counters(out).first()) == (3, 1, 2)
    r = one(spark, scoring.fill_prompt("Is {task} done?\nSay: {task}", F.lit("it")).alias("p"))
    assert r["p"] == "Is it done?\nSay: it" and one(spark, scoring.short_prompt(F.lit("x\ny")).alias("p"))["p"] == "answer en y"


def test_masks(spark, tmp_path):
    bits = np.zeros((4, 6), bool)
    bits[1, 2:5] = True
    packed, empty = np.packbits(bits).tobytes(), np.packbits(np.zeros((4, 6), bool)).tobytes()
    df = spark.createDataFrame([("a", 0, 1, packed, 4, 6), ("a", 1, 1, empty, 4, 6), ("b", 0, 1, packed, 4, 6)], "episode string, frame_idx int, object_id int, mask binary, height int, width int")
    got = [(r["area"], r["centroid_x"], r["centroid_y"]) for r in scoring.unpack_masks(df).orderBy("episode", "frame_idx").collect()]
    assert got == [(3, 3.0, 1.0), (0, None, None), (3, 3.0, 1.0)]
    index = sinks.mask_files(df, "file://" + str(tmp_path / "m")).collect()
    assert sorted((r["episode"], r["frame_idx"], r["mask_offset"]) for r in index) == [("a", 0, 0), ("a", 1, 3), ("b", 0, 0)]
    idx = spark.createDataFrame([(r["episode"], r["frame_idx"], r["mask_offset"], r["mask_nbytes"]) for r in index], "file string, frame_idx int, mask_offset bigint, mask_nbytes bigint")
    back = {(r["file"], r["frame_idx"]): bytes(r["mask"]) for r in traces.read_mask_files(spark, str(tmp_path / "m"), idx).collect()}
    assert back == {("a", 0): packed, ("a", 1): empty, ("b", 0): packed}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.125, b"x"), ("b", None, b"y")], "episode string, s double, blob binary")
    sinks.write_traces(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).columns == ["s", "episode"]
    assert list(sinks.markdown(df.drop("blob").orderBy("episode"))) == ["| episode | s |", "|---|---|", "| a | 0.12 |", "| b | — |"]
    grid = sinks.contact_sheet(spark.range(5).withColumn("g", F.lit(1)), ["id"], keys=["g"], columns=2, width=10, height=10, pad=1)
    assert [(r["grid_row"], r["grid_col"]) for r in grid.orderBy("id").collect()] == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0)]
    (tmp_path / "clips").mkdir()
    for n in ("a.mp4", "b.txt", "c.avi"):
        (tmp_path / "clips" / n).write_bytes(b"1")
    assert sorted(r["clip"] for r in traces.read_clips(spark, str(tmp_path / "clips")).select("clip").collect()) == ["a", "c"]


def test_stream(spark, folder, tmp_path):
    d = folder("vlm", {"a": {"p_yes": [0.1, 0.9]}, "b": {"p_yes": [0.2]}})
    q = streaming.stream_tags(streaming.stream_traces(spark, d)).writeStream.format("memory").queryName("tags").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {r["episode"]: r["tag"] for r in spark.table("tags").collect()} == {"a": "success", "b": "failure"}


def test_model_folders_are_listed_not_their_files(spark, tmp_path):
    """A glob over files made each one a path of its own; folders further down and files beside the folders are no models'."""
    for path in ("a/e1.json", "a/e2.json", "b/e1.json", "a/more/e3.json", "e4.json", "a/notes.txt"):
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_text('{"task_name": "cup_success", "p_yes": [0.5]}')
    rows = traces.read_model_traces(spark, str(tmp_path))
    assert sorted((r["model_dir"], r["episode"]) for r in rows.collect()) == [("a", "e1"), ("a", "e2"), ("b", "e1")]
    assert "InMemoryFileIndex(2 paths)" in rows._jdf.queryExecution().executedPlan().toString()
