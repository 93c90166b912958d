"""Gripper features: holds, how they ended, kinematics, and both hands together.

Missing readings are nulls (NaN becomes null first), and every condition on one is false.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import AIR_UP_TO, DEFAULT_FPS, HANDOVER_BELOW_M, HOLD_ABOVE, MIN_HOLD_S, OPEN_THRESHOLD, RELEASE_WINDOW_S, SETTLED_BELOW, SETTLED_LAG
from ..functions import known, nan_to_null, norm, to_camera
from . import sequence as seq


def clean_frames(frames: DataFrame, episodes: DataFrame | None = None) -> DataFrame:
    """Proprioception frames with NaN as null, poses cut to x, y, z, each with its episode's fps; frames beyond
    total_frames are padding and go. Episodes without attributes run at the default rate."""
    out = frames
    if episodes is not None:
        out = out.join(episodes.select("episode", "total_frames", "fps", "extrinsics"), "episode", "left")
        out = out.filter(F.col("total_frames").isNull() | (F.col("frame_idx") < F.col("total_frames")))
        fps, transform = F.coalesce(F.nullif("fps", F.lit(0.0)), F.lit(DEFAULT_FPS)), F.element_at("extrinsics", F.col("arm"))
    else:
        fps, transform = F.lit(DEFAULT_FPS), F.lit(None).cast("array<array<double>>")
    axes = {f"{p}_{a}": nan_to_null(F.get(F.col(f"{p}_xyz"), i)) for p in ("obs", "cmd") for i, a in enumerate("xyz")}
    out = out.select("episode", "arm", "frame_idx", nan_to_null("obs_gripper").alias("obs"), nan_to_null("cmd_gripper").alias("cmd"), *[c.alias(n) for n, c in axes.items()], fps.cast("double").alias("fps"), transform.alias("_t"))
    return out.withColumn("camera_xyz", to_camera(F.array("obs_x", "obs_y", "obs_z"), "_t")).drop("_t")


def frames_for(seconds: float, fps: Column | str) -> Column:
    """Whole frames of a time, rounded down, one at least."""
    return F.greatest(F.lit(1), F.floor(F.lit(seconds) * (F.col(fps) if isinstance(fps, str) else fps)).cast("int"))


def mark_holds(frames: DataFrame, keys: Sequence[str], order: str, *, obs: str = "obs", cmd: str = "cmd", fps: str = "fps") -> DataFrame:
    """Adds pos, n, cmd_usable, closed, cmd_closed, holding, hold_start, hold_end (both on a hold's last frame) and
    ending: release, slip, ambiguous, or null where the hold reaches the sequence's end.

    A hold is a settled plateau above the reading of closing on air, commanded closed, of a least duration. One
    shuffle: every window is within the sequence.
    """
    out = seq.positions(frames, keys, order)
    w = seq.ordered(keys, order)
    closed, cmd_shut = known(F.col(obs) < OPEN_THRESHOLD), known(F.col(cmd) < OPEN_THRESHOLD)
    out = out.withColumns({"closed": closed, "cmd_usable": F.count(cmd).over(seq.whole(keys)) > 0, "_settled": seq.moved_less(obs, keys, order, SETTLED_LAG, SETTLED_BELOW)})
    out = out.withColumn("cmd_closed", F.when(F.col("cmd_usable"), cmd_shut).otherwise(F.col("closed")))
    out = out.withColumn("_raw", known(F.col("cmd_closed") & F.col("closed") & (F.col(obs) > HOLD_ABOVE) & F.col("_settled")))
    out = out.withColumns({
        "_change": (F.col("_raw") != F.coalesce(F.lag("_raw").over(w), F.lit(False))).cast("int"), "_more": F.coalesce(F.lead("_raw").over(w), F.lit(False)),
        "_opens": seq.next_position(F.col(cmd) >= OPEN_THRESHOLD, keys, order), "_air": seq.next_position(F.col(obs) <= AIR_UP_TO, keys, order),
    })
    out = out.withColumns({"_run": F.sum("_change").over(w), "_opens": F.lead("_opens").over(w), "_air": F.lead("_air").over(w)})
    length = F.count("*").over(seq.whole([*keys, "_run"]))
    out = out.withColumn("_length", length).withColumn("holding", F.col("_raw") & (F.col("_length") >= frames_for(MIN_HOLD_S, fps)))
    ends = F.col("holding") & ~F.col("_more")
    end = F.col("pos") + 1
    until = end + frames_for(RELEASE_WINDOW_S, fps)
    how = F.when(known(F.col("cmd_usable") & (F.col("_opens") < until)), "release").when(known(F.col("_air") < until), "slip").otherwise("ambiguous")
    out = out.withColumns({"hold_end": F.when(ends, end), "hold_start": F.when(ends, end - F.col("_length")), "ending": F.when(ends & (end < F.col("n")), how)})
    return out.drop("_settled", "_raw", "_change", "_more", "_opens", "_air", "_run", "_length")


def hold_features(held: DataFrame, keys: Sequence[str], *, obs: str = "obs", fps: str = "fps") -> list[Column]:
    """Aggregates over mark_holds(): one row per sequence."""
    holding, ended = F.col("holding"), F.col("hold_end").isNotNull()
    pool = F.col("cmd_closed") & F.col(obs).isNotNull()
    return [
        F.coalesce(F.percentile(F.when(pool, F.col(obs)), 0.05), F.percentile(obs, 0.05)).alias("closed_reading_p5"),
        F.avg(F.col("closed").cast("double")).alias("closed_fraction"), F.avg(holding.cast("double")).alias("hold_fraction"),
        F.count_if(ended).alias("n_holds"), (F.coalesce(F.max(F.col("hold_end") - F.col("hold_start")), F.lit(0)) / F.max(fps)).alias("longest_hold_s"),
        F.median(F.when(holding, F.col(obs))).alias("hold_width_median"), F.count_if(F.col("ending") == "slip").alias("n_slips"),
        F.count_if(F.col("ending") == "release").alias("n_releases"), F.count_if(F.col("ending") == "ambiguous").alias("n_ambiguous_ends"),
        F.min(F.when(F.col("ending") == "slip", F.col("hold_end"))).alias("first_slip_frame"), F.max("cmd_usable").alias("cmd_gripper_available"),
    ]


def add_kinematics(frames: DataFrame, keys: Sequence[str], order: str, fps: str = "fps") -> DataFrame:
    """Adds speed (per second), step (to the frame before) and track_err (observed to commanded)."""
    slopes = {f"_g{a}": seq.gradient(f"obs_{a}", keys, order) for a in "xyz"}
    out = frames.withColumns(slopes | {"step": seq.step_length(["obs_x", "obs_y", "obs_z"], keys, order)})
    error = norm(*[F.col(f"obs_{a}") - F.col(f"cmd_{a}") for a in "xyz"])
    return out.withColumns({"speed": norm("_gx", "_gy", "_gz") * F.col(fps), "track_err": error}).drop("_gx", "_gy", "_gz")


def motion_features() -> list[Column]:
    """Aggregates over add_kinematics(): missing steps add nothing."""
    return [
        F.avg("speed").alias("ee_speed_mean"), F.max("speed").alias("ee_speed_max"), F.coalesce(F.sum("step"), F.lit(0.0)).alias("ee_path_length_m"),
        F.avg("track_err").alias("track_err_mean"), F.max("track_err").alias("track_err_max"),
    ]


def missing_fields(frames: DataFrame) -> DataFrame:
    """(episode, nan_fields): the sorted arm.field names that miss a value somewhere."""
    checks = {"obs_gripper": ["obs"], "cmd_gripper": ["cmd"], "obs_ee_pose": ["obs_x", "obs_y", "obs_z"], "cmd_ee_pose": ["cmd_x", "cmd_y", "cmd_z"]}
    found = [F.when(sum((F.col(c).isNull().cast("int") for c in cols), F.lit(0)) > 0, F.concat_ws(".", "arm", F.lit(name))) for name, cols in checks.items()]
    return frames.withColumn("_f", F.array_compact(F.array(*found))).groupBy("episode").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("_f")))).alias("nan_fields"))


def arm_features(frames: DataFrame) -> DataFrame:
    """(episode, arm, 16 features) of clean_frames()."""
    keys = ["episode", "arm"]
    marked = add_kinematics(mark_holds(frames, keys, "frame_idx"), keys, "frame_idx")
    return marked.groupBy(*keys).agg(*hold_features(marked, keys), *motion_features())


def both_hands(left: DataFrame, right: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """(keys, order, l_holding, r_holding, both): two arms' frames aligned by index; both where each is known to hold."""
    l, r = (d.select(*keys, order, F.col("holding").alias(n)) for d, n in ((left, "l_holding"), (right, "r_holding")))
    return l.join(r, [*keys, order]).withColumn("both", F.col("l_holding") & F.col("r_holding"))


def bimanual_features(frames: DataFrame, *, arms: tuple[str, str] = ("left", "right"), near: float = HANDOVER_BELOW_M) -> DataFrame:
    """(episode, 10 features) of clean_frames() with two arms.

    A handover is a run of frames in which both arms hold and their hands, in the camera's frame, are near. Without
    both arms' positions there is none, and distances are null. Frames are dealt by episode once.
    """
    keys = ["episode", "arm"]
    marked = mark_holds(frames.repartition("episode"), keys, "frame_idx")

    def of(arm: str, c: str) -> Column:
        return F.max(F.when(F.col("arm") == arm, F.col(c)))

    wide = marked.groupBy("episode", "frame_idx").agg(
        *[of(a, c).alias(f"{s}_{c}") for a, s in zip(arms, "lr", strict=True) for c in ("holding", "camera_xyz", "hold_end")],
        F.max("fps").alias("fps"), F.count_if(F.col("ending") == "slip").alias("slips"),
    )
    wide = wide.withColumns({"both": known(F.col("l_holding")) & known(F.col("r_holding")), "any": known(F.col("l_holding")) | known(F.col("r_holding")), "distance": norm(*[F.get("l_camera_xyz", F.lit(i)) - F.get("r_camera_xyz", F.lit(i)) for i in range(3)])})
    wide = wide.withColumn("handover", F.col("both") & known(F.col("distance") < near))
    w = seq.ordered(["episode"], "frame_idx")
    wide = seq.positions(wide, ["episode"], "frame_idx").withColumn("_run", F.sum((F.col("handover") != F.coalesce(F.lag("handover").over(w), F.lit(False))).cast("int")).over(w))
    per_run = seq.whole(["episode", "_run"])
    wide = wide.withColumns({"_len": F.when(F.col("handover"), F.count("*").over(per_run)), "_start": F.when(F.col("handover"), F.min("pos").over(per_run))})
    wide = wide.withColumn("_first", F.col("handover") & (F.col("pos") == F.col("_start")))
    # A run's middle frame is one of it, so the best run and the distance there are one conditional maximum.
    middle = F.col("handover") & (F.col("pos") == F.floor((2 * F.col("_start") + F.col("_len")) / 2))
    best = F.max(F.when(middle, F.struct(F.col("_len"), (-F.col("_start")).alias("_neg"), F.col("pos").alias("_at"), "distance")))
    per = wide.groupBy("episode").agg(
        F.avg(F.col("both").cast("double")).alias("both_holding_fraction"), best.alias("_best"), F.max("fps").alias("_fps"), F.count_if("_first").alias("n_handover_candidates"),
        F.min("distance").alias("min_hand_distance_m"), F.max("any").alias("any_hold"), F.sum("slips").alias("total_slips"), F.greatest(F.max("l_hold_end"), F.max("r_hold_end")).alias("last_hold_end_frame"),
    )
    length, frame = F.col("_best._len"), F.col("_best._at").cast("int")
    return per.select(
        "episode", "both_holding_fraction", (F.coalesce(length, F.lit(0)) / F.col("_fps")).alias("longest_handover_s"), "n_handover_candidates", frame.alias("handover_frame"),
        F.coalesce(length > 0, F.lit(False)).alias("handover_detected"), "min_hand_distance_m", F.col("_best.distance").alias("hand_distance_at_handover_m"), "any_hold", "total_slips", "last_hold_end_frame",
    )
