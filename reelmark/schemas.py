"""Schemas, as DDL, of the traces that producers write and of the tables that loaders make."""

from __future__ import annotations

from pyspark.sql import types as T


def parsed(ddl: str) -> T.StructType:
    """A schema's fields; needs a session."""
    return T.StructType.fromDDL(ddl)


DETECTION = "object_id int, score double, box_xyxy array<double>, area bigint, centroid_xy array<double>, mask_shape array<int>, mask_offset bigint, mask_nbytes bigint"
FRAME = f"objects array<struct<{DETECTION}>>, prompt_to_obj_ids map<string,array<int>>"

SEG_TRACE = (
    "episode string, camera string, prompts array<string>, task_name string, task_description string, fps double, total_frames int,"
    f" stride int, label string, source_indices array<int>, frames map<string, struct<{FRAME}>>"
)
VLM_TRACE = (
    "episode string, model string, model_key string, task string, task_name string, label string, question string, stride int,"
    " source_indices array<int>, p_yes array<double>, last_frame_top_tokens array<array<string>>, p_yes_final double, p_yes_max double,"
    " p_yes_last_quartile_mean double, unresolved_frames int"
)
BIMANUAL = "any_hold boolean, handover_detected boolean, total_slips int, longest_handover_s double, n_handover_candidates int, handover_frame int, min_hand_distance_m double"
GEO_TRACE = f"episode string, task_name string, label string, total_frames int, fps double, nan_fields array<string>, features struct<bimanual struct<{BIMANUAL}>>"
EPISODE_ATTRIBUTES = (
    "total_frames int, fps double, task_name string, task_description string, embodiment string, source string, complete boolean,"
    " extrinsics map<string, array<array<double>>>"
)
EPISODE_STORE = f"attributes struct<{EPISODE_ATTRIBUTES}>"
GRIPPER_FRAMES = "episode string, arm string, frame_idx int, obs_gripper double, cmd_gripper double, obs_xyz array<double>, cmd_xyz array<double>"
BULK_FRAMES = (
    "episode string, frame int, image struct<bytes binary, path string>, left_obs_ee_pose array<float>, right_obs_ee_pose array<float>,"
    " obs_head_pose array<float>, obs_eye_gaze array<float>"
)
CATALOG = "embodiment string, task string, zarr_mp4_path string"
