"""The operators over the driver's tables, each as a registered query.

A user's events are taken as the frames of an episode; documents with labels as scored items; line items as groups.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import any_word, first_filled, in_box, known, label_of, mean_present, nan_to_null, norm, pad_box, slow_tag, split_prompts, tag_above, tag_from, to_camera
from ..operators import attempts as att
from ..operators import confidence as conf
from ..operators import detections as det
from ..operators import evaluation as ev
from ..operators import fusion, gripper, loading, presets, ranges
from ..operators import sequence as seq
from ..sources.shared import kept
from . import audit

KINDS = ("click", "error", "purchase", "signup", "view")
EP = ["ep"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ep, idx, value, p, k, kind) of events: p is value / (value + 50), k the number in props."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("ep"), "ts", "event_id", "value", F.col("event_type").alias("kind"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    out = e.withColumn("idx", F.row_number().over(seq.ordered(EP, F.struct("ts", "event_id"))) - 1)
    return out.select("ep", "idx", "value", (F.col("value") / (F.col("value") + 50.0)).alias("p"), "k", "kind")


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def big(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, whole numbers as bigint: what two engines can be compared by."""
    kinds = dict(df.dtypes)
    return df.select([r6(c).alias(c) if kinds[c] == "double" else big(c).alias(c) if kinds[c] in ("int", "smallint", "bigint") else F.col(c) for c in df.columns])


def seg_frames(spark: SparkSession, sf_dir: str, half: float = 25.0) -> DataFrame:
    """Every frame a cup at (value, k), every view a saucer box of a half width around it, widened as the audit does."""
    f = frames(spark, sf_dir)
    x, y = F.col("value"), F.col("k").cast("double")
    box = F.when(F.col("kind") == "view", pad_box(x - half, y - half, x + half, y + half))
    return f.select("ep", "idx", "kind", x.alias("cup_x"), y.alias("cup_y"), box.alias("box"), "p")


# --- confidence ------------------------------------------------------------------------------------------------------
def vlm_late_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(conf.frame_statistics(frames(spark, sf_dir), EP, "idx", "p"))


def curve_array_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same statistics from whole curves, one array per episode."""
    curves = loading.group_to_sequence(frames(spark, sf_dir), EP, "idx", ["p"]).withColumnRenamed("p", "p_yes")
    return rounded(conf.add_curve_statistics(curves).select("ep", "p_done_late", "p_done_final", "p_done_max", "p_done_rise"))


def stride_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(seq.stride_sample(frames(spark, sf_dir), "idx", 3).select("ep", "idx", "p"))


def frame_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(seq.frame_cap(seq.stride_sample(frames(spark, sf_dir), "idx", 3), EP, "idx", 5).select("ep", "idx", "p"))


def median_calibrated_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = conf.frame_statistics(frames(spark, sf_dir), EP, "idx", "p").select("ep", F.col("p_done_late").alias("late"))
    out = fusion.with_threshold(late, fusion.calibration(late, "late"))
    return rounded(out.withColumn("tag", tag_above("late", F.col("threshold"))))


def prevalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ev.prevalence(median_calibrated_tags(spark, sf_dir), [], "tag"))


def softmax_pyes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An embedding as the logits of a vocabulary of 64: tokens 0, 1 say yes, 2, 3 no."""
    return rounded(table(spark, sf_dir, "embeddings").select("vec_id", conf.yes_from_logits("embedding", [0, 1], [2, 3]).alias("p_yes")))


def logprob_pyes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event kinds as tokens: view says yes, error no, ln p their log-probability, per ten frames."""
    f = frames(spark, sf_dir).select("ep", F.floor(F.col("idx") / 10).alias("block"), F.when(F.col("kind") == "view", " Yes").when(F.col("kind") == "error", "NO ").otherwise(F.col("kind")).alias("token"), F.ln("p").alias("logprob"))
    return rounded(conf.yes_from_logprobs(f, ["ep", "block"], yes=["yes"], no=["no"]))


def top_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "conversations").select("role", F.explode(F.split(F.lower("text"), " ")).alias("token")).filter("token <> ''").groupBy("role", "token").count()
    return rounded(conf.top_tokens(words, ["role"], "token", "count").select("role", "token", F.col("count").alias("n"), "rank"))


def token_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part numbers of pieces named like one of two words, with or without a leading space."""
    vocabulary = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.when(F.col("p_partkey") % 2 == 0, " ").otherwise(""), "p_brand").alias("piece"))
    ids = conf.surface_ids(vocabulary, ["Brand#11", "Brand#23"], token_id="p_partkey")
    return ids.select(F.explode("ids").alias("id"))


def class_mean_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(conf.class_gap(scored_documents(spark, sf_dir), "label", ["n_chars", "n_words"]))


# --- labels, fusion, verdicts ----------------------------------------------------------------------------------------
def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.col("n_chars").cast("double").alias("n_chars"), F.size(F.split("text", " ")).cast("double").alias("n_words"))
    quality = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return docs.join(quality, "doc_id").withColumn("label", F.when(F.col("quality") == 1, "success").otherwise("failure"))


def task_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order status as a task name's suffix, priority as an explicit label for some."""
    o = table(spark, sf_dir, "orders")
    name = F.when(F.col("o_orderstatus") == "F", "ship_success").when(F.col("o_orderstatus") == "O", "ship_failure").otherwise("ship")
    given = F.when(F.col("o_orderpriority") == "1-URGENT", "failure").when(F.col("o_orderpriority") == "5-LOW", "unknown")
    out = o.select("o_orderkey", label_of(given, name).alias("label"), first_filled(F.when(F.col("o_orderkey") % 2 == 0, ""), F.when(F.col("o_orderkey") % 3 == 0, name), default="none").alias("task"))
    return out


def order_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer, the share of filled orders."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_custkey").alias("ep")).agg(F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("seg_score"))


def customer_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("bigint").alias("ep"), (F.col("c_acctbal") > 0).alias("any_hold"), "c_mktsegment")


def late_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conf.frame_statistics(frames(spark, sf_dir), EP, "idx", "p").select("ep", F.col("p_done_late").alias("late"))


def signal_outer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals = {"vlm": late_signal(spark, sf_dir), "seg": order_signal(spark, sf_dir), "geo": customer_signal(spark, sf_dir)}
    rows = fusion.spine({n: d.withColumn("name", F.lit(n)) for n, d in signals.items()}, "ep")
    first = fusion.first_record(dict.fromkeys(signals, "name"))
    return rounded(rows.select("ep", "vlm.late", "seg.seg_score", "geo.any_hold", first.alias("first_signal")))


def calibrated_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The late scores, a row per episode, are kept: they are fused, and calibrated by their median."""
    late = kept(late_signal(spark, sf_dir), "late")
    rows = fusion.spine({"vlm": late, "seg": order_signal(spark, sf_dir), "geo": customer_signal(spark, sf_dir)}, "ep")
    flat = rows.select("ep", "vlm.late", "seg.seg_score", "geo.any_hold")
    return rounded(fusion.calibrated_fusion(flat, late="late", seg="seg_score", any_hold="any_hold", threshold=fusion.calibration(late, "late")))


def report_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = late_signal(spark, sf_dir)
    return rounded(late.join(order_signal(spark, sf_dir), "ep", "left").withColumn("pred", tag_above("late", 0.4)))


def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each kind of event as a model: the mean of an episode's p."""
    return frames(spark, sf_dir).groupBy("ep", F.col("kind").alias("model")).agg(F.avg("p").alias("score"))


def final_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fusion.verdicts(model_scores(spark, sf_dir), order_signal(spark, sf_dir), key="ep"))


def model_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model_scores(spark, sf_dir).withColumn("tag", tag_above("score", 0.6))


def consensus_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = model_tags(spark, sf_dir)
    cells = ev.pivot_cells(tags, "ep", "model", KINDS, "tag")
    return rounded(cells.join(fusion.consensus_of(tags, EP, "tag"), "ep"))


def vote_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = model_scores(spark, sf_dir).withColumn("tag", tag_from("score", 0.6))
    return rounded(fusion.consensus_of(votes, EP, "tag"))


def agreement_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ev.agreement(model_tags(spark, sf_dir), "ep", "model", "tag", KINDS))


# --- evaluation ------------------------------------------------------------------------------------------------------
def auroc_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ev.auroc(scored_documents(spark, sf_dir), ["lang"], "n_chars", "quality"))


def accuracy_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scored_documents(spark, sf_dir).withColumn("pred", tag_above("n_chars", 800.0))
    return rounded(ev.accuracy(d, ["source"], "pred", "label"))


def roc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ev.roc_points(scored_documents(spark, sf_dir), ["lang"], "n_chars", "quality", "doc_id"))


def group_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return flag as data set, line status as model, discount and tax as the two statistics; labels by quantity."""
    q = F.col("l_quantity")
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("dataset"), F.col("l_linestatus").alias("model"), (F.col("l_discount") * 10).alias("late"), (F.col("l_tax") * 12).alias("peak"),
        F.when(q > 30, "success").when(q < 20, "failure").alias("label"),
    )
    stat = slow_tag(F.when(F.col("dataset") == "A", "max").otherwise("late"), "late", "peak")
    rows = rows.withColumns({"tag": tag_above(stat), "tag_late": tag_above("late"), "tag_max": tag_above("peak")})
    return rounded(ev.summary(rows, ["dataset", "model"], tag="tag", late_tag="tag_late", max_tag="tag_max", label="label", score="late"))


def feature_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scored_documents(spark, sf_dir).withColumns({"per_word": F.col("n_chars") / F.col("n_words"), "constant": F.lit(1.0), "sometimes": F.when(F.col("doc_id") % 7 != 0, F.col("n_chars"))})
    return rounded(ev.separation(d, "label", ["n_chars", "n_words", "per_word", "constant", "sometimes"]))


# --- boxes -----------------------------------------------------------------------------------------------------------
def best_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frame of largest k of each episode and kind; of equals, the first."""
    f = frames(spark, sf_dir)
    objects = F.array_sort(F.collect_list(F.struct("idx", F.col("k").alias("score"), "p")))
    b = det.best_detection(F.col("objects"))
    return rounded(f.groupBy("ep", "kind").agg(objects.alias("objects")).select("ep", "kind", b["score"].alias("k"), b["idx"].alias("idx"), b["p"].alias("p")))


def prompt_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds as prompts, frames as objects: per ten frames, the objects under prompts with a given word, and the best."""
    f = frames(spark, sf_dir).withColumn("block", F.floor(F.col("idx") / 10))
    obj = F.struct(F.col("idx").cast("int").alias("object_id"), F.col("k").cast("double").alias("score"), F.col("kind"))
    g = f.groupBy("ep", "block").agg(F.array_sort(F.collect_list(obj)).alias("objects"))
    prompts = F.map_from_arrays(F.array(*map(F.lit, KINDS)), F.array(*[F.transform(F.filter("objects", _is(k)), lambda o: o["object_id"]) for k in KINDS]))
    g = g.withColumn("found", det.objects_of(F.col("objects"), prompts, ["ur", "view"]))
    b = det.best_detection(F.col("found"))
    return rounded(g.select("ep", "block", F.size("found").alias("n_found"), b["object_id"].alias("best_id"), b["score"].alias("best_score")))


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda o: o["kind"] == kind


def saucer_locf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frame's carried box, and whether its point is in it; before the first box, the episode's last."""
    f = seg_frames(spark, sf_dir).withColumn("b", seq.carried_or_last("box", EP, "idx"))
    return rounded(f.select("ep", "idx", F.col("b.x0").alias("x0"), F.col("b.y1").alias("y1"), in_box("cup_x", "cup_y", "b").alias("inside"), seq.carried("box", EP, "idx").isNull().alias("no_box_yet")))


def cup_on_saucer(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = seg_frames(spark, sf_dir, 60.0).withColumn("cup_x", F.when(F.col("kind") != "error", F.col("cup_x")))
    return rounded(det.placement(f, EP, "idx").select("ep", "n", "saucer_tracked", "cup_present_end", "cup_on_saucer", "seg_score", "seg_mode"))


def fallback_displacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = seg_frames(spark, sf_dir).withColumns({"box": F.when(F.col("ep") < 0, F.col("box")), "cup_x": F.when(F.col("kind") != "error", F.col("cup_x"))})
    return rounded(det.placement(f, EP, "idx").select("ep", "saucer_tracked", "cup_present_end", "cup_displacement", "cup_settled", "seg_score", "seg_mode"))


def mask_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames as the pixels of a mask at (idx, k), set where p is high, per kind."""
    return rounded(det.mask_summary(frames(spark, sf_dir).withColumn("on", F.col("p") > 0.9), ["ep", "kind"], "idx", "k", "on"))


# --- runs and holds --------------------------------------------------------------------------------------------------
def hold_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = seq.islands(frames(spark, sf_dir).withColumn("low", F.col("p") < 0.8), EP, "idx", "low", aggs=[F.max("k").alias("k_max")])
    return rounded(runs.filter("run_length >= 3"))


def longest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(seq.longest_run(seq.islands(frames(spark, sf_dir).withColumn("low", F.col("p") < 0.8), EP, "idx", "low"), EP))


def settled_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir).withColumn("settled", seq.moved_less("p", EP, "idx", 3, 0.05))
    return rounded(f.groupBy("ep").agg(F.count_if("settled").alias("n_settled")))


def gripper_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p as a gripper's reading: low stretches near 0.02, 0.008 or 0.001 by k, else open; commands from the kind."""
    f = frames(spark, sf_dir)
    level = F.when(F.floor(F.col("idx") / 12) % 2 == 1, 0.9).when(F.col("k") % 29 == 0, 0.001).when(F.col("k") % 31 == 0, 0.008).otherwise(0.02)
    cmd = F.when(F.col("ep") % 10 == 0, None).when(F.col("kind") == "error", None).when((F.floor(F.col("idx") / 12) % 2 == 1) & (F.col("k") % 3 == 0), 0.9).otherwise(0.1)
    return f.select("ep", "idx", level.alias("obs"), cmd.cast("double").alias("cmd"), F.lit(20.0).alias("fps"), "p", "k")


def hold_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = gripper.mark_holds(gripper_frames(spark, sf_dir), EP, "idx")
    return rounded(marked.groupBy("ep").agg(*gripper.hold_features(marked, EP)))


def both_holding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two readings of one episode as its arms: frames in which both are low."""
    f = frames(spark, sf_dir)
    left, right = f.select("ep", "idx", (F.col("p") < 0.85).alias("holding")), f.select("ep", "idx", (F.col("k") < 60).alias("holding"))
    return rounded(gripper.both_hands(left, right, EP, "idx").groupBy("ep").agg(F.avg(F.col("both").cast("double")).alias("both_fraction"), F.count_if("l_holding").alias("n_left"), F.count_if("r_holding").alias("n_right")))


def two_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean frames of two arms: the one of gripper_frames() at p on an axis, another without commands at k / 100."""
    g = gripper_frames(spark, sf_dir).select(F.col("ep").alias("episode"), F.col("idx").alias("frame_idx"), "obs", "cmd", "fps", "p", "k")
    other = F.when(F.floor(F.col("frame_idx") / 15) % 2 == 1, 0.9).when(F.col("k") % 23 == 0, 0.001).otherwise(0.03)
    zero = F.lit(0.0)
    left = g.select("episode", F.lit("left").alias("arm"), "frame_idx", "obs", "cmd", "fps", F.array("p", zero, zero).alias("camera_xyz"))
    right = g.select("episode", F.lit("right").alias("arm"), "frame_idx", other.alias("obs"), F.lit(None).cast("double").alias("cmd"), "fps", F.array(F.col("k") / 100.0, zero, zero).alias("camera_xyz"))
    return left.unionByName(right)


def bimanual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(gripper.bimanual_features(two_arms(spark, sf_dir)).withColumnRenamed("episode", "ep"))


def nan_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which fields of which arm miss a value somewhere in an episode."""
    f = two_arms(spark, sf_dir)
    axes = {f"{a}_{x}": F.when(F.col("obs") < 0.01, None).otherwise(F.get("camera_xyz", F.lit(i))) for a in ("obs", "cmd") for i, x in enumerate("xyz")}
    found = gripper.missing_fields(f.withColumns(axes))
    return found.select(F.col("episode").alias("ep"), F.array_join("nan_fields", ",").alias("nan_fields"))


def arm_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path, speed and tracking error of a hand at (p, k / 100, 0) whose command is at (p, k / 100, value / 1000)."""
    f = frames(spark, sf_dir)
    pose = {"obs_x": F.col("p"), "obs_y": F.col("k") / 100.0, "obs_z": F.lit(0.0), "cmd_x": F.col("p"), "cmd_y": F.col("k") / 100.0, "cmd_z": F.col("value") / 1000.0, "fps": F.lit(20.0)}
    moved = gripper.add_kinematics(f.withColumns(pose), EP, "idx")
    return rounded(moved.groupBy("ep").agg(*gripper.motion_features()))


def handover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per episode, runs of frames in which both readings are low and near: number, first longest, its middle frame."""
    f = frames(spark, sf_dir).withColumn("near", (F.col("p") < 0.85) & (F.col("k") < 60) & (F.abs(F.col("value") - F.col("k")) < 250))
    runs = seq.islands(f, EP, "idx", "near")
    best = F.max_by(F.struct("run_start", "run_end", "run_length"), F.struct("run_length", -F.col("run_start")))
    per = runs.groupBy("ep").agg(F.count("*").alias("n_handovers"), best.alias("b"))
    return rounded(per.select("ep", "n_handovers", F.col("b.run_length").alias("longest"), F.floor((F.col("b.run_start") + F.col("b.run_end")) / 2).alias("frame")))


def p5_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    pool = F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice"))
    return rounded(l.groupBy("l_suppkey").agg(F.coalesce(F.percentile(pool, 0.05), F.percentile("l_extendedprice", 0.05)).alias("p5"), F.median("l_quantity").alias("median_quantity")))


def gradient_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir).withColumn("g", seq.gradient("p", EP, "idx"))
    return rounded(f.groupBy("ep").agg((F.avg(F.abs("g")) * 30.0).alias("speed_mean"), (F.max(F.abs("g")) * 30.0).alias("speed_max")))


def path_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of one label, in order of id, as the positions of a hand."""
    e = table(spark, sf_dir, "embeddings").select("label", "vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(a) for i, a in enumerate("xyz")])
    e = ranges.step_lengths(e, ["x", "y", "z"], ["label"], "vec_id")
    return rounded(e.groupBy("label").agg(F.coalesce(F.sum("step"), F.lit(0.0)).alias("path"), F.max("step").alias("longest_step"), F.count("*").alias("n")))


def tracking_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of two halves of a vector: where a hand is and where it should be."""
    e = table(spark, sf_dir, "embeddings")
    d = [F.get("embedding", F.lit(i)).cast("double") - F.get("embedding", F.lit(i + 32)).cast("double") for i in range(3)]
    return rounded(e.groupBy("label").agg(F.avg(norm(*d)).alias("err_mean"), F.max(norm(*d)).alias("err_max")))


def camera_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors' first components through the inverse of one fixed transform."""
    m = F.array(*[F.array(*map(F.lit, row)) for row in ((0.0, -2.0, 0.0, 0.5), (1.0, 0.0, 0.5, -0.25), (0.0, 0.0, 4.0, 1.0), (0.0, 0.0, 0.0, 1.0))])
    e = table(spark, sf_dir, "embeddings").withColumn("c", to_camera(F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double")), m))
    return rounded(e.select("vec_id", *[F.get("c", F.lit(i)).alias(a) for i, a in enumerate("xyz")]))


def nan_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items whose tax is NaN where it is 0: missing in every mean, and listed."""
    l = table(spark, sf_dir, "lineitem").select("l_returnflag", nan_to_null(F.when(F.col("l_tax") == 0, float("nan")).otherwise(F.col("l_tax"))).alias("tax"), nan_to_null("l_discount").alias("discount"))
    missing = F.array_compact(F.array(*[F.when(F.count(c) < F.count("*"), F.lit(c)) for c in ("discount", "tax")]))
    return rounded(l.groupBy("l_returnflag").agg(F.avg("tax").alias("tax_mean"), F.min("tax").alias("tax_min"), F.max("tax").alias("tax_max"), F.avg("discount").alias("discount_mean"), F.array_join(missing, ",").alias("nan_fields")))


# --- alignment -------------------------------------------------------------------------------------------------------
def interp_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    return rounded(seq.interpolate(f.filter("kind = 'click'"), f.filter("kind = 'view'"), EP, "idx", "p"))


def held_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    return rounded(seq.held(f.filter("kind = 'click'"), f.filter("kind = 'view'"), EP, "idx", "p"))


def forward_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames within the next five of which, themselves included, one is an error."""
    f = seq.positions(frames(spark, sf_dir), EP, "idx").withColumn("nxt", seq.next_position(F.col("kind") == "error", EP, "idx"))
    return rounded(f.withColumn("soon", known(F.col("nxt") < F.col("pos") + 5)).groupBy("ep").agg(F.count_if("soon").alias("n_soon"), F.count_if(F.col("nxt").isNull()).alias("n_never")))


def even_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(seq.even_pick(frames(spark, sf_dir), EP, "idx", 8).select("ep", "idx", "k"))


def prefer_populated(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = seq.prefer(frames(spark, sf_dir), EP, F.col("k") > 96)
    return rounded(f.groupBy("ep").agg(F.count("*").alias("n"), F.min("k").alias("k_min")))


def progress_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(seq.progress(frames(spark, sf_dir), EP, "idx").select("ep", "idx", "progress"))


# --- attempts --------------------------------------------------------------------------------------------------------
def attempt_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    still = F.coalesce(seq.step_length(["p"], EP, "idx") < 0.3, F.lit(True))
    inside = F.when(F.col("kind") != "purchase", (F.col("p") >= 0.8).cast("double"))
    return f.withColumns({"still": still, "inside": inside, "dt": F.lit(0.5)})


def motion_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cup at (value, k) moving against a saucer at (0, k): frames at rest, and frames in the latest box."""
    f = seg_frames(spark, sf_dir).withColumns({"saucer_x": F.lit(0.0), "saucer_y": F.col("cup_y"), "dt": F.lit(0.5)})
    m = att.motion(f, EP, "idx", speed=200.0)
    return rounded(m.groupBy("ep").agg(F.count_if("still").alias("n_still"), F.sum("inside").alias("n_inside"), F.count("inside").alias("n_known")))


def rest_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = att.rests(attempt_frames(spark, sf_dir), EP, "idx", score="p")
    moves = att.transitions(rest, EP)
    return rounded(moves.select("ep", "rest_start", "rest_end", "on", F.col("next.rest_start").alias("next_start"), F.col("next.on").alias("next_on"), "kind"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(att.attempts(att.rests(attempt_frames(spark, sf_dir), EP, "idx", score="p"), EP))


def prefix_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The curve up to each frame: its length and sum."""
    return rounded(seq.prefix_statistics(frames(spark, sf_dir), EP, "idx", "p").select("ep", "idx", "so_far.n", "so_far.total"))


def first_top_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds as data sets: the first episode with tokens, the k over 95 of its frames in order."""
    f = frames(spark, sf_dir).groupBy(F.col("kind").alias("dataset"), F.lit("m").alias("model"), F.col("ep").alias("episode"))
    rows = f.agg(F.array_sort(F.collect_list(F.when(F.col("k") > 95, F.struct("idx", "k")))).alias("t"))
    got = audit.first_top_tokens(rows.withColumn("top_tokens", F.transform("t", lambda x: x["k"].cast("string"))))
    return got.select("dataset", "model", F.col("episode").cast("bigint").alias("episode"), F.array_join("top_tokens", ",").alias("tokens"))


def veto_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled episodes that the record vetoes: how many, and which."""
    rows = customer_signal(spark, sf_dir).select(F.col("ep").alias("episode"), F.col("any_hold").alias("geo_any_hold"), F.when(F.col("c_mktsegment") == "BUILDING", "success").alias("label"))
    return rounded(audit.vetoes(rows).select("n", F.array_join(F.transform("episodes", lambda e: e.cast("string")), ",").alias("episodes")))


def seg_only_prevalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market segments as data sets: tags by the box score alone."""
    rows = order_signal(spark, sf_dir).join(customer_signal(spark, sf_dir), "ep").withColumnRenamed("c_mktsegment", "dataset")
    return rounded(ev.seg_only_prevalence(rows, ["dataset"], "seg_score"))


def verdict_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final verdicts in one row: episodes, those with model scores, and the failures of all and of those."""
    return rounded(ev.headline(fusion.verdicts(model_scores(spark, sf_dir), order_signal(spark, sf_dir), key="ep")))


def scores_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chart's table of scores under each label, per source."""
    return rounded(ev.scores_by_label(scored_documents(spark, sf_dir), ["source"], "label", "n_chars"))


def role_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation whose role differs from the one before, as transitions."""
    c = table(spark, sf_dir, "conversations")
    before = F.lag("role").over(seq.ordered(["conv_id"], "turn"))
    moves = c.withColumn("before", before).filter(F.col("before").isNotNull() & (F.col("before") != F.col("role")))
    return rounded(moves.groupBy("before", "role").count().withColumnRenamed("count", "n"))


# --- loading, filters, files -----------------------------------------------------------------------------------------
def group_to_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    g = loading.group_to_sequence(c, ["conv_id"], "turn", ["role"])
    return rounded(g.select("conv_id", F.size("role").alias("n"), F.array_join("role", ">").alias("roles"), r6(loading.episode_rate(F.col("turn"))).alias("fps")))


def ragged_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn's words as its row: padded to the longest of its conversation."""
    c = table(spark, sf_dir, "conversations").withColumn("w", F.split("text", " "))
    g = loading.pad_ragged(c, ["conv_id"], "turn", "w")
    filled = F.transform("rows", lambda r: F.array_join(r, " ", "_"))
    return rounded(g.select("conv_id", "width", F.array_join(filled, "|").alias("rows")))


def skip_completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg((F.count_if(F.col("l_linestatus") == "O") == 0).alias("complete"))
    todo = loading.skip_completed(table(spark, sf_dir, "orders"), done, "o_orderkey", complete="complete")
    return rounded(todo.select("o_orderkey", "o_custkey"))


def missing_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episode and kind pairs without a frame of high p."""
    f = frames(spark, sf_dir).withColumnRenamed("kind", "model")
    return rounded(loading.missing_pairs(f, f.filter("p > 0.75"), ["ep", "model"]))


def sampled_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth frame of an episode, twelve at most, with the customer it belongs to; an episode always has one."""
    who = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("bigint").alias("ep"), "c_mktsegment")
    return rounded(loading.sampled_frames(frames(spark, sf_dir).select("ep", "idx", "p"), who, "ep", "idx", stride=5, most=12))


def preset_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = {"brass": [presets.contains_any("p_type", ["BRASS", "STEEL", "COPPER"]), presets.one_of("p_brand", [f"Brand#{a}{b}" for a in (1, 2, 3) for b in (1, 2, 3)])], "large": [F.col("p_size") > 40, presets.equals("p_brand", "Brand#11")]}
    p = table(spark, sf_dir, "part")
    a, b = (presets.apply_preset(p, catalog, n).select(F.lit(n).alias("preset"), "p_partkey", "p_brand") for n in ("brass", "large"))
    return rounded(a.unionByName(b))


def prefix_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty customers, by name, of a name prefix: the limit is the operator."""
    c = loading.starts_with(table(spark, sf_dir, "customer"), "c_name", "Customer#0000001")
    return rounded(loading.first_rows(c.select("c_name", "c_custkey"), ["c_name"], 20))


def prompt_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts split at commas as lists of prompts: how many there are, and whether one has a given word in it."""
    d = table(spark, sf_dir, "documents").withColumn("prompts", split_prompts("text"))
    hit = F.exists("prompts", lambda p: any_word(p, ["the ", "der "]))
    return rounded(d.select("doc_id", F.size("prompts").alias("n_prompts"), F.coalesce(hit, F.lit(False)).alias("has_word")))


def sidecar_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document's bytes start in the file of its source."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", F.col("n_chars").alias("nbytes"))
    return rounded(ranges.running_sums(d, ["source"], "doc_id", {"offset": "nbytes"}, own=False).drop("offset_all"))


def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k int").alias("p"))
    return rounded(e.groupBy("event_type").agg(F.sum("p.k").alias("k_sum"), F.max("p.k").alias("k_max"), F.count("p.k").alias("n")))


def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes, frames, and frames without detections."""
    f = frames(spark, sf_dir)
    return rounded(f.agg(F.count_distinct("ep").alias("episodes"), F.count("*").alias("frames"), F.count_if(F.col("kind") == "error").alias("skipped"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds")))


def null_skipping_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    a, b = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice") / 2)
    return rounded(o.select("o_orderkey", mean_present(a, b).alias("m")))


QUERIES = {f.__name__: f for f in (
    vlm_late_features, curve_array_features, stride_sample, frame_cap, median_calibrated_tags, prevalence, softmax_pyes, logprob_pyes, top_tokens, token_surfaces, class_mean_gap,
    task_labels, signal_outer_join, calibrated_fusion, report_left_join, final_verdict, consensus_pivot, vote_string, agreement_matrix, auroc_by_lang, accuracy_by_source, roc_points,
    group_summary, feature_separation, best_detection, prompt_objects, saucer_locf, cup_on_saucer, fallback_displacement, mask_centroids, hold_runs, longest_run, settled_frames, hold_ends,
    both_holding, bimanual, handover, p5_median, gradient_speed, path_length, tracking_error, camera_frame, nan_missing, nan_fields, arm_motion, interp_resample, held_asof, forward_window, even_pick, prefer_populated,
    progress_axis, motion_states, rest_transitions, attempts, prefix_traces, first_top_tokens, veto_list, seg_only_prevalence, verdict_headline, scores_by_label, role_changes, group_to_sequence, ragged_pad, skip_completed, missing_models, sampled_scan, preset_filters, prefix_limit, prompt_words, sidecar_offsets,
    json_extract, run_counters, null_skipping_mean,
)}
