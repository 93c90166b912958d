"""The audits end to end, over traces as the sources read them."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import TAG_THRESHOLD
from ..functions import slow_tag, tag_above, tag_from
from ..operators import attempts as att
from ..operators import detections as det
from ..operators import evaluation as ev
from ..operators import fusion
from ..operators import gripper
from ..operators import sequence as seq
from ..operators.confidence import add_curve_statistics
from ..sources.shared import kept
from ..sources.sinks import markdown


def fused_audit(vlm: DataFrame, seg: DataFrame, geo: DataFrame | None = None, *, threshold: float | None = None, seg_threshold: float = TAG_THRESHOLD) -> DataFrame:
    """A row per episode of any signal: label, vlm_*, seg_*, geo_* features, predictions, fused score and tag.

    Without a threshold, the confidence score is calibrated at the median of all episodes that have one. The label is
    that of the first signal that has a record.

    Traces are read once each: the calibration takes the confidence features several times over, so without a threshold they
    are written, when the audit is made, as a table in a shared folder.
    """
    v = add_curve_statistics(vlm).select("episode", "label", "p_done_late", "p_done_final", "p_done_max", "p_done_rise")
    if threshold is None:
        v = kept(v, "vlm-features")
    s = det.seg_features(seg, carry="label")
    signals = {"vlm": v, "seg": s}
    if geo is not None:
        signals["geo"] = geo.filter("features.bimanual is not null").select("episode", "label", F.coalesce("features.bimanual.any_hold", F.lit(False)).alias("any_hold"), F.coalesce("features.bimanual.handover_detected", F.lit(False)).alias("handover"), F.coalesce("features.bimanual.total_slips", F.lit(0)).alias("total_slips"))
    rows = fusion.spine(signals, "episode")
    columns = [F.col(f"{n}.{c}").alias(f"{n}_{c}") for n, d in signals.items() for c in d.columns if c not in ("episode", "label")]
    flat = rows.select("episode", fusion.first_record({n: "label" for n in signals}).alias("label"), *columns)
    if geo is None:
        flat = flat.withColumn("geo_any_hold", F.lit(None).cast("boolean"))
    t = fusion.calibration(v, "p_done_late") if threshold is None else threshold
    return fusion.calibrated_fusion(flat, late="vlm_p_done_late", seg="seg_seg_score", any_hold="geo_any_hold", threshold=t, seg_threshold=seg_threshold)


def audit_scores(audit: DataFrame) -> DataFrame:
    """(criterion, n, accuracy, auroc) of the three criteria, over labelled episodes that have them."""
    long = None
    for name, pred, score in (("vlm", "pred_vlm", "vlm_p_done_late"), ("seg", "pred_seg", "seg_seg_score"), ("fused", "pred_fused", "fused_score")):
        part = audit.filter(F.col("label").isNotNull() & F.col(pred).isNotNull()).select(F.lit(name).alias("criterion"), "label", F.col(pred).alias("pred"), F.col(score).alias("score"))
        long = part if long is None else long.unionByName(part)
    acc = ev.accuracy(long, ["criterion"], "pred", "label")
    curve = ev.auroc(long.withColumn("_pos", F.col("label") == "success"), ["criterion"], "score", "_pos")
    return acc.join(curve.select("criterion", "auroc"), "criterion", "left")


def audit_prevalence(audit: DataFrame) -> DataFrame:
    """Counts of the tag there is: fused, else vlm, else seg."""
    return ev.prevalence(audit.withColumn("tag", F.coalesce("pred_fused", "pred_vlm", "pred_seg")), [], "tag")


def vetoes(audit: DataFrame, *, first: int | None = None) -> DataFrame:
    """(n, episodes) of labelled episodes that the gripper record vetoed: how many, and the `first` of them in order, as a
    report shows them; all without it."""
    hit = audit.filter((F.col("geo_any_hold") == F.lit(False)) & F.col("label").isNotNull())
    return ev.distinct_values(hit, [], "episode", first=first).withColumnRenamed("values", "episodes")


def audit_markdown(audit: DataFrame) -> Iterator[str]:
    """The audit's report, line by line."""
    p = audit_prevalence(audit).first()
    if p:
        yield f"# Prevalence: {p['n']} episodes tagged, {p['n_success']} success, {p['n_failure']} failure ({100 * p['failure_share']:.0f}% failure)"
        yield ""
    yield from markdown(audit_scores(audit).orderBy("criterion"))
    yield ""
    yield from markdown(audit.select("episode", "label", "vlm_p_done_late", "seg_seg_score", "geo_any_hold", "fused_score", "pred_fused").orderBy("episode"))


def verdict_markdown(verdicts: DataFrame, scores: DataFrame, models: Sequence[str], *, title: str) -> Iterator[str]:
    """The report of final_verdicts(), line by line, with a column for each model of the scores (episode, model, score)."""
    h = ev.headline(verdicts).first()
    yield f"# {title}: final verdict"
    yield f"{h['episodes']} episodes, {h['with_models']} with model scores ({', '.join(models)}), the rest by boxes alone"
    yield f"**{h['n_success']} success / {h['n_failure']} failure: {100 * h['failure_share']:.0f}% failure**"
    if h["full_n"]:
        yield f"On the {h['full_n']} episodes with all signals: {h['full_success']} success / {h['full_failure']} failure"
    yield ""
    wide = verdicts.join(ev.pivot_cells(scores, "episode", "model", models, "score"), "episode", "left")
    yield from markdown(wide.select("episode", "label", "seg_score", *models, "final", "votes", "tag").orderBy("episode"))


def split_markdown(rests: DataFrame, attempts: DataFrame, episode: str) -> Iterator[str]:
    """The report of one episode of split_attempts(), line by line."""
    rest, own = rests.filter(F.col("episode") == episode), attempts.filter(F.col("episode") == episode)
    r = rest.agg(F.count("*").alias("n"), F.count_if("on").alias("on")).first()
    kinds = att.transitions(rest, ["episode"]).agg(F.count_if(F.col("kind") == "return").alias("returns")).first()
    t = own.agg(F.count("*").alias("n"), F.count_if(F.col("tag") == "success").alias("ok"), F.count_if(F.col("tag") == "failure").alias("bad")).first()
    yield f"# {episode}: split into attempts"
    yield f"**{t['n']} attempts: {t['ok']} success / {t['bad']} failure**, {kinds['returns']} returns, {r['n']} rests ({r['on']} on the target)"
    yield ""
    yield from markdown(own.select("attempt", "start_at", "settle_at", "carry_s", "seg", "vlm", "tag").orderBy("attempt"))


def report_markdown(rows: DataFrame, models: Sequence[str], boxes: DataFrame | None = None) -> Iterator[str]:
    """The report of report_rows(), line by line: summaries, tags by boxes alone of (dataset, episode, seg_score) rows, and
    the episodes' votes."""
    yield from markdown(report_summary(rows).orderBy("dataset", "model"))
    if boxes is not None:
        yield ""
        yield from markdown(ev.seg_only_prevalence(boxes, ["dataset"], "seg_score").orderBy("dataset"))
    yield ""
    yield from markdown(report_consensus(rows, models).orderBy("dataset", "episode"))


def final_verdicts(seg: DataFrame, models: DataFrame, *, statistic: str = "late", model: str = "model_dir") -> DataFrame:
    """A row per episode: box score, mean of the models' scores, final score, tag and votes; label of the box trace, else
    of a model's. statistic is late or max."""
    scored = add_curve_statistics(models).select("episode", F.col(model).alias("model"), "label", F.col("p_done_max" if statistic == "max" else "p_done_late").alias("score"))
    box = det.seg_features(seg).select("episode", "seg_score")
    out = fusion.verdicts(scored.filter("score is not null"), box, key="episode")
    labels = seg.select("episode", "label", F.lit(0).alias("o")).unionByName(scored.select("episode", "label", F.lit(1).alias("o")))
    labels = labels.groupBy("episode").agg(F.min_by(F.struct("label"), "o").alias("_l"))
    return out.join(labels, "episode", "left").select(*out.columns, F.col("_l.label").alias("label"))


def report_rows(datasets: Mapping[str, tuple[DataFrame, DataFrame, str]], *, threshold: float = TAG_THRESHOLD, model: str = "model_dir") -> DataFrame:
    """(dataset, model, episode, label, statistics, stat, pred, pred_late, pred_max, seg_score, trace, top_tokens) of
    {dataset: (model traces, box traces, statistic)}: model traces, each with its episode's box score if there is one."""
    out = None
    for name, (vlm, seg, statistic) in datasets.items():
        rows = add_curve_statistics(vlm).filter("p_done_late is not null").join(det.seg_features(seg).select("episode", "seg_score"), "episode", "left")
        stat = slow_tag(F.lit(statistic), "p_done_late", "p_done_max")
        rows = rows.select(F.lit(name).alias("dataset"), F.col(model).alias("model"), "episode", "label", "p_done_late", "p_done_max", stat.alias("stat"), F.lit(statistic).alias("stat_name"), tag_above(stat, threshold).alias("pred"), tag_above("p_done_late", threshold).alias("pred_late"), tag_above("p_done_max", threshold).alias("pred_max"), "seg_score", F.col("p_yes").alias("trace"), F.col("last_frame_top_tokens").alias("top_tokens"))
        out = rows if out is None else out.unionByName(rows)
    return out


def report_summary(rows: DataFrame) -> DataFrame:
    return ev.summary(rows, ["dataset", "model"], tag="pred", late_tag="pred_late", max_tag="pred_max", label="label", score="p_done_late")


def report_consensus(rows: DataFrame, models: Sequence[str]) -> DataFrame:
    """Per dataset and episode: each model's tag, the box score, and the vote of all of them."""
    box = rows.filter("seg_score is not null").select("dataset", "episode", F.lit("SEG").alias("model"), tag_from("seg_score").alias("pred")).distinct()
    all_ = rows.select("dataset", "episode", "model", "pred").unionByName(box)
    cells = [F.max(F.when(F.col("model") == m, F.col("pred"))).alias(m) for m in (*models, "SEG")]
    ns, n = F.count_if(F.col("pred") == "success"), F.count("pred")
    return all_.groupBy("dataset", "episode").agg(*cells, ev.consensus(ns, n).alias("consensus"), ev.votes(ns, n).alias("votes"))


def first_top_tokens(rows: DataFrame) -> DataFrame:
    """The first episode of each dataset and model that has top tokens, with them."""
    some = rows.filter(F.size("top_tokens") > 0)
    return some.groupBy("dataset", "model").agg(F.min_by(F.struct("episode", "top_tokens"), "episode").alias("e")).select("dataset", "model", "e.*")


def trace_chart(rows: DataFrame) -> DataFrame:
    """(dataset, model, episode, progress, p): the points of every curve, along 0 to 1."""
    pts = rows.select("dataset", "model", "episode", F.size("trace").alias("n"), F.posexplode("trace").alias("i", "p"))
    return pts.select("dataset", "model", "episode", F.coalesce(F.col("i") / F.nullif(F.col("n") - 1, F.lit(0)), F.lit(0.0)).alias("progress"), "p")


def split_attempts(seg: DataFrame, vlm: DataFrame | None = None, *, speed: float = 60.0, least_s: float = 1.0, window_s: float = 3.0) -> tuple[DataFrame, DataFrame]:
    """(rests, attempts) of segmentation traces. Source frames give the times; a confidence trace, whose stride may
    differ, is interpolated at the box frames."""
    src = F.get("source_indices", F.col("frame_idx"))
    fps = F.coalesce(F.nullif("fps", F.lit(0.0)), F.lit(30.0))
    keep = ("episode", "source_indices", "fps", "stride")
    frames = det.frame_tracks(det.explode_frames(seg, keep=keep)).withColumns({"src": src, "dt": F.coalesce(F.nullif("stride", F.lit(0)), F.lit(1)) / fps})
    frames = frames.withColumn("t", F.col("src") / fps).drop("source_indices", "objects", "prompt_to_obj_ids")
    moving = att.motion(frames, ["episode"], "frame_idx", speed=speed)
    if vlm is not None:
        points = vlm.select("episode", F.explode(F.arrays_zip("source_indices", "p_yes")).alias("z")).select("episode", F.col("z.source_indices").alias("src"), F.col("z.p_yes").alias("p"))
        p = seq.interpolate(moving.select("episode", "src"), points, ["episode"], "src", "p")
        moving = moving.join(p, ["episode", "src"], "left")
    rest = att.rests(moving, ["episode"], "frame_idx", score="p" if vlm is not None else None, at="t", least_s=least_s, window_s=window_s)
    return rest, att.attempts(rest, ["episode"])


def geometric_features(frames: DataFrame, episodes: DataFrame) -> DataFrame:
    """(episode, label, left, right, bimanual, nan_fields): the gripper features of proprioception frames."""
    clean = gripper.clean_frames(frames, episodes)
    arms = gripper.arm_features(clean)
    record: Column = F.struct(*[c for c in arms.columns if c not in ("episode", "arm")])
    arms = arms.groupBy("episode").agg(*[F.max(F.when(F.col("arm") == a, record)).alias(a) for a in ("left", "right")])
    both = gripper.bimanual_features(clean)
    both = both.select("episode", F.struct(*[c for c in both.columns if c != "episode"]).alias("bimanual"))
    from ..functions import label_from_name

    labels = episodes.select("episode", label_from_name("task_name").alias("label"))
    return labels.join(arms, "episode").join(both, "episode").join(gripper.missing_fields(clean), "episode", "left")


def geometric_separation(features: DataFrame) -> DataFrame:
    """The features that separate the labels best."""
    numeric = ("double", "int", "bigint", "boolean")
    names = [(g, f.name) for g in ("left", "right", "bimanual") for f in features.schema[g].dataType.fields if f.dataType.simpleString() in numeric]
    flat = features.select("label", *[F.col(f"{g}.{n}").cast("double").alias(f"{g}_{n}") for g, n in names])
    return ev.separation(flat, "label", [f"{g}_{n}" for g, n in names])
