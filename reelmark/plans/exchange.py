"""Operators whose exchange is files: the tables' rows are written as a producer of audits writes them, and read back.

A user's events are the frames of an episode, as in plans.tables; a conversation's turns are frames with bytes. Files go to a
folder of their own under spark.checkpoint.dir.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tag_above
from ..operators import confidence as conf
from ..operators import detections as det
from ..operators import evaluation as ev
from ..operators import loading, presets, scoring
from ..sources import read_arrays, read_bulk_frames, read_clips, read_episode_store, read_mask_files, read_model_traces, read_preset, read_traces, sinks, write_store
from ..sources.shared import gathered, kept, shared_folder
from . import audit
from .table_sql import COUNTED, FRAMES, LATE, SEG
from .tables import frames, rounded, table

def ep() -> Column:
    return F.col("episode").cast("bigint").alias("ep")


# --- episode stores --------------------------------------------------------------------------------------------------
def _number_store(spark: SparkSession, sf_dir: str) -> str:
    root = shared_folder(spark, "store")
    f = frames(spark, sf_dir).select(F.col("ep").cast("string").alias("episode"), F.col("idx").alias("frame_idx"), "p", F.array("value", F.col("k").cast("double")).alias("reading"), F.when(F.col("kind") != "error", F.array("p")).alias("left.obs_pose"))
    write_store(f, root, chunk=16)
    return root


def _rows(arrays: DataFrame) -> DataFrame:
    return rounded(arrays.select(ep(), "array", F.col("frame_idx").alias("idx"), *(F.nanvl(F.get("value", F.lit(i)), F.lit(None)).alias(c) for i, c in enumerate("ab"))))


def store_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of three arrays an episode, read whole; of ragged rows, what is filled up is missing."""
    return _rows(read_arrays(spark, _number_store(spark, sf_dir), frames_a_task=20))


def store_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames 20 to 44 of one array of every episode: the filters are the feature, and decide which chunks are opened."""
    a = read_arrays(spark, _number_store(spark, sf_dir))
    return _rows(a.filter((F.col("array") == "reading") & F.col("frame_idx").between(20, 44)))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("episode"), F.col("turn").alias("frame_idx"), F.coalesce("text", F.lit("")).cast("binary").alias("image"), "role")


def store_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns' texts as the images of an episode, by their place in it."""
    root = shared_folder(spark, "store")
    write_store(_turns(spark, sf_dir).drop("role"), root, chunk=3)
    out = read_arrays(spark, root, blobs=True)
    return rounded(out.select(F.col("episode").cast("bigint").alias("conv_id"), F.col("frame_idx").alias("place"), F.sha2("value", 256).alias("sha")))


def store_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs. In the first, turns of the role system have no bytes, so their conversations are not written; the second
    loads these alone. What came in which run is told by the attributes."""
    root, turns = shared_folder(spark, "store"), _turns(spark, sf_dir)
    first = turns.select("episode", "frame_idx", F.when(F.col("role") != "system", F.col("image")).alias("image"), F.lit("first").alias("source"))
    write_store(first, root, attributes=["source"], strict=False)
    todo = loading.skip_completed(turns, read_episode_store(spark, root), "episode", complete="complete")
    write_store(todo.select("episode", "frame_idx", "image", F.lit("second").alias("source")), root, attributes=["source"])
    done = read_episode_store(spark, root)
    return rounded(done.select(F.col("episode").cast("bigint").alias("conv_id"), "total_frames", "fps", "source", "complete"))


# --- masks -----------------------------------------------------------------------------------------------------------
def mask_sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mask of each episode and kind, set where p is high: packed, written one after another into the episode's file, read
    back by ranges, unpacked."""
    px = frames(spark, sf_dir).select(F.col("ep").cast("string").alias("episode"), "kind", F.col("k").alias("y"), F.col("idx").alias("x"), (F.col("p") > 0.9).alias("on"))
    masks = scoring.pack_masks(px, ["episode", "kind"])
    root = shared_folder(spark, "masks")
    index = sinks.mask_files(masks, root, order=("kind",)).withColumnRenamed("episode", "file")
    back = read_mask_files(spark, root, index).join(masks.select(F.col("episode").alias("file"), "kind", "height", "width"), ["file", "kind"])
    out = scoring.unpack_masks(back)
    return rounded(out.select(F.col("file").cast("bigint").alias("ep"), "kind", "height", "width", "mask_offset", "mask_nbytes", F.sha2("mask", 256).alias("sha"), "area", "centroid_x", "centroid_y"))


# --- traces ----------------------------------------------------------------------------------------------------------
def _label_name(kind: str) -> Column:
    """A task name by an episode's first kind: with a label's suffix for two of them."""
    return F.when(F.col(kind) == "purchase", "cup_success").when(F.col(kind) == "signup", "cup_failure").otherwise("cup")


def _curves(spark: SparkSession, sf_dir: str, keys: tuple[str, ...] = ("ep",)) -> DataFrame:
    f = loading.group_to_sequence(frames(spark, sf_dir).withColumnRenamed("kind", "model"), keys, "idx", ["p", "model"] if "model" not in keys else ["p"])
    return f.withColumnsRenamed({"p": "p_yes", "idx": "source_indices"}).withColumn("episode", F.col("ep").cast("string"))


def _vlm_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _curves(spark, sf_dir).withColumn("first_kind", F.get("model", F.lit(0)))
    return c.select("episode", "first_kind", _label_name("first_kind").alias("task_name"), "source_indices", "p_yes", F.lit(1).alias("stride"))


def _statistics(traces: DataFrame) -> DataFrame:
    out = conf.add_curve_statistics(traces)
    return out.select(ep(), "label", F.size("p_yes").alias("n"), "p_done_late", "p_done_final", "p_done_max", "p_done_rise")


def traces_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of which those of episodes that begin with an error are cut in half: they are left out."""
    root = shared_folder(spark, "traces")
    d = sinks.documents(_vlm_documents(spark, sf_dir)).join(_vlm_documents(spark, sf_dir).select("episode", "first_kind"), "episode")
    text = F.when(F.col("first_kind") == "error", F.substring("document", F.lit(1), (F.length("document") / 2).cast("int"))).otherwise(F.col("document"))
    sinks.write_files(d.select(F.concat("episode", F.lit(".json")).alias("name"), text.alias("data")), root)
    return rounded(_statistics(read_traces(spark, root, "vlm")))


def traces_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = shared_folder(spark, "traces")
    sinks.write_documents(_vlm_documents(spark, sf_dir).drop("first_kind"), root)
    return rounded(_statistics(read_traces(spark, root, "vlm", strict=True)))


def model_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of traces for each kind of event, read as models; tags per model by the late score."""
    root = shared_folder(spark, "models")
    d = _curves(spark, sf_dir, ("ep", "model"))
    docs = sinks.documents(d.select("episode", "model", "p_yes", "source_indices").withColumn("name", F.concat("model", F.lit("/"), "episode", F.lit(".json"))), key="name")
    sinks.write_files(docs.withColumnRenamed("document", "data"), root)
    out = conf.add_curve_statistics(read_model_traces(spark, root))
    return rounded(out.select(ep(), F.col("model_dir").alias("model"), F.size("p_yes").alias("n"), "p_done_late", tag_above("p_done_late", 0.6).alias("tag")))


def _seg_documents(spark: SparkSession, sf_dir: str, half: float = 60.0) -> DataFrame:
    """Nested traces: every frame a cup (id 1 to 3) that has a centre but at errors, a better one (9) without a centre, and every
    view a saucer (20); prompts name them."""
    f = frames(spark, sf_dir)
    x, y = F.col("value"), F.col("k").cast("double")

    def thing(i: Column, score: Column, box: Column, centre: Column) -> Column:
        return F.struct(i.cast("int").alias("object_id"), score.cast("double").alias("score"), box.cast("array<double>").alias("box_xyxy"), centre.cast("array<double>").alias("centroid_xy"))

    own = 1 + F.col("k") % 3
    cup = thing(own, F.col("p"), F.lit(None), F.when(F.col("kind") != "error", F.array(x, y)))
    ghost = thing(F.lit(9), F.lit(2.0), F.lit(None), F.lit(None))
    saucer = thing(F.lit(20), F.lit(0.5), F.array(x - half, y - half, x + half, y + half), F.array(x, y))
    view = F.col("kind") == "view"
    objects = F.when(view, F.array(cup, ghost, saucer)).otherwise(F.array(cup, ghost))
    prompts = F.create_map(F.lit("white CUP"), F.array(own.cast("int"), F.lit(9)), F.lit("saucer"), F.when(view, F.array(F.lit(20))).otherwise(F.array().cast("array<int>")))
    frame = F.struct(F.col("idx").cast("string").alias("key"), F.struct(objects.alias("objects"), prompts.alias("prompt_to_obj_ids")).alias("value"))
    per = f.groupBy(F.col("ep").cast("string").alias("episode")).agg(F.map_from_entries(F.collect_list(frame)).alias("frames"), F.min_by("kind", "idx").alias("first_kind"), F.count("*").cast("int").alias("total_frames"))
    return per.select("episode", _label_name("first_kind").alias("task_name"), "total_frames", F.lit(30.0).alias("fps"), F.lit(1).alias("stride"), "frames")


def nested_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested traces written, read, and walked: placement, and how many ids the cup had."""
    root = shared_folder(spark, "seg")
    sinks.write_documents(_seg_documents(spark, sf_dir), root)
    out = det.seg_features(read_traces(spark, root, "seg", strict=True))
    return rounded(out.select(ep(), "n", "saucer_tracked", "cup_present_end", "cup_on_saucer", "seg_score", "seg_mode", "cup_track_ids"))


def _audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = {n: shared_folder(spark, n) for n in ("vlm", "seg", "geo")}
    sinks.write_documents(_vlm_documents(spark, sf_dir).drop("first_kind"), roots["vlm"])
    sinks.write_documents(_seg_documents(spark, sf_dir), roots["seg"])
    geo = frames(spark, sf_dir).groupBy(F.col("ep").cast("string").alias("episode")).agg((F.max("k") > 96).alias("any_hold"), F.count_if(F.col("kind") == "error").cast("int").alias("total_slips"))
    geo = geo.select("episode", F.struct(F.struct("any_hold", F.lit(False).alias("handover_detected"), "total_slips").alias("bimanual")).alias("features"))
    sinks.write_documents(geo, roots["geo"])
    return audit.fused_audit(*(read_traces(spark, roots[n], n, strict=True) for n in roots))


def trace_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three folders of traces, calibrated and fused: the whole audit from documents."""
    return rounded(_audit(spark, sf_dir).select(ep(), "label", "vlm_p_done_late", "seg_seg_score", "geo_any_hold", "geo_total_slips", "threshold", "fused_score", "pred_fused"))


def trace_audit_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three criteria of that audit against its labels."""
    # The scores take the audit several times over: its documents are read for it once.
    return rounded(audit.audit_scores(kept(_audit(spark, sf_dir), "audit")))


def trace_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces with the clip of their name; a clip is there for episodes without an error at their end."""
    root, clips = shared_folder(spark, "traces"), shared_folder(spark, "clips")
    docs = _vlm_documents(spark, sf_dir).drop("first_kind")
    sinks.write_documents(docs, root)
    last = frames(spark, sf_dir).groupBy("ep").agg(F.max_by("kind", "idx").alias("kind"), F.count("*").alias("n"))
    name = F.concat(F.col("ep").cast("string"), F.when(F.col("kind") == "view", ".avi").when(F.col("kind") == "click", ".txt").otherwise(".mp4"))
    sinks.write_files(last.filter("kind <> 'error'").select(name.alias("name"), F.repeat(F.lit("x"), F.col("n").cast("int")).alias("data")), clips)
    out = loading.clips_of(read_traces(spark, root, "vlm"), read_clips(spark, clips).drop("content"))
    return rounded(out.select(ep(), F.regexp_extract("path", r"[^/]+$", 0).alias("clip"), F.col("length").alias("n_bytes")))


def audit_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole audit records, nested, with NaN where a mean has no rows, dumped as JSON files and read back by their schema."""
    f = frames(spark, sf_dir)
    mean = lambda kind: F.coalesce(F.avg(F.when(F.col("kind") == kind, F.col("p"))), F.lit(float("nan")))
    per = f.groupBy(F.col("ep").cast("string").alias("episode")).agg(F.count("*").alias("n"), F.max("p").alias("most"), mean("view").alias("view"), mean("error").alias("error"), F.array_sort(F.collect_set("kind")).alias("kinds"))
    record = per.select("episode", F.struct(F.struct("view", "error").alias("means"), F.when(F.col("most") > 0.9, F.struct("most")).alias("peak")).alias("features"), "kinds", F.create_map(F.lit("n"), F.col("n")).alias("counts"))
    root = shared_folder(spark, "records")
    sinks.write_documents(record, root)
    back = gathered(spark.read.schema(record.schema).option("multiLine", True).option("mode", "FAILFAST").json(root))
    text = gathered(spark.read.text(root, wholetext=True)).select(F.array_join(F.regexp_extract_all("value", F.lit(r'"(\w+)":'), F.lit(1)), ",").alias("fields"), F.get_json_object("value", "$.episode").alias("episode"))
    out = back.join(text, "episode")
    return rounded(out.select(ep(), F.col("counts.n").alias("n"), "features.means.view", "features.means.error", "features.peak.most", F.array_join("kinds", ",").alias("kinds"), "fields"))


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts with what lies in their episode's folder: a trace for all, a log of the errors where there are any."""
    root = shared_folder(spark, "artifacts")
    f = frames(spark, sf_dir).groupBy(F.col("ep").cast("string").alias("episode")).agg(F.avg("p").alias("score"), F.count("*").cast("int").alias("n"), F.count_if(F.col("kind") == "error").cast("int").alias("bad"))
    trace = f.select(F.concat("episode", F.lit("/trace.json")).alias("name"), F.repeat(F.lit("t"), F.col("n")).alias("data"))
    log = f.filter("bad > 0").select(F.concat("episode", F.lit("/logs/errors.txt")).alias("name"), F.repeat(F.lit("e"), F.col("bad")).alias("data"))
    sinks.write_files(trace.unionByName(log), root)
    out = sinks.collect_artifacts(f.select("episode", tag_above("score", 0.6).alias("tag")), root)
    names = F.array_join(F.transform("artifacts", lambda a: F.regexp_extract(a["path"], r"([^/]+)$", 1)), ",")
    return rounded(out.select(ep(), "tag", names.alias("files"), F.aggregate("artifacts", F.lit(0).cast("bigint"), lambda s, a: s + a["length"]).alias("n_bytes")))


# --- models ----------------------------------------------------------------------------------------------------------
def frame_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model plugged in that reads a frame's k from its bytes and fails at those of errors with k under 5: curves of the
    episodes without such a frame, the fault of the others; and the prompt a frame was asked with."""

    class Model:
        def score_batch(self, tasks: list[str], images: list[bytes]) -> list[float]:
            if any(i.startswith(b"error:") and int(i[6:]) < 5 for i in images):
                raise ValueError("unreadable")
            return [int(i.rpartition(b":")[2]) / 100 + t.count("cup") for t, i in zip(tasks, images, strict=True)]

    task = scoring.short_prompt(scoring.fill_prompt("Look.\nIs {task} done?", F.when(F.col("ep") % 2 == 0, "a cup")))
    f = frames(spark, sf_dir).select(F.col("ep").alias("episode"), F.col("idx").alias("frame_idx"), task.alias("task"), F.concat("kind", F.lit(":"), F.col("k").cast("string")).cast("binary").alias("image"))
    out = scoring.frame_curves(scoring.score_frames(f, Model, name="exchange.frame_scores"))
    return rounded(out.select(ep(), F.size("p_yes").alias("n"), F.aggregate("p_yes", F.lit(0.0), lambda a, x: a + x).alias("total"), "error"))


def modes_in_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ship modes and parts of each return flag's line items: distinct values of a few hot groups."""
    l = table(spark, sf_dir, "lineitem").withColumn("ids", F.array("l_partkey", "l_suppkey"))
    out = ev.in_use(l, ["l_returnflag"], "l_linestatus", "ids")
    first = ev.distinct_values(l, ["l_returnflag"], "l_orderkey", first=7).select("l_returnflag", F.col("n").alias("n_orders"), F.array_join(F.transform("values", lambda v: v.cast("string")), ",").alias("first_orders"))
    return rounded(out.join(first, "l_returnflag").select("l_returnflag", F.array_join("modes", ",").alias("modes"), "n_tracks", "n_orders", "first_orders"))


# --- loading ---------------------------------------------------------------------------------------------------------
def bulk_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bulk frames as they are published, with images and poses of named columns, gathered into episodes."""
    root = shared_folder(spark, "bulk")
    pose = F.when(F.col("kind") != "error", F.array(F.col("value").cast("float"), F.col("k").cast("float")))
    image = F.struct(F.concat_ws("-", "kind", F.col("k").cast("string")).cast("binary").alias("bytes"), F.lit(None).cast("string").alias("path"))
    f = frames(spark, sf_dir).select(F.col("ep").cast("string").alias("episode"), (F.col("idx") * 3).cast("int").alias("frame"), image.alias("image"), pose.alias("left_obs_ee_pose"), F.lit(None).cast("array<float>").alias("right_obs_ee_pose"), pose.alias("obs_head_pose"), F.lit(None).cast("array<float>").alias("obs_eye_gaze"))
    f.write.parquet(root)
    bulk = read_bulk_frames(spark, root)
    named = bulk.select("episode", "frame", *(F.col(c).alias(n) for c, n in loading.pose_columns(bulk.columns).items()))
    poses = named.groupBy("episode").agg(F.count("`left.obs_ee_pose`").alias("n_left"), F.count("`right.obs_ee_pose`").alias("n_right"), F.sum(F.get("obs_head_pose", F.lit(1)).cast("double")).alias("head"))
    e = loading.bulk_episodes(bulk)
    n_bytes = F.aggregate("images", F.lit(0).cast("bigint"), lambda a, i: a + F.length(i["bytes"]))
    return rounded(e.select("episode", "total_frames", "fps", n_bytes.alias("n_bytes"), F.array_max("frames").alias("last")).join(poses, "episode").select(ep(), "total_frames", "fps", "n_bytes", "last", "n_left", "n_right", "head"))


def catalog_preset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog of episodes, and what two presets pick from it, in one call each."""
    root = shared_folder(spark, "catalog")
    table(spark, sf_dir, "part").select(F.col("p_brand").alias("embodiment"), F.lower("p_type").alias("task"), F.concat(F.lit("s3://b/"), F.col("p_partkey").cast("string")).alias("zarr_mp4_path")).write.parquet(root)
    catalog = {"cheap": [presets.contains_any("task", ["promo", "econ"]), presets.one_of("embodiment", ["Brand#3", "Brand#9", "Brand#13"])], "one": [presets.equals("embodiment", "Brand#24")]}
    parts = [read_preset(spark, root, catalog, n).withColumn("preset", F.lit(n)) for n in catalog]
    return parts[0].unionByName(parts[1]).select("preset", "embodiment", "task", "zarr_mp4_path")


def contact_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of a sheet of pictures, nine to a row, of each kind's frames of an episode."""
    out = sinks.contact_sheet(frames(spark, sf_dir).select("ep", "kind", "idx"), ["idx"], keys=["ep", "kind"], columns=9, width=64, height=48, pad=2)
    return rounded(out)


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict report's table in Markdown, a row per line: mean scores by kind and label of the first frame."""
    f = frames(spark, sf_dir)
    first = f.groupBy("ep").agg(F.min_by("kind", "idx").alias("first"))
    rows = f.join(first, "ep").groupBy("kind").agg(F.avg(F.when(F.col("first") == "view", F.col("p"))).alias("after_view"), F.avg(F.when(F.col("first") == "never", F.col("p"))).alias("never"), F.count("*").alias("n"))
    lines = list(sinks.markdown(rows.orderBy("kind"), ["kind", "after a view", "never", "frames"]))
    return rounded(spark.createDataFrame(list(enumerate(lines)), "line bigint, text string"))


QUERIES = {f.__name__: f for f in (
    store_arrays, store_range, store_blobs, store_resume, mask_sidecars, traces_lenient, traces_strict, model_traces, nested_tracks, trace_audit, trace_audit_scores, trace_clips, audit_documents, artifacts,
    frame_scores, modes_in_use, bulk_frames, catalog_preset, contact_cells, report_lines,
)}

_LABEL = "CASE first WHEN 'purchase' THEN 'success' WHEN 'signup' THEN 'failure' END"
_FIRST = "firsts AS (SELECT ep, arg_min(kind, idx) AS first FROM frames GROUP BY ep)"
_STATISTICS = f"""SELECT c.ep, {_LABEL} AS label, count(*) AS n, round(avg(p) FILTER (idx >= n - q), 6) AS p_done_late, round(max(p) FILTER (idx = n - 1), 6) AS p_done_final,
  round(max(p), 6) AS p_done_max, round(avg(p) FILTER (idx >= n - q) - avg(p) FILTER (idx < q), 6) AS p_done_rise FROM counted c JOIN firsts f ON c.ep = f.ep"""
_ARRAYS = """SELECT ep, 'p' AS "array", idx, round(p, 6) AS a, CAST(NULL AS DOUBLE) AS b FROM frames UNION ALL SELECT ep, 'reading', idx, value, k::DOUBLE FROM frames
  UNION ALL SELECT ep, 'left.obs_pose', idx, CASE WHEN kind <> 'error' THEN round(p, 6) END, NULL FROM frames WHERE ep IN (SELECT ep FROM frames WHERE kind <> 'error')"""
_PLACED = f"""{SEG}, v AS (SELECT ep, idx, bx, by_ FROM boxes WHERE bx IS NOT NULL), z AS (SELECT ep, arg_max(bx, idx) AS zx, arg_max(by_, idx) AS zy FROM v GROUP BY ep),
l AS (SELECT b.ep, b.idx, b.n, b.q, b.kind <> 'error' AS there, b.cx, b.cy, coalesce(v.bx, z.zx) AS x, coalesce(v.by_, z.zy) AS y
      FROM boxes b ASOF LEFT JOIN v ON b.ep = v.ep AND b.idx >= v.idx LEFT JOIN z ON b.ep = z.ep),
placed AS (SELECT ep, max(n) AS n, avg(CASE WHEN there THEN 1.0::DOUBLE ELSE 0.0 END) AS present, avg(CASE WHEN there AND cx BETWEEN x - 90 AND x + 90 AND cy BETWEEN y - 90 AND y + 90 THEN 1.0::DOUBLE ELSE 0.0 END) AS s FROM l WHERE idx >= n - q GROUP BY ep)"""
_AUDIT = f"""{COUNTED}, {LATE}, {_FIRST}, {_PLACED}, t AS (SELECT quantile_cont(late, 0.5) AS t FROM late),
  holds AS (SELECT ep, max(k) > 96 AS any_hold, count(*) FILTER (kind = 'error') AS slips FROM frames GROUP BY ep),
  joined AS (SELECT late.ep, {_LABEL} AS label, late, s, any_hold, slips, t, ((CASE WHEN late > t THEN 0.5 ELSE 0.0 END) + 0.5 * least(1.0, late / (2 * t)) + s) / 2 AS mean
             FROM late JOIN placed p ON late.ep = p.ep JOIN holds h ON late.ep = h.ep JOIN firsts f ON late.ep = f.ep, t),
  audit AS (SELECT *, CASE WHEN any_hold THEN mean ELSE 0.0 END AS fused FROM joined)"""

ORACLE_SQL = {
    "store_arrays": f"WITH {FRAMES} {_ARRAYS}",
    "store_range": f"WITH {FRAMES}, a AS ({_ARRAYS}) SELECT * FROM a WHERE a.array = 'reading' AND idx BETWEEN 20 AND 44",
    "store_blobs": "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, sha256(coalesce(text, '')) AS sha FROM conversations",
    "store_resume": """WITH t AS (SELECT conv_id, count(*) AS n, list(turn ORDER BY turn) AS turns, bool_or(role = 'system') AS late FROM conversations GROUP BY conv_id)
      SELECT conv_id, n AS total_frames, round(30.0 / greatest(1, CASE WHEN n > 1 THEN turns[2] - turns[1] ELSE 30 END), 6)::DOUBLE AS fps, CASE WHEN late THEN 'second' ELSE 'first' END AS source, true AS complete FROM t""",
    "mask_sidecars": f"""WITH {FRAMES}, s AS (SELECT ep, kind, max(k) + 1 AS height, max(idx) + 1 AS width FROM frames GROUP BY 1, 2),
      bits AS (SELECT DISTINCT f.ep, f.kind, k, idx, k * width + idx AS place FROM frames f JOIN s ON f.ep = s.ep AND f.kind = s.kind WHERE p > 0.9),
      lit AS (SELECT ep, kind, place // 8 AS b, CAST(sum(1 << CAST(7 - place % 8 AS INT)) AS INT) AS v FROM bits GROUP BY 1, 2, 3),
      packed AS (SELECT s.ep, s.kind, height, width, (height * width + 7) // 8 AS n, string_agg(printf('%02X', coalesce(v, 0)), '' ORDER BY x.b) AS hex
                 FROM (SELECT *, unnest(range((height * width + 7) // 8)) AS b FROM s) x JOIN s USING (ep, kind, height, width) LEFT JOIN lit ON lit.ep = x.ep AND lit.kind = x.kind AND lit.b = x.b GROUP BY ALL),
      areas AS (SELECT ep, kind, count(*) AS area, avg(idx) AS cx, avg(k) AS cy FROM bits GROUP BY 1, 2)
      SELECT p.ep, p.kind, CAST(height AS BIGINT) AS height, width, CAST(coalesce(sum(n) OVER (PARTITION BY p.ep ORDER BY p.kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS mask_offset, CAST(n AS BIGINT) AS mask_nbytes,
        sha256(unhex(hex)) AS sha, coalesce(area, 0) AS area, round(cx, 6) AS centroid_x, round(cy, 6) AS centroid_y FROM packed p LEFT JOIN areas a ON p.ep = a.ep AND p.kind = a.kind""",
    "traces_lenient": f"WITH {COUNTED}, {_FIRST} {_STATISTICS} WHERE first <> 'error' GROUP BY c.ep, first",
    "traces_strict": f"WITH {COUNTED}, {_FIRST} {_STATISTICS} GROUP BY c.ep, first",
    "model_traces": f"""WITH {FRAMES}, m AS (SELECT ep, kind, p, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY ep, kind) AS n FROM frames WINDOW w AS (PARTITION BY ep, kind ORDER BY idx)),
      s AS (SELECT ep, kind AS model, max(n) AS n, avg(p) FILTER (i >= n - greatest(1, n // 4)) AS late FROM m GROUP BY 1, 2)
      SELECT ep, model, n, round(late, 6) AS p_done_late, CASE WHEN late > 0.6 THEN 'success' ELSE 'failure' END AS tag FROM s""",
    "nested_tracks": f"""WITH {COUNTED}, {_PLACED}, t AS (SELECT ep, count(DISTINCT k % 3) + 1 AS ids FROM frames GROUP BY ep)
      SELECT p.ep, n, true AS saucer_tracked, round(present, 6) AS cup_present_end, round(s, 6) AS cup_on_saucer, round(s, 6) AS seg_score, 'cup_on_saucer' AS seg_mode, ids AS cup_track_ids FROM placed p JOIN t ON p.ep = t.ep""",
    "trace_audit": f"""WITH {_AUDIT}
      SELECT ep, label, round(late, 6) AS vlm_p_done_late, round(s, 6) AS seg_seg_score, any_hold AS geo_any_hold, slips AS geo_total_slips, round(t, 6) AS threshold, round(fused, 6) AS fused_score,
        CASE WHEN fused >= 0.5 THEN 'success' ELSE 'failure' END AS pred_fused FROM audit""",
    "trace_audit_scores": f"""WITH {_AUDIT}, x AS (
        SELECT 'vlm' AS criterion, label, CASE WHEN late > t THEN 'success' ELSE 'failure' END AS pred, late AS score FROM audit UNION ALL
        SELECT 'seg', label, CASE WHEN s >= 0.5 THEN 'success' ELSE 'failure' END, s FROM audit UNION ALL SELECT 'fused', label, CASE WHEN fused >= 0.5 THEN 'success' ELSE 'failure' END, fused FROM audit),
      y AS (SELECT * FROM x WHERE label IS NOT NULL), a AS (SELECT criterion, count(*) AS n, avg(CASE WHEN pred = label THEN 1.0::DOUBLE ELSE 0.0 END) AS accuracy FROM y GROUP BY 1),
      c AS (SELECT p.criterion, avg(CASE WHEN p.score > q.score THEN 1.0::DOUBLE WHEN p.score = q.score THEN 0.5 ELSE 0.0 END) AS auroc FROM y p JOIN y q ON p.criterion = q.criterion AND p.label = 'success' AND q.label = 'failure' GROUP BY 1)
      SELECT a.criterion, n, round(accuracy, 6) AS accuracy, round(auroc, 6) AS auroc FROM a LEFT JOIN c ON a.criterion = c.criterion""",
    "trace_clips": f"""WITH {FRAMES}, l AS (SELECT ep, arg_max(kind, idx) AS kind, count(*) AS n FROM frames GROUP BY ep)
      SELECT ep, CASE kind WHEN 'error' THEN NULL WHEN 'click' THEN NULL WHEN 'view' THEN ep || '.avi' ELSE ep || '.mp4' END AS clip, CASE WHEN kind IN ('error', 'click') THEN NULL ELSE n END AS n_bytes FROM l""",
    "audit_documents": f"""WITH {FRAMES} SELECT ep, count(*) AS n, round(avg(p) FILTER (kind = 'view'), 6) AS view, round(avg(p) FILTER (kind = 'error'), 6) AS error,
      CASE WHEN max(p) > 0.9 THEN round(max(p), 6) END AS most, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds,
      'counts,n,episode,features,means,error,view,peak,' || CASE WHEN max(p) > 0.9 THEN 'most,' ELSE '' END || 'kinds' AS fields FROM frames GROUP BY ep""",
    "artifacts": f"""WITH {FRAMES} SELECT ep, CASE WHEN avg(p) > 0.6 THEN 'success' ELSE 'failure' END AS tag, CASE WHEN count(*) FILTER (kind = 'error') > 0 THEN 'errors.txt,trace.json' ELSE 'trace.json' END AS files,
      count(*) + count(*) FILTER (kind = 'error') AS n_bytes FROM frames GROUP BY ep""",
    "frame_scores": f"""WITH {FRAMES}, e AS (SELECT ep, bool_or(kind = 'error' AND k < 5) AS bad, count(*) AS n, sum(k / 100.0) + CASE WHEN ep % 2 = 0 THEN count(*) ELSE 0 END AS total FROM frames GROUP BY ep)
      SELECT ep, CASE WHEN NOT bad THEN n END AS n, CASE WHEN NOT bad THEN round(total, 6) END AS total, CASE WHEN bad THEN 'ValueError: unreadable' END AS error FROM e""",
    "modes_in_use": """WITH o AS (SELECT DISTINCT l_returnflag, l_orderkey FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey) AS rn FROM o),
      t AS (SELECT l_returnflag, count(DISTINCT id) AS n_tracks FROM (SELECT l_returnflag, l_partkey AS id FROM lineitem UNION ALL SELECT l_returnflag, l_suppkey FROM lineitem) GROUP BY 1),
      m AS (SELECT l_returnflag, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS modes FROM lineitem GROUP BY 1)
      SELECT r.l_returnflag, max(modes) AS modes, max(n_tracks) AS n_tracks, count(*) AS n_orders, string_agg(CAST(l_orderkey AS VARCHAR), ',' ORDER BY l_orderkey) FILTER (rn <= 7) AS first_orders
      FROM r JOIN t ON r.l_returnflag = t.l_returnflag JOIN m ON r.l_returnflag = m.l_returnflag GROUP BY 1""",
    "bulk_frames": f"""WITH {FRAMES} SELECT ep, count(*) AS total_frames, CASE WHEN count(*) > 1 THEN 10.0 ELSE 1.0 END::DOUBLE AS fps, CAST(sum(strlen(kind || '-' || k)) AS BIGINT) AS n_bytes, 3 * max(idx) AS last,
      count(*) FILTER (kind <> 'error') AS n_left, CAST(0 AS BIGINT) AS n_right, round(sum(k::DOUBLE) FILTER (kind <> 'error'), 6) AS head FROM frames GROUP BY ep""",
    "catalog_preset": """WITH c AS (SELECT p_brand AS embodiment, lower(p_type) AS task, 's3://b/' || p_partkey AS zarr_mp4_path FROM part)
      SELECT 'cheap' AS preset, * FROM c WHERE regexp_matches(task, 'promo|econ') AND embodiment IN ('Brand#3', 'Brand#9', 'Brand#13') UNION ALL SELECT 'one', * FROM c WHERE embodiment = 'Brand#24'""",
    "contact_cells": f"""WITH {FRAMES}, c AS (SELECT ep, kind, idx, row_number() OVER (PARTITION BY ep, kind ORDER BY idx) - 1 AS i FROM frames)
      SELECT ep, kind, idx, i // 9 AS grid_row, i % 9 AS grid_col, (i % 9) * 66 + 2 AS x, (i // 9) * 50 + 2 AS y FROM c""",
    "report_lines": f"""WITH {FRAMES}, {_FIRST}, r AS (SELECT kind, avg(p) FILTER (first = 'view') AS a, count(*) AS n FROM frames f JOIN firsts s ON f.ep = s.ep GROUP BY kind)
      SELECT 0 AS line, '| kind | after a view | never | frames |' AS text UNION ALL SELECT 1, '|---|---|---|---|'
      UNION ALL SELECT 1 + row_number() OVER (ORDER BY kind), '| ' || kind || ' | ' || coalesce(printf('%.2f', a), '—') || ' | — | ' || n || ' |' FROM r""",
}
