"""Documents, files and artefacts; scoring frame by frame; statistics of a sequence so far; distinct values of hot groups."""

import json
import math

import pytest
from pyspark.sql import functions as F

from reelmark.operators import evaluation as ev
from reelmark.operators import scoring
from reelmark.operators import sequence as seq
from reelmark.plans import audit
from reelmark.sources import read_traces, sinks

RECORD = "episode string, score double, found array<struct<b:double,a:int>>, by map<string,double>, blob binary, record struct<z:float,a:string,deep:struct<y:boolean,x:array<double>>>"


def records(spark):
    return spark.createDataFrame(
        [("e1", math.nan, [(math.inf, 1), (0.5, None)], {"b": 1.0, "a": math.nan}, b"\x00\xff", (1.5, 'say "x"\n', (True, [1.0, None, math.nan]))), ("e2", None, None, None, None, None), ("é3", 0.25, [], {}, b"", (None, None, None))],
        RECORD,
    )


def test_documents(spark):
    got = {r["episode"]: r["document"] for r in sinks.documents(records(spark)).collect()}
    first = json.loads(got["e1"])
    assert first == {"episode": "e1", "score": None, "found": [{"a": 1, "b": None}, {"a": None, "b": 0.5}], "by": {"a": None, "b": 1.0}, "blob": "AP8=", "record": {"a": 'say "x"\n', "deep": {"x": [1.0, None, None], "y": True}, "z": 1.5}}
    assert list(first) == sorted(first) and list(first["by"]) == ["a", "b"] and list(first["record"]) == ["a", "deep", "z"]
    assert json.loads(got["e2"]) == dict.fromkeys(first) | {"episode": "e2"}
    assert sinks.documents(records(spark).select("record", "by", "episode", "blob", "score", "found")).filter("episode = 'e1'").first()["document"] == got["e1"]
    back = sinks.documents(records(spark)).select(F.from_json("document", RECORD.replace("blob binary", "blob string")).alias("r")).select("r.*")
    assert {r["episode"]: (r["score"], r["by"], r["record"] and r["record"]["z"]) for r in back.collect()} == {"e1": (None, {"a": None, "b": 1.0}, 1.5), "e2": (None, None, None), "é3": (0.25, {}, None)}


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([("a.txt", "é"), ("sub/b.txt", "x"), ("none.txt", None)], "name string, data string")
    assert sinks.write_files(rows, str(tmp_path / "out")) == 3 == sinks.write_files(rows, str(tmp_path / "out"))
    assert {str(p.relative_to(tmp_path / "out")): p.read_text() for p in (tmp_path / "out").rglob("*") if p.is_file()} == {"a.txt": "é", "sub/b.txt": "x", "none.txt": ""}
    assert sinks.write_files(rows.limit(0), str(tmp_path / "empty")) == 0
    assert sinks.write_documents(spark.createDataFrame([("e 1+%", [0.5], b"x")], "episode string, p_yes array<double>, blob binary"), str(tmp_path / "docs")) == 1
    r = read_traces(spark, str(tmp_path / "docs"), "vlm", strict=True).first()
    assert (r["episode"], r["p_yes"]) == ("e 1+%", [0.5])


def test_no_attempt_is_left(spark, tmp_path):
    """A file whose name is taken by a folder fails the job, and its attempt goes; what other tasks wrote is whole."""
    (tmp_path / "out" / "taken" / "inside").mkdir(parents=True)
    with pytest.raises(Exception, match="taken"):
        sinks.write_files(spark.createDataFrame([("taken", "x")], "name string, data string").coalesce(1), str(tmp_path / "out"))
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["taken"]


def test_tasks_of_small_files(spark, tmp_path):
    """Spark makes a task of every 32 small files; the readers take many of these in one, and lose no file."""
    cores = spark.sparkContext.defaultParallelism
    for k in range(128 * cores):
        (tmp_path / f"e{k}.json").write_text('{"p_yes": [0.5], "task_name": "x_success"}')
    for strict in (True, False):
        rows = read_traces(spark, str(tmp_path), "vlm", strict=strict)
        assert rows.rdd.getNumPartitions() <= 2 * cores
        assert tuple(rows.agg(F.count_distinct("episode"), F.count_if(F.col("label") == "success"), F.sum(F.get("p_yes", F.lit(0)))).first()) == (128 * cores, 128 * cores, 64.0 * cores)


def test_lenient_documents_of_many_lines(spark, tmp_path):
    """A document is its whole file: of several lines, with a byte order mark; half a document is left out."""
    text = json.dumps({"p_yes": [0.5], "task_name": "x_success"}, indent=1)
    for name, data in (("lines", text), ("crlf", text.replace("\n", "\r\n")), ("mark", "\ufeff" + text), ("half", text[:20]), ("none", "")):
        (tmp_path / f"{name}.json").write_bytes(data.encode())
    got = {(r["episode"], *r["p_yes"], r["label"]) for r in read_traces(spark, str(tmp_path), "vlm").collect()}
    assert got == {(name, 0.5, "success") for name in ("lines", "crlf", "mark")}


def test_artifacts(spark, tmp_path):
    for name, data in (("e1/m.bin", b"xyz"), ("e1/log/a.txt", b"12"), ("e2/m.bin", b"1"), ("top.txt", b"1")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    verdicts = spark.createDataFrame([("e1", "success"), ("e2", None), ("e3", "failure")], "episode string, tag string")
    for folder in (str(tmp_path), "file://" + str(tmp_path) + "/"):
        got = {r["episode"]: (r["tag"], [(x["path"].rpartition(str(tmp_path) + "/")[2], x["length"]) for x in r["artifacts"]]) for r in sinks.collect_artifacts(verdicts, folder).collect()}
        assert got == {"e1": ("success", [("e1/log/a.txt", 2), ("e1/m.bin", 3)]), "e2": (None, [("e2/m.bin", 1)]), "e3": ("failure", [])}


def models():
    """Made here, so that workers get the classes themselves."""

    class Lengths:
        """A frame's length; fails at the image b"bad"."""

        def score(self, task, images):
            if b"bad" in images:
                raise RuntimeError("a bad image")
            return [len(x) / 10 + len(task) for x in images]

    class Batches(Lengths):
        def score_batch(self, tasks, images):
            assert len(tasks) == len(images) <= 4
            return [p for t, x in zip(tasks, images, strict=True) for p in self.score(t, [x])]

    return Lengths, Batches


@pytest.mark.parametrize("which", [0, 1])
@pytest.mark.parametrize("batch", [1, 4])
def test_scoring_frames(spark, which, batch):
    make = models()[which]
    rows = [(f"e{e}", k, "go" if e % 2 else None, b"x" * (k % 5)) for e in range(9) for k in range(e)]
    rows += [("bad", k, "t", b"bad" if k == 3 else b"xx") for k in range(7)] + [("none", k, "t", None if k == 1 else b"xx") for k in range(3)]
    df = spark.createDataFrame(rows[::-1], "episode string, frame_idx int, task string, image binary").coalesce(1)
    frames = {(r["episode"], r["frame_idx"]): (r["p_yes"], r["error"]) for r in scoring.score_frames(df, make, name=f"{which}", batch=batch).collect()}
    assert set(frames) == {r[:2] for r in rows}
    for (e, k), (p, error) in frames.items():
        if e in ("bad", "none"):
            assert (p is None) == (error is not None) and (error is None or k >= (0 if batch > 1 else 3 if e == "bad" else 1)) and (k < (3 if e == "bad" else 1) or error)
        else:
            assert error is None and p == (k % 5) / 10 + (2 if int(e[1:]) % 2 else 0)
    curves = {r["episode"]: (r["p_yes"], r["error"]) for r in scoring.frame_curves(scoring.score_frames(df, make, name=f"{which}", batch=batch)).collect()}
    assert curves["bad"] == (None, "RuntimeError: a bad image") and curves["none"] == (None, "ValueError: a frame without image")
    assert curves["e6"] == ([k % 5 / 10 for k in range(6)], None)


def test_a_hundred_thousand_frames_of_one_episode(spark):
    """A model sees 32 frames at a time, and the worker's memory does not grow with the episode: 500 MB of images pass."""

    class Peak:
        def __init__(self):
            self.low = None

        def score(self, task, images):
            import resource

            assert len(images) <= 32
            now = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
            self.low = now if self.low is None else self.low
            return [now - self.low] * len(images)

    df = spark.range(100_000).select(F.lit("long").alias("episode"), F.col("id").alias("frame_idx"), F.lit("t").alias("task"), F.encode(F.repeat(F.lit("image"), F.lit(1000)), "utf-8").alias("image"))
    r = scoring.score_frames(df, Peak, name="peak").agg(F.count("*"), F.max("p_yes"), F.count("error")).first()
    assert r[0] == 100_000 and r[2] == 0 and r[1] < 250


def test_so_far(spark):
    df = spark.createDataFrame([("a", 0, 2.0), ("a", 1, None), ("a", 2, 1.0), ("b", 0, None)], "ep string, idx int, v double")
    got = [tuple(r["so_far"]) for r in seq.prefix_statistics(df, ["ep"], "idx", "v").orderBy("ep", "idx").collect()]
    assert got == [(1, 2.0, 2.0, 2.0, 2.0, 2.0), (1, 2.0, 2.0, 2.0, 2.0, 2.0), (2, 3.0, 1.5, 1.0, 2.0, 2.0), (0, None, None, None, None, None)]
    assert [r["trace"] for r in seq.prefix_trace(df.filter("v is not null"), ["ep"], "idx", "v", last=1).orderBy("idx").collect()] == [[2.0], [1.0]]
    n = 100_000
    long = spark.range(n).select(F.lit("e").alias("ep"), F.col("id").alias("idx"), (F.col("id") % 7).cast("double").alias("v"))
    r = seq.prefix_statistics(long, ["ep"], "idx", "v").agg(F.max("so_far.n"), F.max("so_far.total"), F.sum("so_far.most")).first()
    assert tuple(r) == (n, float(sum(k % 7 for k in range(n))), float(sum(min(k, 6) for k in range(n))))
    assert seq.prefix_trace(long, ["ep"], "idx", "v", last=5).agg(F.max(F.size("trace"))).first()[0] == 5


def test_distinct_values_of_a_hot_group(spark):
    df = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("g"), F.col("id") % 50)).alias("g"), F.when(F.col("id") % 11 != 0, F.col("id") % 20_000).alias("v"))
    want = {}
    for r in df.collect():
        want.setdefault(r["g"], set()).add(r["v"])
    for first in (None, 5):
        got = {r["g"]: (r["n"], r["values"]) for r in ev.distinct_values(df, ["g"], "v", first=first).collect()}
        assert got == {g: (len(v - {None}), sorted(v - {None})[:first]) for g, v in want.items()}
    assert tuple(ev.distinct_values(df, [], "v", first=2).first()) == (len(set().union(*want.values()) - {None}), [0, 1])
    assert tuple(ev.distinct_values(df.limit(0), [], "v").first())[1] == []
    t = df.select("g", F.concat(F.lit("m"), F.col("v") % 3).alias("mode"), F.array(F.col("v"), F.col("v") + 1, F.lit(None)).alias("ids"))
    got = {r["g"]: (r["modes"], r["n_tracks"]) for r in ev.in_use(t, ["g"], "mode", "ids").collect()}
    assert got == {g: (["m0", "m1", "m2"], len({x for y in v if y is not None for x in (y, y + 1)})) for g, v in want.items()}
    rows = spark.createDataFrame([(f"e{k}", False, "success" if k % 2 else None) for k in range(9)], "episode string, geo_any_hold boolean, label string")
    assert tuple(audit.vetoes(rows, first=3).first()) == (4, ["e1", "e3", "e5"])
