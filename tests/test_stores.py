"""Episode stores: arrays as other writers lay them out, round trips, what is opened, and writes that fail."""

import gzip
import json
import math
import random

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from reelmark.operators.loading import skip_completed
from reelmark.sources import read_episode_store
from reelmark.sources.stores import EpisodeReader, StoredArray, Wanted, file_system, read_arrays, write_store


def put(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data if isinstance(data, bytes) else json.dumps(data).encode())


def array_document(shape, chunk, kind, codecs, fill=0, separator="/"):
    return {"zarr_format": 3, "node_type": "array", "shape": shape, "data_type": kind, "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": chunk}}, "chunk_key_encoding": {"name": "default", "configuration": {"separator": separator}}, "fill_value": fill, "codecs": codecs}


BYTES = {"name": "bytes", "configuration": {"endian": "little"}}


def store_array(folder, data, chunk, codecs, encode, separator="/"):
    """Writes an array the plain way; encode turns a whole chunk into bytes."""
    put(folder / "zarr.json", array_document(list(data.shape), chunk, data.dtype.name, codecs, separator=separator))
    for place in np.ndindex(*(-(-n // c) for n, c in zip(data.shape, chunk, strict=True))):
        block = np.zeros(chunk, data.dtype)
        own = data[tuple(slice(p * c, (p + 1) * c) for p, c in zip(place, chunk, strict=True))]
        block[tuple(slice(0, n) for n in own.shape)] = own
        put(folder / "c" / separator.join(map(str, place)) if separator == "/" else folder / ("c" + separator + separator.join(map(str, place))), encode(block))


@pytest.fixture
def store(tmp_path):
    rng = np.random.default_rng(3)
    data = {"e1": {}, "e2": {}}
    for e, n in (("e1", 23), ("e2", 7)):
        at = tmp_path / "store" / e
        put(at / "zarr.json", {"zarr_format": 3, "node_type": "group", "attributes": {"total_frames": n, "task_name": "cup_success"}})
        longer = n + 3  # arrays may be longer than the episode
        data[e]["pose"] = rng.random((longer, 7)).astype("float32")
        store_array(at / "pose", data[e]["pose"], [5, 4], [BYTES, {"name": "zstd", "configuration": {"level": 0}}], lambda b: zstandard.compress(b.tobytes()))
        data[e]["grip"] = rng.integers(-9, 9, longer).astype("int16")
        store_array(at / "grip", data[e]["grip"], [10], [{"name": "bytes", "configuration": {"endian": "big"}}, {"name": "gzip", "configuration": {"level": 5}}], lambda b: gzip.compress(b.astype(">i2").tobytes()), separator=".")
        data[e]["turn"] = rng.random((longer, 2, 3))
        store_array(at / "turn", data[e]["turn"], [4, 2, 3], [{"name": "transpose", "configuration": {"order": [2, 0, 1]}}, BYTES, {"name": "crc32c"}], lambda b: b.transpose(2, 0, 1).tobytes() + b"\0\0\0\0")
        # Shards of 8 rows, chunks of 2, the index behind them.
        data[e]["sharded"] = rng.random((longer, 2))
        inner = {"chunk_shape": [2, 2], "codecs": [BYTES], "index_codecs": [BYTES, {"name": "crc32c"}], "index_location": "end"}

        def shard(b):
            parts, index, at_ = [], [], 0
            for k in range(4):
                raw = b[2 * k : 2 * k + 2].tobytes()
                if not np.any(b[2 * k : 2 * k + 2]):
                    index += [2**64 - 1, 2**64 - 1]
                    continue
                parts.append(raw)
                index += [at_, len(raw)]
                at_ += len(raw)
            return b"".join(parts) + np.array(index, "<u8").tobytes() + b"\0\0\0\0"

        store_array(at / "sharded", data[e]["sharded"], [8, 2], [{"name": "sharding_indexed", "configuration": inner}], shard)
        put(at / "notes" / "readme.txt", b"no array")
    put(tmp_path / "store" / "other" / "file.txt", b"no episode")
    return tmp_path / "store", data, {"e1": 23, "e2": 7}


def test_arrays_of_other_writers(spark, store):
    root, data, frames = store
    got = {(r["episode"], r["array"], r["frame_idx"]): r["value"] for r in read_arrays(spark, str(root)).collect()}
    want = {(e, a, k): x[k].astype(float).ravel().tolist() for e, own in data.items() for a, x in own.items() for k in range(frames[e])}
    assert got == want
    assert read_arrays(spark, str(root), blobs=True).count() == 0
    blocks = read_arrays(spark, "file://" + str(root), frames_a_task=4)
    assert {(r["episode"], r["array"], r["frame_idx"]): r["value"] for r in blocks.collect()} == want
    assert blocks.rdd.getNumPartitions() == 6 + 2


def test_a_store_one_folder_down_and_none(spark, store, tmp_path):
    root, data, frames = store
    (tmp_path / "outer").mkdir()
    root.rename(tmp_path / "outer" / "b")
    put(tmp_path / "outer" / "a" / "x" / "y.txt", b"")
    assert read_arrays(spark, str(tmp_path / "outer")).select("episode").distinct().count() == 2
    assert read_arrays(spark, str(tmp_path / "nothing")).count() == 0


def test_only_what_is_asked_for_is_opened(spark, store):
    """Everything else is damaged."""
    root, data, frames = store
    for f in root.rglob("*"):
        if f.is_file() and not (f.parent.name == "e1" or f.name == "zarr.json" and f.parent.name == "pose" or "e1/pose/c/2" in str(f)):
            f.write_bytes(b"damaged")
    df = read_arrays(spark, str(root))
    got = df.filter("episode = 'e1' and array in ('pose') and frame_idx >= 10 and frame_idx < 15 and value[0] > -1").collect()
    assert {r["frame_idx"]: r["value"] for r in got} == {k: data["e1"]["pose"][k].astype(float).tolist() for k in range(10, 15)}
    assert df.filter("episode = 'e1' and array = 'pose' and frame_idx > 100").count() == 0
    assert df.filter("episode = 'e3'").count() == 0


def test_chunks_of_a_range(store):
    root, data, _ = store
    at, path = file_system(str(root))
    for name, rows, chunks in (("pose", (5, 10), 2), ("pose", (4, 6), 4), ("grip", (0, 1), 1), ("sharded", (6, 10), 2), ("turn", (25, 99), 1), ("turn", (40, 50), 0)):
        a = StoredArray(at, f"{path}/e1/{name}", json.loads((root / "e1" / name / "zarr.json").read_text()))
        got = [v for _, v in a.rows(*rows)]
        whole = data["e1"][name][rows[0] : rows[1]]
        assert a.opened == chunks and np.array_equal(np.concatenate(got) if got else np.zeros((0, 1)), whole.reshape(len(whole), -1) if len(whole) else np.zeros((0, 1)))
    (root / "e1" / "pose" / "c" / "0" / "0").unlink()  # a chunk that is not there holds the fill value
    assert next(a for _, a in StoredArray(at, f"{path}/e1/pose", json.loads((root / "e1" / "pose" / "zarr.json").read_text())).rows(0, 2))[0, :4].tolist() == [0, 0, 0, 0]
    with pytest.raises(ValueError, match="not read"):
        StoredArray(at, path, array_document([1], [1], "complex64", [BYTES]))


def test_filters_are_told_apart():
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual, Not

    w = Wanted()
    kept = [f for f in (EqualTo(("episode",), "a"), In(("episode",), ("a", "b")), GreaterThan(("frame_idx",), 3), LessThanOrEqual(("frame_idx",), 9), Not(EqualTo(("array",), "x")), EqualTo(("value",), 1)) if not w.take(f)]
    assert (w.episodes, w.arrays, w.first, w.last) == ({"a"}, None, 4, 10) and len(kept) == 2
    assert EpisodeReader({"path": "/x"}).wanted.last == math.inf


SCHEMA = "episode string, frame_idx int, task_name string, image binary, pose array<double>, grip double, nothing array<double>"


def frames_of(rng, episodes):
    rows = []
    for e, n in episodes.items():
        rows += [(e, 3 * k, f"task {e}", bytes(rng.randrange(256) for _ in range(rng.randrange(0, 40))), [rng.random() for _ in range(rng.randrange(2, 4))], rng.random() if k else None, None) for k in range(n)]
    rng.shuffle(rows)
    return rows


def test_round_trip(spark, tmp_path):
    rows = frames_of(random.Random(1), {"a": 1, "b": 40, "c d": 9})
    root = str(tmp_path / "out")
    write_store(spark.createDataFrame(rows, SCHEMA), root, attributes=["task_name"], chunk=8)
    rows.sort(key=lambda r: r[:2])
    of = {e: [r for r in rows if r[0] == e] for e in ("a", "b", "c d")}
    images = {(r["episode"], r["frame_idx"]): bytes(r["value"]) for r in read_arrays(spark, root, blobs=True).collect()}
    assert images == {(e, k): r[3] for e, own in of.items() for k, r in enumerate(own)}
    numbers = read_arrays(spark, root).collect()
    for r in numbers:
        row = of[r["episode"]][r["frame_idx"]]
        width = max(len(x[4]) for x in of[r["episode"]])
        want = [row[4][k] if k < len(row[4]) else None for k in range(width)] if r["array"] == "pose" else [row[5]]
        assert [None if math.isnan(x) else x for x in r["value"]] == want
    assert {r["array"] for r in numbers} == {"pose", "grip"} and len(numbers) == 99  # no number, no array: the grip of a
    attributes = {r["episode"]: r for r in read_episode_store(spark, root).collect()}
    assert {e: (r["total_frames"], r["fps"], r["task_name"], r["complete"]) for e, r in attributes.items()} == {"a": (1, 1.0, "task a", True), "b": (40, 10.0, "task b", True), "c d": (9, 10.0, "task c d", True)}
    # New rows of an episode replace it; the others stay, but with overwrite.
    write_store(spark.createDataFrame([r[:3] + (b"new", [1.0], 2.0, None) for r in of["a"]], SCHEMA), root, attributes=["task_name"])
    assert read_arrays(spark, root, blobs=True).filter("episode = 'a'").collect()[0]["value"] == b"new"
    assert read_episode_store(spark, root).count() == 3
    write_store(spark.createDataFrame(of["b"], SCHEMA), root, attributes=["task_name"], overwrite=True)
    assert [r["episode"] for r in read_episode_store(spark, root).collect()] == ["b"]
    with pytest.raises(Exception, match="task_name is neither"):
        write_store(spark.createDataFrame(of["b"], SCHEMA), root)


def test_a_fault_leaves_other_episodes_complete(spark, tmp_path):
    """An image without bytes: the episode is not there, all others are; the second run loads it alone."""
    good = frames_of(random.Random(2), {f"e{k}": 6 for k in range(12)})
    bad = [r if r[:2] != ("e5", 9) else r[:3] + (None,) + r[4:] for r in good] + [("a/b", 0, "", b"", [1.0], 1.0, None)]
    root = str(tmp_path / "out")
    with pytest.raises(Exception, match="e5: frame 9 has no image"):
        write_store(spark.createDataFrame(bad, SCHEMA), root, attributes=["task_name"])
    done = read_episode_store(spark, root)
    assert {r["episode"] for r in done.filter("complete").collect()} == {f"e{k}" for k in range(12) if k != 5}
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith("_")]
    todo = skip_completed(spark.createDataFrame(good, SCHEMA), done, "episode", complete="complete")
    assert {r["episode"] for r in todo.collect()} == {"e5"}
    write_store(todo, root, attributes=["task_name"])
    assert read_episode_store(spark, root).filter("complete").count() == 12


def test_a_task_that_fails(spark, tmp_path):
    """Rows that can't be made: what other tasks have ended with is whole and marked, the task's own episodes are not there."""
    rows = frames_of(random.Random(3), {f"e{k}": 5 for k in range(16)})
    root = str(tmp_path / "out")
    write_store(spark.createDataFrame([r for r in rows if r[0] == "e0"], SCHEMA).drop("task_name"), root)  # from an earlier run
    df = spark.createDataFrame([r for r in rows if r[0] != "e0"], SCHEMA).drop("task_name")

    @F.udf("double")
    def late(episode, value):
        import time

        if episode == "e3":
            time.sleep(4)
            raise RuntimeError("no grip")
        return value

    broken = df.repartition(4, "episode").sortWithinPartitions("episode", "frame_idx").withColumn("grip", late("episode", "grip"))
    with pytest.raises(Exception, match="no grip"):
        broken.write.format("episode_store").mode("append").save(root)
    own = {r["episode"] for r in broken.withColumn("p", F.spark_partition_id()).filter("episode = 'e3'").select("p").distinct().join(df.repartition(4, "episode").withColumn("p", F.spark_partition_id()), "p").select("episode").distinct().collect()}
    marked = {r["episode"] for r in read_episode_store(spark, root).filter("complete").collect()}
    assert marked == {f"e{k}" for k in range(16)} - own and "e3" in own
    assert read_arrays(spark, root, blobs=True).count() == 5 * len(marked)
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith("_")]


def test_many_short_episodes_are_few_files_and_tasks(spark, tmp_path):
    """An array is a document and one shard, whatever its chunks; blocks share a task beyond the most partitions."""
    root = str(tmp_path / "out")
    f = spark.range(40 * 50).select(F.concat(F.lit("e"), (F.col("id") % 40).cast("string")).alias("episode"), F.floor(F.col("id") / 40).alias("frame_idx"), F.array(F.col("id").cast("double")).alias("pose"))
    write_store(f, root, chunk=8)
    assert sum(p.is_file() for p in (tmp_path / "out").rglob("*")) == 40 * 3
    reader = EpisodeReader({"path": root, "frames_a_task": "5", "most_partitions": "16"})
    assert len(reader.partitions()) <= 16 and sum(b.high - b.low for p in reader.partitions() for b in p.blocks) == 2000
    got = spark.read.format("episode_store").option("frames_a_task", "5").option("most_partitions", "16").load(root)
    assert {(r["episode"], r["frame_idx"]): r["value"] for r in got.collect()} == {(f"e{k % 40}", k // 40): [float(k)] for k in range(2000)}
