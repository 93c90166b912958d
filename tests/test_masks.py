"""Packed masks and their files: sizes, ranges, attempts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelmark.operators.scoring import pack_masks, unpack_masks
from reelmark.sources import read_mask_files, sinks


def pixels(spark, masks):
    rows = [(n, k, y, x, bool(b[y, x])) for (n, k), b in masks.items() for y in range(b.shape[0]) for x in range(b.shape[1])]
    return spark.createDataFrame(rows, "id string, k int, y int, x int, on boolean")


def test_packing_random(spark):
    rng = np.random.default_rng(1)
    masks = {(n, k): rng.random((rng.integers(1, 12), rng.integers(1, 40))) < p for n, k, p in ((None, 1, 0.5), ("a", 1, 0.1), ("a", 2, 1.0), ("b", None, 0.0), ("c", 3, 0.02), ("c", 4, 0.9))}
    df = pixels(spark, masks)
    got = {(r["id"], r["k"]): (r["height"], r["width"], bytes(r["mask"])) for r in pack_masks(df.unionByName(df.filter("k = 1")), ["id", "k"]).collect()}
    assert got == {n: (*b.shape, np.packbits(b).tobytes()) for n, b in masks.items()}
    assert pack_masks(df.limit(0), ["id", "k"]).count() == 0


def test_a_mask_of_a_million_pixels(spark):
    n = 1008
    df = spark.range(n * n).select(F.lit("m").alias("id"), (F.col("id") / n).cast("int").alias("y"), (F.col("id") % n).cast("int").alias("x"), (F.xxhash64("id") % 3 == 0).alias("on"))
    bits = np.zeros((n, n), bool)
    for r in df.filter("on").toLocalIterator():
        bits[r["y"], r["x"]] = True
    packed = pack_masks(df, ["id"])
    assert bytes(packed.first()["mask"]) == np.packbits(bits).tobytes()
    assert unpack_masks(packed).first()["area"] == bits.sum()


def blobs(rng, episodes, n):
    return [(e, f, o, rng.randbytes(rng.randrange(0, 60)) if (f + o) % 7 else None) for e in episodes for f in range(n) for o in (2, 1)]


def test_files_and_ranges(spark, tmp_path):
    rows = blobs(random.Random(4), ["a", "b", "c d"], 40)
    df = spark.createDataFrame(random.Random(5).sample(rows, len(rows)), "episode string, frame_idx int, object_id int, mask binary")
    folder = str(tmp_path / "m")
    index = sinks.mask_files(df, "file://" + folder)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "m").glob("*.bin")}
    assert index.count() == len(rows) and {p: p.stat().st_mtime_ns for p in (tmp_path / "m").glob("*.bin")} == before
    assert sorted(p.name for p in (tmp_path / "m").iterdir() if p.is_file()) == ["a.bin", "b.bin", "c d.bin"]
    for e in ("a", "b", "c d"):
        assert (tmp_path / "m" / f"{e}.bin").read_bytes() == b"".join(r[3] or b"" for r in sorted(rows, key=lambda r: r[:3]) if r[0] == e)
    wanted = index.withColumnRenamed("episode", "file").filter("frame_idx % 3 = 1")
    back = read_mask_files(spark, folder, wanted, span=100, batch_bytes=50)
    assert {(r["file"], r["frame_idx"], r["object_id"]): bytes(r["mask"]) for r in back.collect()} == {r[:3]: r[3] or b"" for r in rows if r[1] % 3 == 1}
    plan = back._jdf.queryExecution().toString()
    assert "binaryFile" not in plan and "Join" not in plan
    odd = spark.createDataFrame([("a", None, 3), (None, 1, 1), ("a", 0, None)], "file string, mask_offset bigint, mask_nbytes bigint")
    assert [r["mask"] for r in read_mask_files(spark, folder, odd).collect()] == [None] * 3
    for row, fault in ((("z", 0, 1), "z.bin"), (("a", 10**6, 5), "ends before")):
        with pytest.raises(Exception, match=fault):
            read_mask_files(spark, folder, spark.createDataFrame([row], "file string, mask_offset bigint, mask_nbytes bigint")).collect()


def test_a_range_beyond_two_gigabytes(spark, tmp_path):
    at = 3 * 2**30
    with open(tmp_path / "big.bin", "wb") as f:  # a hole: no disk is used
        f.seek(at)
        f.write(b"mask")
    index = spark.createDataFrame([("big", at, 4, "x"), ("big", 5, 2, "y")], "file string, mask_offset bigint, mask_nbytes bigint, note string")
    assert {r["note"]: bytes(r["mask"]) for r in read_mask_files(spark, str(tmp_path), index).collect()} == {"x": b"mask", "y": b"\0\0"}


def test_a_failing_attempt_leaves_no_part_of_a_file(spark, tmp_path):
    rows = blobs(random.Random(6), ["a", "b"], 10)
    folder = "file://" + str(tmp_path / "m")
    sinks.mask_files(spark.createDataFrame(rows, "episode string, frame_idx int, object_id int, mask binary"), folder)
    whole = {p.name: p.read_bytes() for p in (tmp_path / "m").glob("*.bin")}

    @F.udf("binary")
    def fail(frame, mask):
        if frame == 9:
            raise RuntimeError("lost")
        return mask

    with pytest.raises(Exception, match="lost"):
        sinks.mask_files(spark.createDataFrame(rows, "episode string, frame_idx int, object_id int, mask binary").withColumn("mask", fail("frame_idx", "mask")), folder)
    assert {p.name: p.read_bytes() for p in (tmp_path / "m").iterdir() if p.is_file()} == whole
