import time
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.functions import images as I
from leafmill.streaming import frames as S


def scene(h=800, w=600, seed=0):
    """A bright sheet with known corners on a dark table."""
    corners = np.array([[116, 95], [505, 134], [473, 706], [75, 650]], float)
    y, x = np.mgrid[0:h, 0:w]
    inside = np.ones((h, w), bool)
    for a, b in zip(corners, np.roll(corners, -1, axis=0)):
        inside &= (b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) >= 0
    rgb = np.where(inside[..., None], 230, 60) + np.random.default_rng(seed).integers(-8, 9, (h, w, 3))
    return np.dstack([np.clip(rgb, 0, 255), np.full((h, w), 255)]).astype(np.uint8), corners


def test_page_is_found():
    picture, corners = scene()
    found, sure = I.detect(picture)
    assert np.abs(found - corners).max() < 6 and sure > 0.7
    flat = I.warp(picture, found, *I.output_size(found))
    assert flat[20:-20, 20:-20, :3].mean() > 215
    assert I.detect(np.full((100, 100, 4), 128, np.uint8)) is None
    assert I.warp(picture, np.zeros((4, 2)), 10, 10) is None
    assert I.rectify(picture) is not None


def test_homography_and_rotation():
    a = np.array([[0, 0], [9, 0], [9, 9], [0, 9]], float)
    b = np.array([[1, 2], [11, 1], [12, 13], [0, 10]], float)
    h = I.homography(a, b).reshape(3, 3)
    p = np.column_stack([a, np.ones(4)]) @ h.T
    assert np.allclose(p[:, :2] / p[:, 2:], b)
    x = np.arange(24, dtype=np.uint8).reshape(2, 3, 4)
    assert I.rotate(x, 90).shape == (3, 2, 4) and (I.rotate(x, 90)[0, 1] == x[0, 0]).all() and (I.rotate(x, -270) == I.rotate(x, 90)).all()
    with pytest.raises(ValueError):
        I.rotate(x, 45)


def test_planes_against_plain_loops():
    rng = np.random.default_rng(1)
    g = rng.uniform(0, 255, (13, 17)).astype(np.float32)
    r = 3
    want = [[g[max(0, y - r) : y + r + 1, max(0, x - r) : x + r + 1].mean(dtype=float) for x in range(17)] for y in range(13)]
    assert np.allclose(I.box_means(g, r), want)
    small = I.downscale(g, 5, 4)
    for y in range(5):
        for x in range(4):
            y0, y1, x0, x1 = int(y * 13 / 5), min(13, int(np.ceil((y + 1) * 13 / 5))), int(x * 17 / 4), min(17, int(np.ceil((x + 1) * 17 / 4)))
            assert abs(small[y, x] - g[y0:y1, x0:x1].mean(dtype=float)) < 1e-3
    assert np.allclose(I.blur(np.full((9, 9), 7, np.float32), 1.4), 7, atol=1e-4)
    assert I.percentiles(np.full((10, 10), 100.0)) == (88, 112)
    assert I.otsu(np.array([1, 1, 1, 9, 9, 9.0]), 9.0) < 9 and I.otsu(np.zeros(3), 0.0) == 0


@pytest.mark.parametrize("mode", [*I.FILTERS, "other", None])
def test_filters(mode):
    picture, _ = scene(120, 90)
    out = I.enhance(picture, mode)
    assert out.shape == picture.shape and (out[..., 3] == 255).all()
    if mode in ("original", "other", None):
        assert (out == picture).all()
    if mode == "bw":
        assert set(np.unique(out[..., :3])) <= {0, 255}
    if mode == "gray":
        assert (out[..., 0] == out[..., 2]).all()


def test_capture():
    picture, _ = scene()
    soft = np.dstack([I.clamped(I.blur(picture[..., c].astype(np.float32), 3)) for c in range(4)])
    got = I.capture([soft, picture, picture], (100, 100, 200, 200), scale_to=500)
    assert got.source == "sharpest of burst + reticle" and got.frames == 3 and got.sharpness == I.sharpness(picture) and got.image.shape[0] == 500
    with pytest.raises(ValueError):
        I.capture([])
    assert I.sharpness(np.zeros((2, 2, 4), np.uint8)) == 0.0


def test_udfs(spark):
    picture, _ = scene(64, 48)
    rows = spark.createDataFrame([(1, I.pack(picture)), (2, None)], "id int, image struct<width:int,height:int,data:binary>")
    got = rows.select("id", I.enhance_udf("image", F.lit("bw")).alias("a"), I.fit_udf("image", F.lit(32)).alias("b"), I.sharpness_udf("image").alias("c"), I.rotate_udf("image", F.lit(90)).alias("d"), I.detect_udf("image").alias("e")).orderBy("id").collect()
    assert (got[0].a.width, got[0].b.height, got[0].d.width) == (48, 32, 64) and abs(got[0].c - I.sharpness(picture)) < 1e-9
    assert got[1].c is None and got[1].a.data is None


def test_image_source(spark, tmp_path):
    import struct
    import zlib

    rgb = np.arange(2 * 3 * 3, dtype=np.uint8).reshape(2, 3, 3)
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 2, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + r.tobytes() for r in rgb))) + chunk(b"IEND", b"")
    (tmp_path / "a.png").write_bytes(png)
    (tmp_path / "b.png").write_bytes(b"no picture")
    from leafmill.sources.images import read_images, thumbnails

    got = read_images(spark, f"file://{tmp_path}").collect()
    assert len(got) == 1 and (I.unpack(*got[0].image)[..., :3] == rgb).all()
    assert thumbnails(read_images(spark, f"file://{tmp_path}"), 2).first().thumb.width == 2


QUAD = ((0.0, 0.0), (100.0, 0.0), (100.0, 100.0), (0.0, 100.0))


def moved(by):
    return tuple((x + by, y) for x, y in QUAD)


def run(steps, automatic=True):
    seen, out = S.Seen(), []
    for corners, sure in steps:
        seen, step = S.advance(seen, corners, sure, 1000, automatic)
        out.append(step)
    return out


def test_state_machine():
    assert [s.count for s in run([(QUAD, 0.5)] * 3)] == [1, 2, 3]
    assert [s.count for s in run([(QUAD, 0.5), (moved(50), 0.5), (moved(50), 0.5), (None, 0.0), (QUAD, 0.5)])] == [1, 0, 1, 0, 1]
    got = run([(QUAD, 0.9)] * 7)
    assert [s.captured for s in got] == [False] * 4 + [True, False, False] and got[4].held == QUAD and got[5].count == 1
    # the confidence that counts is the previous frame's
    assert not run([(QUAD, 0.9)] * 3 + [(QUAD, 0.1), (QUAD, 0.9)])[-1].armed
    assert run([(QUAD, 0.9)] * 4 + [(QUAD, 0.1)])[-1].armed
    # 35 of 1000 is too far, anything less is steady
    assert [s.count for s in run([(QUAD, 0), (moved(35), 0)])] == [1, 0] and [s.count for s in run([(QUAD, 0), (moved(34.9), 0)])] == [1, 2]
    assert [s.count for s in run([(QUAD, 0.9)] * 6, automatic=False)] == [1, 2, 3, 4, 5, 6]


def frame_rows():
    t0, out = datetime(2026, 1, 1), []
    rng = np.random.default_rng(2)
    for cam in ("x", "y"):
        at = 0.0
        for i in range(60):
            at += float(rng.choice([0, 0, 0, 60]))
            quad = None if rng.random() < 0.08 else [(a + at, b) for a, b in QUAD]
            out.append((cam, t0 + timedelta(milliseconds=190 * i), i, 1000.0, quad, 0.9))
    return out


FRAME = "camera string, ts timestamp, frame_id long, width double, corners array<struct<x:double,y:double>>, confidence double"


def test_stream_equals_batch(spark, tmp_path):
    rows = frame_rows()
    batch = S.stability(spark.createDataFrame(rows, FRAME))
    for k in range(3):
        spark.createDataFrame([r for r in rows if r[2] // 20 == k], FRAME).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    stream = S.stability_stream(spark.readStream.schema(FRAME).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("steps").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda r: (r.camera, r.frame_id, r["count"], r.steady, r.armed, r.captured)
    assert sorted(map(key, spark.table("steps").collect())) == sorted(map(key, batch.collect()))
    assert batch.where("captured").count() > 0


def test_runs_follow_the_state_machine(spark):
    rng = np.random.default_rng(3)
    values = [None if rng.random() < 0.1 else float(v) for v in rng.choice([0, 10, 50], 200)]
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "k int, i int, v double")
    got = [r["count"] for r in S.runs(rows, "k", ["i"], F.col("v"), F.lit(35.0)).orderBy("i").collect()]
    want = [s.count for s in run([(None if v is None else ((v, 0.0),), 0.1) for v in values], automatic=False)]
    assert got == want


def test_bursts_and_pauses(spark):
    f = spark.createDataFrame([("a", i, s) for i, s in enumerate((1.0, 5.0, 5.0, 2.0, 9.0))], "b string, i int, s double")
    assert [tuple(r) for r in S.sharpest(f, "b", "i", "s").collect()] == [("a", 1, 5.0)]
    t = datetime(2026, 1, 1)
    keys = spark.createDataFrame([("s", t + timedelta(milliseconds=m), q) for m, q in ((0, "a"), (100, "ab"), (300, "abc"), (900, "x"))], "session string, ts timestamp, query string")
    assert [r.query for r in S.debounced(keys).orderBy("ts").collect()] == ["abc", "x"]
