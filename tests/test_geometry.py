import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from frametide.functions import geometry
from frametide.operators import detections as D


def starts(dim, patch, overlap):
    """Straight from the definition."""
    if dim <= patch:
        return [0]
    n = math.ceil((dim - patch) / (patch - overlap)) + 1
    step = (dim - patch) / (n - 1)
    return [max(0, min(int(i * step) + patch, dim) - patch) for i in range(math.ceil((dim - patch) / step) + 1)]


@pytest.mark.parametrize(
    "w, h, patch, overlap, xs, ys",
    [
        (3840, 2160, 640, 128, [0, 457, 914, 1371, 1828, 2285, 2742, 3200], [0, 506, 1013, 1520]),
        (3840, 2160, 960, 128, [0, 720, 1440, 2160, 2880], [0, 600, 1200]),
        (3840, 2160, 1280, 128, [0, 853, 1706, 2560], [0, 880]),
        (3840, 2160, 1920, 128, [0, 960, 1920], [0, 240]),
        (640, 480, 1280, 128, [0], [0]),
    ],
)
def test_tiles(spark, w, h, patch, overlap, xs, ys):
    got = D.tile_frames(spark.createDataFrame([(w, h)], "w int, h int"), patch, overlap).orderBy("patch_id").collect()
    assert [(r.x0, r.y0, r.x1, r.y1) for r in got] == [(x, y, x + patch, y + patch) for y in ys for x in xs]


def test_rounding_cases_and_snap(spark):
    df = spark.createDataFrame([(5956,)], "d int")
    assert df.select(geometry.axis_starts(F.col("d"), 960, 128)).first()[0][-3:] == [4282, 4996, 4996]
    assert df.select(geometry.axis_starts(F.col("d"), 960, 128, snap_to_edge=True)).first()[0][-2:] == [4282, 4996]
    df = spark.createDataFrame([(4294,)], "d int")
    assert df.select(geometry.axis_starts(F.col("d"), 256, 32)).first()[0][-1] == 4037
    assert df.select(geometry.axis_starts(F.col("d"), 256, 32, snap_to_edge=True)).first()[0][-1] == 4038


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(1, 9000), min_size=1, max_size=40), st.sampled_from([(640, 128), (1280, 128), (256, 32), (100, 0)]))
def test_starts_equal_the_definition(spark, dims, tiling):
    df = spark.createDataFrame([(d,) for d in dims], "d int")
    got = df.select("d", geometry.axis_starts(F.col("d"), *tiling).alias("s")).collect()
    assert all(r.s == starts(r.d, *tiling) for r in got)


def test_bad_tiling():
    for patch, overlap in ((128, 128), (128, 200), (0, 0), (64, -1)):
        with pytest.raises(ValueError):
            geometry.check_tiling(patch, overlap)


@pytest.mark.parametrize(
    "w, h, bw, bh, want",
    [(20, 10, 20, 10, (1, 1, 0, 0)), (1920, 1080, 3840, 2160, (2, 2, 0, 0)), (1000, 1000, 3840, 2160, (2.16, 2.16, 840, 0)), (641, 480, 640, 640, (640 / 641, 640 / 641, 0, 80.5))],
)
def test_prepare(spark, w, h, bw, bh, want):
    r = spark.createDataFrame([(w, h)], "w int, h int").select(geometry.prepare(F.col("w"), F.col("h"), bw, bh).alias("b")).first()["b"]
    assert (r["rx"], r["ry"], r["dw"], r["dh"]) == pytest.approx(want)
    assert r["unpad_w"] + r["left"] + r["right"] == bw and r["unpad_h"] + r["top"] + r["bottom"] == bh


def test_letterbox_options(spark):
    df = spark.createDataFrame([(1920, 1080)], "w int, h int")

    def fit(**o):
        return df.select(geometry.letterbox(F.col("w"), F.col("h"), 640, 640, **o).alias("b")).first()["b"]

    assert fit(auto=True)["dh"] == pytest.approx((640 - 360) % 32 / 2)
    filled = fit(scale_fill=True)
    assert (filled["rx"], filled["ry"], filled["dw"], filled["dh"]) == pytest.approx((640 / 1920, 640 / 1080, 0, 0))
    small = spark.createDataFrame([(100, 50)], "w int, h int").select(geometry.letterbox(F.col("w"), F.col("h"), 640, 640, scaleup=False).alias("b")).first()["b"]
    assert small["rx"] == 1.0


def test_inverse_clamp(spark):
    df = spark.createDataFrame([(15.0, 10.0, 55.0, 50.0)], "x1 double, y1 double, x2 double, y2 double")
    got = df.select(*(geometry.inverse_clamp(F.col(c), F.lit(5.0 if c[0] == "x" else 0.0), F.lit(2.0), F.lit(30 if c[0] == "x" else 20)) for c in df.columns)).first()
    assert tuple(got) == (5.0, 5.0, 25.0, 20.0)


def test_center_crop(spark):
    df = spark.createDataFrame([(3840,), (1281,), (100,)], "w int")
    start, end = geometry.center_crop(F.col("w"), 1280)
    assert [tuple(r) for r in df.select(start, end).collect()] == [(1280, 2560), (0, 1280), (0, 100)]
