import random

import numpy as np
from pyspark.sql import functions as F

from frametide.operators import detections as D

BOXES = "frame_idx long, x1 double, y1 double, x2 double, y2 double, conf double, cls int"


def greedy(boxes, conf, iou):
    kept = []
    for b in sorted((b for b in boxes if b[4] > conf), key=lambda b: (-b[4], *b[:4], b[5])):
        def over(a):
            w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
            both = max(w, 0.0) * max(h, 0.0)
            return both > iou * ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both)

        if not any(over(a) for a in kept):
            kept.append(b)
    return kept


def test_nms_against_greedy(spark):
    rng = random.Random(7)
    rows = []
    for f in range(40):
        for _ in range(rng.randrange(0, 30)):
            x, y, s = rng.randrange(60), rng.randrange(60), rng.randrange(1, 30)
            rows.append((f, float(x), float(y), float(x + s), float(y + s), rng.randrange(20) / 20, rng.randrange(3)))
    df = spark.createDataFrame(rows, BOXES)
    for per_class in (False, True):
        got = {}
        for r in D.nms(df, 0.2, 0.45, per_class).orderBy("frame_idx", "rank").collect():
            got.setdefault(r.frame_idx, []).append((r.x1, r.y1, r.x2, r.y2, r.conf, r.cls))
        for f in range(40):
            own = [r[1:] for r in rows if r[0] == f]
            groups = [[b for b in own if b[5] == c] for c in range(3)] if per_class else [own]
            want = sorted((b for g in groups for b in greedy(g, 0.2, 0.45)), key=lambda b: (-b[4], *b[:4], b[5]))
            assert got.get(f, []) == want
        columns = ["frame_idx", "rank", *D.BOX]
        assert sorted(D.nms(df, 0.2, 0.45, per_class).select(*columns).collect()) == sorted(D.nms_arrow(df, 0.2, 0.45, per_class).select(*columns).collect())


def test_nms_keeps_the_better_and_thresholds_are_strict(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0, 0.5, 0), (1, 1.0, 1.0, 9.0, 9.0, 0.9, 0), (2, 0.0, 0.0, 1.0, 1.0, 0.2, 0)], BOXES)
    got = D.nms(df, 0.2, 0.61).collect()
    assert [(r.frame_idx, r.conf) for r in got] == [(1, 0.9)]
    half = spark.createDataFrame([(1, 0.0, 0.0, 2.0, 1.0, 0.9, 0), (1, 0.0, 0.0, 1.0, 1.0, 0.8, 0)], BOXES)
    assert D.nms(half, 0.2, 0.5).count() == 2  # equality is kept


def test_offset_scale_and_select(spark):
    df = spark.createDataFrame([(1, 0, 1.0, 2.0, 4.0, 5.0, 0.9, 0)], "frame_idx long, patch_id int, x1 double, y1 double, x2 double, y2 double, conf double, cls int")
    tiles = spark.createDataFrame([(0, 100, 50)], "patch_id int, x0 int, y0 int")
    assert tuple(D.offset_boxes(df, tiles, ["patch_id"]).select(*D.BOX[:4]).first()) == (101.0, 52.0, 104.0, 55.0)
    whole = spark.createDataFrame([(10.0, 20.0, 30.0, 40.0)], "x1 double, y1 double, x2 double, y2 double")
    assert tuple(D.scale_global(whole, F.lit(1920), F.lit(1080), 960).first()) == (20.0, 22.5, 60.0, 45.0)
    assert D.select_boxes(df, 0.9).count() == 0 and D.select_boxes(df, 0.5, [1]).count() == 0 and D.select_boxes(df, 0.5, [0]).count() == 1


def test_frame_documents_keep_empty_frames(spark):
    frames = spark.createDataFrame([(7,), (8,)], "frame_idx long")
    kept = D.nms(spark.createDataFrame([(7, 1.0, 2.0, 3.0, 4.0, 0.9, 5)], BOXES))
    docs = D.frame_documents(frames, kept).orderBy("frame_idx").select(F.to_json(F.struct("frame_idx", "detections"))).collect()
    assert [r[0] for r in docs] == ['{"frame_idx":7,"detections":[{"bbox":[1.0,2.0,3.0,4.0],"conf":0.9,"class":5}]}', '{"frame_idx":8,"detections":[]}']
    assert [r.n for r in D.object_count(frames, kept).orderBy("frame_idx").collect()] == [1, 0]


def test_stride(spark):
    df = spark.range(10).withColumnRenamed("id", "source_idx")
    assert [r[0] for r in D.stride_sample(df, 3, 1).collect()] == [1, 4, 7]
    assert D.stride_sample(df, 1, 5).count() == 10 and D.stride_sample(df, 2, 2).count() == 0


def test_detect_plan_places_boxes_once(spark):
    from frametide.detector import BrightBlocks
    from frametide.plans.detect import detect, predict
    from frametide.settings import Settings
    from frametide.sources.images import SCHEMA, shape_of

    image = np.zeros((96, 160, 3), np.uint8)
    image[32:48, 96:112] = 250
    df = spark.createDataFrame([("a", 160, 96, 3, bytearray(image.tobytes())), ("b", 160, 96, 3, bytearray(160 * 96 * 3))], SCHEMA)
    got = detect(df, BrightBlocks(), Settings(patch_size=64, min_overlap=16)).collect()
    assert [(r.path, r.x1, r.y1, r.x2, r.y2, r.cls) for r in got] == [("a", 96.0, 32.0, 112.0, 48.0, 0)]
    assert shape_of(df) == (160, 96)
    whole = detect(df, BrightBlocks(), Settings(patch_size=64, min_overlap=16, global_context=True, global_size=160)).collect()
    assert {r.path for r in whole} == {"a"}
    boxes = predict(spark, image, BrightBlocks(), Settings(patch_size=64, min_overlap=16, resize=(320, 192)))
    assert boxes and all(80 <= b[0] <= 120 and 24 <= b[1] <= 56 for b in boxes)


def test_suppressed_gives_the_rows_of_nms(spark):
    rng = random.Random(11)
    rows = []
    for f in range(30):
        for _ in range(rng.randrange(25)):
            x, y, side = rng.randrange(40), rng.randrange(40), rng.randrange(1, 30)
            rows.append((f, float(x), float(y), float(x + side), float(y + side), rng.randrange(1, 20) / 20, rng.randrange(3)))
    df = spark.createDataFrame(rows, BOXES)
    for per_class in (False, True):
        kept, rank = D.suppressed(np.array([r[0] for r in rows]), np.array([r[1:] for r in rows]), 0.45, per_class)
        want = D.nms(df, 0.0, 0.45, per_class).select("frame_idx", "rank", *D.BOX).collect()
        assert sorted((rows[k][0], int(r), *rows[k][1:]) for k, r in zip(kept, rank)) == sorted(map(tuple, want))
    kept, rank = D.suppressed(np.empty(0, np.int64), np.empty((0, 6)))
    assert len(kept) == len(rank) == 0


def test_small_images_share_a_batch_and_move_nowhere(spark, tmp_path):
    from frametide.detector import BrightBlocks
    from frametide.plans.detect import detect
    from frametide.settings import Settings

    calls = tmp_path / "calls"

    class Counting(BrightBlocks):
        def detect(self, patches, conf, classes):
            with open(str(calls), "a") as f:
                f.write(f"{len(patches)} ")
            return super().detect(patches, conf, classes)

    image = np.zeros((64, 64, 3), np.uint8)
    image[16:32, 16:32] = 255
    grey = np.full((64, 64, 1), 200, np.uint8)
    rows = [(i, 64, 64, 3, bytearray(image.tobytes())) for i in (1, 2, 3, 3)] + [(4, 64, 64, 1, bytearray(grey.tobytes())), (5, 64, 64, 3, bytearray(64 * 64 * 3))]
    df = spark.createDataFrame(rows, "frame_idx long, w int, h int, channels int, data binary").coalesce(1)
    found = detect(df, Counting(), Settings(patch_size=64, min_overlap=16), key="frame_idx")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = found.collect()
    assert sorted((r.frame_idx, r.rank, r.x1, r.y1) for r in got if r.frame_idx < 4) == [(1, 0, 16.0, 16.0), (2, 0, 16.0, 16.0), (3, 0, 16.0, 16.0), (3, 0, 16.0, 16.0)]  # rows of one key are images of their own
    assert sorted(r.rank for r in got if r.frame_idx == 4) == list(range(16)) and not [r for r in got if r.frame_idx == 5]
    assert calls.read_text().split() == ["8"] * 3  # a change of channels begins a batch


def test_whole_frames_are_seen_one_by_one_and_move_nowhere(spark):
    from frametide.detector import BrightBlocks
    from frametide.plans.detect import detect
    from frametide.settings import Settings

    bright = np.full((64, 64, 3), 200, np.uint8)
    df = spark.createDataFrame([(i, 64, 64, 3, bytearray(bright.tobytes())) for i in (1, 2)], "frame_idx long, w int, h int, channels int, data binary").coalesce(1)
    found = detect(df, BrightBlocks(), Settings(patch_size=64, min_overlap=16, global_context=True, global_size=16, iou=1.0), key="frame_idx")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.frame_idx, r.rank, r.x2 - r.x1) for r in found.collect())
    assert [(f, k) for f, k, _ in got] == [(f, k) for f in (1, 2) for k in range(17)] and [w for _, _, w in got].count(64.0) == 2


def test_whole_frames_share_batches(spark, tmp_path):
    from frametide.detector import BrightBlocks
    from frametide.plans.detect import detect
    from frametide.settings import Settings

    calls = tmp_path / "calls"

    class Counting(BrightBlocks):
        def detect(self, patches, conf, classes):
            with open(str(calls), "a") as f:
                f.write(f"{patches.shape[1]}x{len(patches)} ")
            return super().detect(patches, conf, classes)

    rows = [(i, w, 64, 3, bytearray(np.full((64, w, 3), 200 if i % 2 else 0, np.uint8).tobytes())) for i, w in enumerate([64, 80] * 5)]
    rows.append((10, 64, 64, 1, bytearray(np.full((64, 64, 1), 200, np.uint8).tobytes())))
    df = spark.createDataFrame(rows, "frame_idx long, w int, h int, channels int, data binary").coalesce(1)
    found = detect(df, Counting(), Settings(patch_size=64, min_overlap=16, global_context=True, global_size=16, iou=1.0), key="frame_idx").collect()
    assert calls.read_text().split().count("16x8") == 3  # eight, two more and one of other channels; not eleven calls
    bright = {1, 3, 5, 7, 9, 10}
    assert {r.frame_idx for r in found} == bright
    wide = [(r.frame_idx, r.x1, r.y1, r.x2, r.y2) for r in found if r.x2 - r.x1 > 16]
    assert sorted(wide) == [(i, 0.0, 0.0, 64.0 if i == 10 else 80.0, 64.0) for i in sorted(bright)]


def test_resize_by_brute_force():
    from frametide.functions import pixels

    rng = np.random.default_rng(5)
    for h, w, height, width, channels in ((9, 40, 4, 4, 3), (5, 7, 11, 13, 1), (6, 6, 3, 5, 4), (1, 1, 2, 3, 3)):
        image = rng.integers(0, 256, (h, w, channels), dtype=np.uint8)
        got = pixels.resize(image, width, height)
        assert got.shape == (height, width, channels) and got.dtype == np.uint8
        for y in range(height):
            for x in range(width):
                v, u = min(max((y + 0.5) * h / height - 0.5, 0), h - 1), min(max((x + 0.5) * w / width - 0.5, 0), w - 1)
                i, j = int(v), int(u)
                k, m = min(i + 1, h - 1), min(j + 1, w - 1)
                p = image.astype(float)
                left = p[i, j] * (1 - (v - i)) + p[k, j] * (v - i)
                right = p[i, m] * (1 - (v - i)) + p[k, m] * (v - i)
                assert (got[y, x] == np.rint(left * (1 - (u - j)) + right * (u - j))).all()
