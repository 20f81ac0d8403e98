"""From raw detections of patches to per-frame results."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frametide.functions import geometry, text

BOX = ("x1", "y1", "x2", "y2", "conf", "cls")
CONF, IOU = 0.2, 0.45


def stride_sample(frames: DataFrame, stride: int = 1, offset: int = 0, index: str = "source_idx") -> DataFrame:
    """Every ``stride``-th frame, from ``offset`` on; the filter reaches the scan."""
    return frames if stride <= 1 else frames.filter(F.pmod(index, F.lit(stride)) == offset)


def tile_frames(frames: DataFrame, patch: int, overlap: int, snap_to_edge: bool = False) -> DataFrame:
    """A row per frame and patch: the frame's columns and ``patch_id, x0, y0, x1, y1``. Tiling is a function of the row, so nothing moves."""
    return frames.select("*", F.inline_outer(geometry.tiles(F.col("w"), F.col("h"), patch, overlap, snap_to_edge)))


def offset_boxes(found: DataFrame, tiles: DataFrame, on: list[str]) -> DataFrame:
    """Patch boxes in frame coordinates. ``tiles``: the keys ``on`` and ``x0, y0``, a handful per frame shape."""
    at = tiles.select(*on, F.col("x0").alias("tile_x0"), F.col("y0").alias("tile_y0"))
    moved = {c: F.col(c) + F.col("tile_x0" if c[0] == "x" else "tile_y0") for c in BOX[:4]}
    return found.join(at, on).withColumns(moved).drop("tile_x0", "tile_y0")


def scale_global(found: DataFrame, w: Column, h: Column, size: int) -> DataFrame:
    """Boxes of the whole frame at ``size`` x ``size`` in frame coordinates."""
    return found.withColumns({c: F.col(c) * ((w if c[0] == "x" else h) / float(size)) for c in BOX[:4]})


def select_boxes(found: DataFrame, conf: float = CONF, classes: list[int] | None = None) -> DataFrame:
    kept = found.filter(F.col("conf") > conf)
    return kept if classes is None else kept.filter(F.col("cls").isin(classes))


def nms(found: DataFrame, conf: float = CONF, iou: float = IOU, per_class: bool = False, frame: list[str] | None = None) -> DataFrame:
    """Greedy non-maximum suppression within each frame: ``frame_idx, rank, x1 .. cls``, best first.

    Boxes are visited by falling confidence (then by coordinates and class) and kept unless they overlap a kept box. Frames are
    the unit of the shuffle; a frame's boxes are few, so its fold stays in one row.
    """
    frame = frame or ["frame_idx"]
    keys = [*frame, "cls"] if per_class else frame
    one = F.struct((-F.col("conf")).alias("nc"), *BOX[:4], "cls")
    boxes = found.filter(F.col("conf") > conf).groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("b"))
    empty = F.filter("b", lambda x: F.lit(False))
    kept = F.aggregate("b", empty, lambda acc, b: F.when(F.exists(acc, lambda a: geometry.overlaps(a, b, iou)), acc).otherwise(F.array_append(acc, b)))
    rows = boxes.select(*frame, kept.alias("k"))
    if per_class:
        rows = rows.groupBy(*frame).agg(F.array_sort(F.flatten(F.collect_list("k"))).alias("k"))
    # every frame here keeps a box; the plain generator would add a filter on k's size and so fold twice
    rows = rows.select(*frame, F.posexplode_outer("k").alias("rank", "k"))
    return rows.select(*frame, "rank", "k.x1", "k.y1", "k.x2", "k.y2", (-F.col("k.nc")).alias("conf"), "k.cls")


def nms_arrow(found: DataFrame, conf: float = CONF, iou: float = IOU, per_class: bool = False, frame: list[str] | None = None) -> DataFrame:
    """The rows of :func:`nms` for crowded frames: one array program per frame in an Arrow batch, linear in kept boxes times boxes.

    The fold of :func:`nms` copies its list of kept boxes with each addition, which thousands of boxes in a frame make slow.
    """
    frame = frame or ["frame_idx"]
    kinds = {f.name: f.dataType.simpleString() for f in found.schema if f.name in frame}

    def run(table: pa.Table) -> pa.Table:
        x1, y1, x2, y2, score = (table[c].to_numpy() for c in BOX[:5])
        cls = table["cls"].to_numpy()
        order = np.lexsort((cls, y2, x2, y1, x1, -score))
        size, alive, kept = (x2 - x1) * (y2 - y1), np.ones(len(order), bool), []
        for at, i in enumerate(order):
            if not alive[i]:
                continue
            kept.append(i)
            rest = order[at + 1 :]
            w = np.minimum(x2[rest], x2[i]) - np.maximum(x1[rest], x1[i])
            h = np.minimum(y2[rest], y2[i]) - np.maximum(y1[rest], y1[i])
            both = np.maximum(w, 0.0) * np.maximum(h, 0.0)
            over = both > iou * (size[i] + size[rest] - both)
            alive[rest[over & (cls[rest] == cls[i]) if per_class else over]] = False
        out = table.take(pa.array(kept, pa.int64())).append_column("rank", pa.array(range(len(kept)), pa.int32()))
        return out.select([*frame, "rank", *BOX])

    slim = found.filter(F.col("conf") > conf).select(*frame, *BOX)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in frame), "rank int", *(f"{c} double" for c in BOX[:5]), "cls int"])
    return slim.groupBy(*frame).applyInArrow(run, schema)


def suppressed(frame: np.ndarray, box: np.ndarray, iou: float = IOU, per_class: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The rows that :func:`nms` keeps of boxes (``n x 6``) that all lie here, and their ranks. ``frame`` has a number for each box's frame.

    The best boxes of all frames are compared with the rest of their frames at once, then the next best; so frames cost no calls of their own.
    """
    order = np.lexsort((*(box[:, k] for k in (5, 3, 2, 1, 0)), -box[:, 4], frame))
    frame, (x1, y1, x2, y2, _, cls) = frame[order], box[order].T
    size, place = (x2 - x1) * (y2 - y1), np.arange(len(order))
    alive = np.lexsort((place, cls, frame)) if per_class else place
    kept = [alive[:0]]
    while len(alive):
        first = np.ones(len(alive), bool)
        first[1:] = frame[alive[1:]] != frame[alive[:-1]]
        if per_class:
            first[1:] |= cls[alive[1:]] != cls[alive[:-1]]
        lead = alive[first]
        kept.append(lead)
        i, j = lead[np.cumsum(first) - 1][~first], alive[~first]
        w = np.minimum(x2[j], x2[i]) - np.maximum(x1[j], x1[i])
        h = np.minimum(y2[j], y2[i]) - np.maximum(y1[j], y1[i])
        both = np.maximum(w, 0.0) * np.maximum(h, 0.0)
        alive = j[~(both > iou * (size[i] + size[j] - both))]
    kept = np.sort(np.concatenate(kept))
    start = np.ones(len(kept), bool)
    start[1:] = frame[kept[1:]] != frame[kept[:-1]]
    at = np.arange(len(kept))
    return order[kept], at - np.maximum.accumulate(np.where(start, at, 0))


def object_count(frames: DataFrame, kept: DataFrame) -> DataFrame:
    """``frame_idx, n`` for every frame, also those without a box."""
    counts = kept.groupBy("frame_idx").agg(F.count("*").alias("n"))
    return frames.select("frame_idx").join(counts, "frame_idx", "left").select("frame_idx", F.coalesce("n", F.lit(0)).alias("n"))


def frame_documents(frames: DataFrame, kept: DataFrame) -> DataFrame:
    """``frame_idx, detections``: a document per frame, empty where nothing was found. ``kept`` has ``rank``."""
    one = F.struct(F.col("rank"), F.array(*BOX[:4]).alias("bbox"), F.col("conf"), F.col("cls").alias("class"))
    lists = kept.groupBy("frame_idx").agg(F.array_sort(F.collect_list(one)).alias("d"))
    ordered = F.transform("d", lambda x: F.struct(x["bbox"].alias("bbox"), x["conf"].alias("conf"), x["class"].alias("class")))
    joined = frames.select("frame_idx").join(lists, "frame_idx", "left")
    return joined.select("frame_idx", F.coalesce(ordered, F.filter(ordered, lambda x: F.lit(False)), F.array().cast("array<struct<bbox:array<double>,conf:double,class:int>>")).alias("detections"))


def image_documents(images: DataFrame, kept: DataFrame, path: str = "path") -> DataFrame:
    """``path, name, boxes`` of every image: its boxes as arrays of six, none where nothing was found, under its base name and its whole path."""
    one = F.struct(F.col("rank"), F.array(*BOX[:5], F.col("cls").cast("double")).alias("box"))
    lists = kept.groupBy(path).agg(F.array_sort(F.collect_list(one)).alias("b"))
    joined = images.select(path).join(lists, path, "left")
    boxes = F.coalesce(F.transform("b", lambda x: x["box"]), F.array().cast("array<array<double>>"))
    return joined.select(path, text.basename(F.col(path)).alias("name"), boxes.alias("boxes"))


def draw_primitives(kept: DataFrame) -> DataFrame:
    """What a renderer draws for each box: whole-pixel corners, the colour's green (blue 0, red 255), label and its place."""
    y = F.col("y1").cast("int")
    return kept.select(
        "frame_idx", *(F.col(c).cast("int").alias(c) for c in BOX[:4]), (F.lit(255.0) * (1 - F.col("conf"))).cast("int").alias("green"),
        text.fixed("conf", 2).alias("label"), F.when(y - 2 > 0, y - 2).otherwise(y + 10).alias("label_y"),
    )


def batch_assign(tiles: DataFrame, size: int) -> DataFrame:
    """``batch, slot, padding`` of each patch of a frame: chunks of ``size``; the last is padded. ``tiles`` has ``patch_id, n_patches``."""
    batch = F.floor(F.col("patch_id") / size).cast("int")
    last = batch == F.floor((F.col("n_patches") - 1) / size)
    pad = F.when(last, F.pmod(-F.col("n_patches"), F.lit(size))).otherwise(0)
    return tiles.withColumns({"batch": batch, "slot": F.pmod("patch_id", F.lit(size)), "padding": pad.cast("int")})
