"""The detection plan: images or frames in, boxes in their own coordinates out.

Letterbox, tiling, detection and suppression of a frame happen in one Arrow batch function, so a frame's pixels are read once, stay in one
task and are dropped there; only the boxes that are kept leave it, with their image's size, and nothing is shuffled. Patches of consecutive
images share the detector's batches, as whole images do among themselves, and boxes of all images of an Arrow batch are suppressed as arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frametide.detector import Detector
from frametide.functions import geometry, pixels
from frametide.operators import detections as D
from frametide.settings import Settings

SHAPE = ("w", "h", "rx", "ry", "dw", "dh")
FOUND = "w int, h int, rx double, ry double, dw double, dh double, rank int, x1 double, y1 double, x2 double, y2 double, conf double, cls int"
FIT = ("unpad_w", "unpad_h", "top", "bottom", "left", "right")

_LOADED: dict[str, Detector] = {}  # of a Python worker


def _loaded(pickled: bytes) -> Detector:
    """The detector, unpickled and made ready once in each worker, however many tasks that runs."""
    import hashlib
    import pickle

    name = hashlib.sha1(pickled).hexdigest()
    if name not in _LOADED:
        detector = pickle.loads(pickled)
        if hasattr(detector, "load"):
            detector.load()
        _LOADED[name] = detector
    return _LOADED[name]


def _pixels(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """Each image of the batch, letterboxed; a view of the batch's own bytes where that changes nothing."""
    data = batch.column("data")
    _, ends, values = data.buffers()
    at = np.frombuffer(ends, np.int64 if pa.types.is_large_binary(data.type) else np.int32)[data.offset :].tolist()
    values = np.frombuffer(values or b"", np.uint8)
    sizes = zip(*(batch.column(c).to_pylist() for c in ("w", "h", "channels", *FIT)))
    for i, (w, h, channels, *fit) in enumerate(sizes):
        image = values[at[i] : at[i + 1]].reshape(h, w, channels)
        yield image if fit == [w, h, 0, 0, 0, 0] else pixels.letterbox(image, *fit)


class _Batch:
    """Squares of ``size`` pixels, on their way to the detector. It sees ``batch_size`` of them at once; a short batch is filled up with black."""

    def __init__(self, size: int, detector: Detector, s: Settings):
        self.size, self.detector, self.s = size, detector, s
        self.places: list[tuple] = []  # of the squares in ``squares``
        self.squares = np.empty((0, size, size, 0), np.uint8)

    def add(self, part: np.ndarray, place: tuple) -> list[tuple]:
        """Rows of the squares before, where ``part`` begins a batch by its channels, and of all where it ends one. A part that passes the border is filled up with black."""
        out = self.rows() if self.places and self.squares.shape[3] != part.shape[2] else []
        if not self.places:
            self.squares = np.zeros((self.s.batch_size, self.size, self.size, part.shape[2]), np.uint8)
        self.squares[len(self.places), : part.shape[0], : part.shape[1]] = part
        self.places.append(place)
        return out + self.rows() if len(self.places) == self.s.batch_size else out

    def rows(self) -> list[tuple]:
        """Each place, with its boxes."""
        if not self.places:
            return []
        out = [(*place, boxes) for place, boxes in zip(self.places, self.detector.detect(self.squares, self.s.conf, self.s.classes))]
        self.places.clear()
        return out


def _patch_boxes(batch: pa.RecordBatch, detector: Detector, s: Settings) -> Iterator[tuple[int, float, float, float, float, list]]:
    """``image, x0, y0, scale_x, scale_y, boxes`` of each patch, by the image's place in the batch; of whole images too where that is asked for."""
    size, context = s.patch_size, s.context_size
    (xs, x_ends), (ys, y_ends) = ((batch.column(c).values.to_numpy().tolist(), batch.column(c).offsets.to_numpy().tolist()) for c in ("xs", "ys"))
    fit_w, fit_h = (batch.column(c).to_pylist() for c in ("fit_w", "fit_h"))
    patches, wholes = _Batch(size, detector, s), _Batch(context, detector, s)
    for i, image in enumerate(_pixels(batch)):
        for y in ys[y_ends[i] : y_ends[i + 1]]:
            for x in xs[x_ends[i] : x_ends[i + 1]]:
                yield from patches.add(image[y : y + size, x : x + size], (i, x, y, 1.0, 1.0))
        if s.global_context:
            yield from wholes.add(pixels.resize(image, context, context), (i, 0, 0, fit_w[i] / float(context), fit_h[i] / float(context)))
    yield from patches.rows()
    yield from wholes.rows()


def patch_detections(images: DataFrame, key: str, detector: Detector, s: Settings) -> DataFrame:
    """The boxes of each image that suppression keeps, in the letterboxed image's coordinates and by rank, and one row without a box for each image.

    ``images``: key, ``w, h, channels, data`` and ``fit``. The detector sees each patch once, and the whole image where that is asked for.
    Each row is an image of its own, also where keys repeat.
    """
    from pyspark import cloudpickle

    pickled = cloudpickle.dumps(detector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            image, moves, rows = [], [], []
            for i, x0, y0, by_x, by_y, boxes in _patch_boxes(batch, _loaded(pickled), s):
                rows += boxes
                image += [i] * len(boxes)
                moves += [(x0, y0, by_x, by_y)] * len(boxes)
            image, box, move = np.array(image, np.int64), np.array(rows, np.float64).reshape(-1, 6), np.array(moves, np.float64).reshape(-1, 4)
            box[:, 0:4:2] = box[:, 0:4:2] * move[:, 2:3] + move[:, 0:1]
            box[:, 1:4:2] = box[:, 1:4:2] * move[:, 3:4] + move[:, 1:2]
            good = ~(box[:, 4] <= s.conf)
            if s.classes is not None:
                good &= np.isin(box[:, 5], s.classes)
            image, box = image[good], box[good]
            kept, rank = D.suppressed(image, box, s.iou, s.per_class)
            own = batch.select([key, *SHAPE]).take(pa.array(np.concatenate((np.arange(len(batch)), image[kept]))))
            blank = np.concatenate((np.ones(len(batch), bool), np.zeros(len(kept), bool)))
            boxed = np.concatenate((np.zeros((len(batch), 6)), box[kept]))
            ranks = pa.array(np.concatenate((np.zeros(len(batch), np.int32), rank.astype(np.int32))), mask=blank)
            columns = [pa.array(boxed[:, k], mask=blank) for k in range(5)]
            yield pa.RecordBatch.from_arrays([*own.columns, ranks, *columns, pa.array(boxed[:, 5].astype(np.int32), mask=blank)], names=names)

    names = [key, *(c.split()[0] for c in FOUND.split(", "))]
    kind = images.schema[key].dataType.simpleString()
    fit = F.col("fit")
    sized = images.withColumns({"fit_w": fit["unpad_w"] + fit["left"] + fit["right"], "fit_h": fit["unpad_h"] + fit["top"] + fit["bottom"]})
    starts = {c: geometry.axis_starts(F.col(f"fit_{d}"), s.patch_size, s.min_overlap) for c, d in (("xs", "w"), ("ys", "h"))}  # the tiles are all pairs of them
    tiled = sized.withColumns(starts)
    return tiled.select(key, "w", "h", "channels", "data", "fit.*", "xs", "ys", "fit_w", "fit_h").mapInArrow(run, f"`{key}` {kind}, {FOUND}")


def raw_boxes(images: DataFrame, detector: Detector, s: Settings, key: str = "path", buffer: tuple[int, int] | None = None) -> DataFrame:
    """What :func:`patch_detections` finds in images letterboxed to ``buffer`` (else to the settings' size, else as they are)."""
    if buffer is None and s.resize is not None:
        buffer = s.resize
    w, h = F.col("w"), F.col("h")
    if buffer:
        fit = geometry.prepare(w, h, *buffer, resize=s.resize is not None)
    else:
        fit = F.struct(F.lit(1.0).alias("rx"), F.lit(1.0).alias("ry"), F.lit(0.0).alias("dw"), F.lit(0.0).alias("dh"), w.alias("unpad_w"), h.alias("unpad_h"), *(F.lit(0).alias(n) for n in ("top", "bottom", "left", "right")))
    return patch_detections(images.withColumn("fit", fit), key, detector, s)


def finished(raw: DataFrame, key: str = "path") -> DataFrame:
    """``key, rank, x1 .. cls`` in image coordinates, of what :func:`raw_boxes` gives. An image's size travels with its boxes, so nothing moves."""
    back = {c: geometry.inverse_clamp(F.col(c), F.col("dw" if c[0] == "x" else "dh"), F.col("rx" if c[0] == "x" else "ry"), F.col("w" if c[0] == "x" else "h")) for c in D.BOX[:4]}
    return raw.filter("conf is not null").withColumns(back).select(key, "rank", *D.BOX)


def detect(images: DataFrame, detector: Detector, s: Settings, key: str = "path", buffer: tuple[int, int] | None = None) -> DataFrame:
    """``key, rank, x1 .. cls`` of each image, in its own coordinates."""
    return finished(raw_boxes(images, detector, s, key, buffer), key)


def predict(spark, image: np.ndarray, detector: Detector, s: Settings) -> list[list]:
    """Boxes of an image in memory, letterboxed to a 4K buffer, as lists of six; the same plan over one row."""
    from frametide.sources.images import from_array

    rows = detect(from_array(spark, image), detector, s, buffer=s.resize or (3840, 2160)).orderBy("rank").collect()
    return [[r[c] for c in D.BOX] for r in rows]
