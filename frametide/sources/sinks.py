"""Sinks: JSON lines for any size, and the single indented documents that small runs hand on."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_frame_lines(documents: DataFrame, path: str) -> None:
    """One JSON document a line, in parallel; the way for large runs."""
    documents.write.mode("overwrite").json(path)


def write_frame_array(documents: DataFrame, path: str) -> int:
    """A JSON array in frame order, indented by two. Rows pass the driver one partition at a time; returns how many."""
    n = 0
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write("[")
        for n, row in enumerate(documents.orderBy("frame_idx").select(F.to_json(F.struct("frame_idx", "detections")).alias("j")).toLocalIterator(), 1):
            text = json.dumps(json.loads(row["j"]), indent=2).replace("\n", "\n  ")
            f.write((",\n  " if n > 1 else "\n  ") + text)
        f.write("\n]" if n else "]")
    return n


def write_image_map(documents: DataFrame, path: str) -> int:
    """``detections.json``: base name to boxes, indented by four. Of images with one base name the last path stays."""
    out = {r["name"]: [[*b[:5], int(b[5])] for b in r["boxes"]] for r in documents.orderBy("path").toLocalIterator()}
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(out, f, indent=4)
    return len(out)


def encode_png(image) -> bytes:
    """An RGB array as a PNG file."""
    import struct
    import zlib

    h, w, _ = image.shape
    raw = b"".join(b"\0" + row.tobytes() for row in image)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 1)) + chunk(b"IEND", b"")


def write_annotated(images: DataFrame, kept: DataFrame, folder: str) -> None:
    """Each image with its boxes drawn, as ``<name>.png`` in a folder that the executors share. Images without boxes are copied."""
    from collections.abc import Iterator

    import pandas as pd

    from frametide.operators.detections import BOX

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            for row in batch.itertuples(index=False):
                image = np.frombuffer(row.data, np.uint8).reshape(row.h, row.w, row.channels)[:, :, :3].copy()
                for b in row.boxes if row.boxes is not None else ():
                    x1, y1, x2, y2 = (int(b[c]) for c in BOX[:4])
                    x1, x2 = (min(max(x, 0), row.w - 1) for x in (x1, x2))
                    y1, y2 = (min(max(y, 0), row.h - 1) for y in (y1, y2))
                    colour = (0, int(255 * (1 - b["conf"])), 255)
                    image[[y1, y2], x1 : x2 + 1] = colour
                    image[y1 : y2 + 1, [x1, x2]] = colour
                name = os.path.splitext(row.path.rsplit("/", 1)[-1])[0] + ".png"
                part = os.path.join(folder, f".{name}.{os.getpid()}")
                with open(part, "wb") as f:
                    f.write(encode_png(image[:, :, ::-1]))
                os.replace(part, os.path.join(folder, name))  # a task that runs again puts the same file in place
                yield pd.DataFrame({"path": [row.path]})

    boxes = kept.groupBy("path").agg(F.collect_list(F.struct(*BOX)).alias("boxes"))
    images.join(boxes, "path", "left").select("path", "w", "h", "channels", "data", "boxes").mapInPandas(draw, "path string").count()
