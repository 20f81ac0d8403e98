"""Live detection: frames in, documents out in frame order.

Offsets of the source grow with the frame index, so each micro-batch holds later frames than the one before; sorting inside the
batch then gives an ordered output without a global sort.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from frametide.detector import Detector
from frametide.operators import detections as D
from frametide.plans.detect import finished, raw_boxes
from frametide.settings import Settings


def documents(frames: DataFrame, detector: Detector, s: Settings) -> tuple[DataFrame, DataFrame]:
    """``frame_idx, detections`` per frame of a batch, empty where nothing was found, in order; and what it is made of, stored for the batch.

    Boxes and the list of frames come from one pass over the pixels.
    """
    raw = raw_boxes(frames.withColumnRenamed("source_idx", "frame_idx"), detector, s, key="frame_idx").persist()
    return D.frame_documents(raw.filter("conf is null"), finished(raw, key="frame_idx")).orderBy("frame_idx"), raw


def run(frames: DataFrame, detector: Detector, s: Settings, sink: Callable[[DataFrame, int], None], checkpoint: str, drain: bool = True, log: list[dict] | None = None) -> StreamingQuery:
    """Start the query. ``sink(documents, batch)`` is called for every micro-batch; a failed batch is retried as it was.

    With ``drain`` it takes what the source has now, batch by batch, and stops; else it goes on until it is stopped. ``log`` gets a row for
    each batch: ``batch, began, ended, frames``.
    """

    def batch(rows: DataFrame, number: int) -> None:
        began = time.time()
        made, raw = documents(rows, detector, s)
        sink(made, number)
        if log is not None:
            log.append({"batch": number, "began": began, "ended": time.time(), "frames": raw.filter("conf is null").count()})
        raw.unpersist()

    query = frames.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
    if drain:
        query.processAllAvailable()
        query.stop()
    return query
