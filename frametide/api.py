"""Programmatic entry: one object with settings and a detector."""

from __future__ import annotations

import dataclasses
import os
import time
import uuid
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from frametide import report
from frametide.detector import Detector
from frametide.operators import detections as D
from frametide.plans import detect as plan
from frametide.scratch import deleted, shared_folder
from frametide.settings import Settings, normalize_controls
from frametide.sources import frames, images, sinks
from frametide.streaming import detect as live

#: The size that images are letterboxed to unless ``resize`` says otherwise.
BUFFER = (3840, 2160)


class TiledDetector:
    """Detection on images, folders and frame streams. Settings given to a call hold for that call alone."""

    def __init__(self, detector: Detector, spark: SparkSession | None = None, **settings: Any) -> None:
        self.detector = detector
        self.spark = spark or SparkSession.builder.getOrCreate()
        self.settings = Settings(**settings)
        self.report: report.Report | None = None
        self._work: list[str] = []

    def _with(self, changes: dict[str, Any]) -> Settings:
        s = dataclasses.replace(self.settings, **changes)
        s.max_in_flight, s.drop_policy, s.input_fps_cap = normalize_controls(s.max_in_flight, s.drop_policy, s.input_fps_cap)
        return s

    def predict(self, image: np.ndarray, **settings: Any) -> list[list]:
        """Boxes ``[x1, y1, x2, y2, conf, cls]`` of an image in memory, best first."""
        return plan.predict(self.spark, image, self.detector, self._with(settings))

    def detect_images(self, path: str, **settings: Any) -> DataFrame:
        """``path, rank, x1 .. cls`` of an image or of a folder's images, as a table of any size."""
        s = self._with(settings)
        return plan.detect(images.read_images(self.spark, path), self.detector, s, buffer=s.resize or BUFFER)

    def predict_image(self, path: str, output: str | None = None, **settings: Any) -> dict[str, list[list]]:
        """Path to boxes. With ``output``, ``save_json`` writes ``detections.json`` there and ``save`` the images with their boxes drawn."""
        s = self._with(settings)
        rows = images.read_images(self.spark, path)
        raw = plan.raw_boxes(rows, self.detector, s, buffer=s.resize or BUFFER).persist()  # boxes, not pixels: each image is decoded and seen once
        found, listed = plan.finished(raw), raw.filter("conf is null")
        if output and s.save_json:
            sinks.write_image_map(D.image_documents(listed, found), os.path.join(output, "detections.json"))
        if output and s.save:
            sinks.write_annotated(rows, found, output)
        result: dict[str, list[list]] = {r["path"]: [] for r in listed.select("path").orderBy("path").toLocalIterator()}
        for r in found.orderBy("path", "rank").toLocalIterator():
            result[r["path"]].append([r[c] for c in D.BOX])
        raw.unpersist()
        return result

    def predict_video(self, path: str, output: str | None = None, **settings: Any) -> DataFrame:
        """``frame_idx, detections`` of a folder of numbered frames, in order.

        With ``bounded_latency``, frames that wait beyond ``max_in_flight`` are dropped by ``drop_policy``. Into ``output``, ``save_json`` writes
        one array and the trace of the run, ``plot_fps`` the rate over time. ``self.report`` holds the run's report.
        """
        s = self._with(settings)
        work = f"{shared_folder(self.spark)}/run-{uuid.uuid4().hex}"
        self._work.append(work)
        policy = s.drop_policy if s.bounded_latency else None
        rows = frames.read_frames(self.spark, path, stride=s.stride, offset=s.offset, rows=s.max_in_flight, fps_cap=s.input_fps_cap, policy=policy)
        log: list[dict] = []
        schema = "frame_idx long, detections array<struct<bbox:array<double>,conf:double,class:int>>"
        self.spark.createDataFrame([], schema).write.parquet(f"{work}/documents/batch=-1")
        began = time.time()
        live.run(rows, self.detector, s, lambda d, n: d.write.mode("overwrite").parquet(f"{work}/documents/batch={n}"), f"{work}/state", log=log)
        wall = time.time() - began
        done = self.spark.read.schema(schema + ", batch int").parquet(f"{work}/documents").drop("batch").orderBy("frame_idx")
        done = done if s.num_frames is None else done.limit(s.num_frames)
        name = os.path.splitext(os.path.basename(path.rstrip("/")))[0]
        written = sinks.write_frame_array(done, os.path.join(output, name + ".json")) if output and s.save_json else done.count()
        seen = len(frames.sampled_names(path, s.stride, s.offset))
        self.report = report.of_run(self.spark, log, seen, written, wall, s, output if s.save_json else None)
        if output and s.plot_fps:
            report.write_plot(report.history_of(self.spark, log), os.path.join(output, name + "_fps.json"))
        return done

    def cleanup(self) -> None:
        while self._work:
            deleted(self.spark, self._work.pop())

    def __enter__(self) -> TiledDetector:
        return self

    def __exit__(self, *_: object) -> None:
        self.cleanup()
