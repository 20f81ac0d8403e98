"""A live source of frames for Structured Streaming: numbered ``.npy`` frames of a folder that may still be growing.

The source itself lists names, a micro-batch at a time; executors open the files. The offset is the name of the last frame seen, and a
frame's index is the number in its name.
``stride`` and ``offset`` choose frames before they are opened, ``rows`` bounds a micro-batch (admission), and ``fps_cap`` bounds frames
a second. With ``policy`` (drop_oldest, drop_newest, latest_only) frames that wait together beyond ``rows`` are dropped by it; without
one they wait.
"""

from __future__ import annotations

import os
import re
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

NAMES = "source_idx bigint, path string"
SCHEMA = "source_idx bigint, w int, h int, channels int, data binary"


def _number(name: str) -> int:
    digits = re.findall("[0-9]+", name)
    if not digits:
        raise ValueError(f"a frame's name must hold its number: {name}")
    return int(digits[-1])


def sampled_names(path: str, stride: int = 1, offset: int = 0) -> list[str]:
    """The frames of a folder that a run samples, in the order of their names."""
    names = sorted(n for n in os.listdir(path) if n.endswith(".npy"))
    return names if stride <= 1 else [n for n in names if _number(n) % stride == offset]


class FrameFolder(DataSource):
    """Options: ``path``, ``stride`` (1), ``offset`` (0), ``rows`` (64), ``fps_cap`` (none), ``policy`` (none)."""

    @classmethod
    def name(cls) -> str:
        return "framefolder"

    def schema(self) -> str:
        return NAMES

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Reader(self.options)


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, options) -> None:
        self.path = options["path"]
        self.stride, self.first = max(1, int(options.get("stride", 1))), int(options.get("offset", 0))
        self.rows, self.cap = int(options.get("rows", 64)), float(options.get("fps_cap", 0) or 0)
        self.policy = options.get("policy", "")
        if self.policy == "latest_only":
            self.rows = 1
        self.last = 0.0
        if not os.path.isdir(self.path):
            raise ValueError(f"the source can't be opened: {self.path}")

    def _chosen(self, after: str, to: str | None = None) -> list[str]:
        """The names of the sampled frames behind ``after``, up to ``to``. A frame's number is in its name, so names that come later change no
        offset; one that sorts before the last frame seen is too late."""
        return [n for n in sampled_names(self.path, self.stride, self.first) if n > after and (to is None or n <= to)]

    def _admitted(self, names: list[str]) -> list[str]:
        """What a queue of ``rows`` frames keeps of frames that wait together, by the drop policy."""
        if not self.policy or len(names) <= self.rows:
            return names
        return names[: self.rows] if self.policy == "drop_newest" else names[-1:] if self.policy == "latest_only" else names[-self.rows :]

    def _rows(self, names: list[str]) -> Iterator[tuple]:
        return iter([(_number(n), os.path.join(self.path, n)) for n in self._admitted(names)])

    def initialOffset(self) -> dict:
        return {"last": ""}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        names, n = self._chosen(start["last"]), self.rows
        if self.cap > 0:
            now = time.time()
            n = min(n, max(1, int(self.cap * (now - self.last)))) if self.last else 1
            self.last = now
        if not self.policy:
            names = names[:n]  # the rest waits
        return self._rows(names), {"last": names[-1] if names else start["last"]}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return self._rows(self._chosen(start["last"], end["last"]))

    def commit(self, end: dict) -> None:
        pass


def _pixels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import numpy as np

    for batch in batches:
        for i, path in zip(batch["source_idx"], batch["path"]):
            image = np.load(path).astype(np.uint8)
            h, w, c = image.shape
            yield pd.DataFrame({"source_idx": [i], "w": [w], "h": [h], "channels": [c], "data": [image.tobytes()]})


def read_frames(spark: SparkSession, path: str, **options) -> DataFrame:
    """A streaming DataFrame of the folder's frames (``SCHEMA``). The folder must be shared with the executors."""
    spark.dataSource.register(FrameFolder)
    reader = spark.readStream.format("framefolder").option("path", path)
    for key, value in options.items():
        if value is not None:
            reader = reader.option(key, str(value))
    return reader.load().mapInPandas(_pixels, SCHEMA)
