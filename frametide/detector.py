"""The detector is a plug-in: any object with ``detect``, pickled to the workers and made ready once per worker."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

import numpy as np

#: x1, y1, x2, y2, confidence, class.
Detection = tuple[float, float, float, float, float, int]


class Detector(Protocol):
    def detect(self, patches: np.ndarray, conf: float, classes: list[int] | None) -> list[list[Detection]]:
        """Boxes of each patch of a batch (n x size x size x 3), in patch coordinates."""


@dataclass
class BrightBlocks:
    """A deterministic detector for tests and demos: blocks of ``cell`` pixels that are brighter than ``level``.

    A box's confidence is its mean brightness over 255; its class is the strongest channel.
    """

    cell: int = 16
    level: float = 128.0

    def detect(self, patches: np.ndarray, conf: float, classes: list[int] | None) -> list[list[Detection]]:
        n, h, w, channels = patches.shape
        c = self.cell
        down, along = h // c, w // c
        kind = np.uint16 if patches.dtype == np.uint8 and c <= 257 else np.float64  # holds the sum of a column of a cell
        columns = np.add.reduce(patches[:, : down * c, : along * c].reshape(n, down, c, along * c * channels), axis=2, dtype=kind)  # long rows first: most of the work is there
        cells = np.einsum("nyxck->nyxk", columns.reshape(n, down, along, c, channels), dtype=np.float64, casting="safe") / (c * c)  # a sum over short rows, where einsum is faster
        shade = cells.mean(axis=-1)
        out: list[list[Detection]] = [[] for _ in range(n)]
        at, y, x = np.nonzero(shade > self.level)
        for k, top, left, score, kind in zip(at.tolist(), (y * c).tolist(), (x * c).tolist(), (shade[at, y, x] / 255).tolist(), cells[at, y, x].argmax(axis=-1).tolist()):
            if score > conf and (classes is None or kind in classes):
                out[k].append((float(left), float(top), float(left + c), float(top + c), score, kind))
        return out
