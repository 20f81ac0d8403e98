"""Admission of frames under a cap: drop_oldest, drop_newest, latest_only.

The policies depend on the order of arrivals and completions, so each stream is replayed in that order. Streams are dealt by key and
sorted; a task reads its rows one after another and holds no more than the frames in flight, so a stream of any length
needs bounded memory. :mod:`frametide.streaming.admission` runs the same rules on live data.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frametide.functions.text import POLICIES

OUTCOME = "stream_id long, source_idx long, frame_idx long, outcome string, t long"

#: Of the pandas frames that carry outcomes; a dropped frame has no frame index.
TYPES = {"stream_id": "int64", "source_idx": "int64", "frame_idx": "Int64", "outcome": "object", "t": "int64"}


@dataclass
class Admission:
    """State of one stream. ``next_emit`` and ``dispatched`` count frames; ``source`` has those in flight by frame index."""

    policy: str
    cap: int
    next_emit: int = 0
    dispatched: int = 0
    source: dict[int, int] = field(default_factory=dict)
    done: set[int] = field(default_factory=set)
    evicted: set[int] = field(default_factory=set)
    frame_of: dict[int, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.policy not in POLICIES or self.cap < 1:
            raise ValueError("unknown policy, or a cap below one")

    def _advance(self) -> Iterator[tuple[int, int, str]]:
        while self.next_emit in self.done or self.next_emit in self.evicted:
            k = self.next_emit
            if k in self.done:
                self.done.discard(k)
                yield self.source.pop(k), k, "emitted"
            self.evicted.discard(k)
            self.next_emit += 1

    def arrive(self, source_idx: int) -> Iterator[tuple[int, int | None, str]]:
        """What is decided when a frame arrives: ``(source index, frame index, outcome)``."""
        if self.dispatched - self.next_emit >= self.cap:
            live = min((k for k in self.source if k not in self.done), default=None)
            if self.policy == "drop_newest" or live is None:
                yield source_idx, None, "dropped"
                return
            old = self.source.pop(live)
            self.frame_of.pop(old, None)
            self.evicted.add(live)
            yield old, live, "evicted"
            yield from self._advance()
        self.source[self.dispatched] = source_idx
        self.frame_of[source_idx] = self.dispatched
        self.dispatched += 1

    def complete(self, source_idx: int) -> Iterator[tuple[int, int, str]]:
        """A result came in; that of a frame which is not in flight is ignored."""
        k = self.frame_of.pop(source_idx, None)
        if k is not None:
            self.done.add(k)
            yield from self._advance()


def replay(events: DataFrame, policy: str, cap: int) -> DataFrame:
    """``stream_id, source_idx, frame_idx, outcome, t`` for each decided frame, emitted ones in frame order.

    ``events``: ``stream_id, t, kind`` (arrival or completion), ``source_idx``. At equal times completions come first, then lower indices.
    Frames still in flight at the end have no row.
    """
    if policy == "latest_only":
        cap = 1
    Admission(policy, cap)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, state = None, None
        for frame in frames:
            out = []
            for s, t, first, i in zip(frame["stream_id"].tolist(), frame["t"].tolist(), frame["first"].tolist(), frame["source_idx"].tolist()):
                if s != stream:
                    stream, state = s, Admission(policy, cap)
                out += [(s, *x, t) for x in (state.complete(i) if not first else state.arrive(i))]
            yield pd.DataFrame(out, columns=["stream_id", "source_idx", "frame_idx", "outcome", "t"]).astype(TYPES)

    order = F.when(F.col("kind") == "completion", 0).otherwise(1).alias("first")
    rows = events.select("stream_id", "t", order, "source_idx").repartition("stream_id").sortWithinPartitions("stream_id", "t", "first", "source_idx")
    return rows.mapInPandas(run, OUTCOME)
