"""Drop policies on live data: the rules of :mod:`frametide.operators.policy` as keyed state of a streaming query."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from frametide.operators.policy import OUTCOME, TYPES, Admission


def admit(events: DataFrame, policy: str, cap: int) -> DataFrame:
    """Decided frames of a stream of ``stream_id, t, kind, source_idx`` (see :func:`frametide.operators.policy.replay`).

    Within a micro-batch a stream's events are taken in order of time; across batches in order of arrival, so with events delivered in
    time order the rows are those of the replay. The state is what is in flight.
    """
    if policy == "latest_only":
        cap = 1
    Admission(policy, cap)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stream = Admission(policy, cap, *(pickle.loads(state.get[0]) if state.exists else ()))
        rows = pd.concat(list(frames))
        rows["first"] = (rows["kind"] != "completion").astype(int)
        out = []
        for r in rows.sort_values(["t", "first", "source_idx"]).itertuples(index=False):
            decided = stream.arrive(r.source_idx) if r.first else stream.complete(r.source_idx)
            out += [(key[0], *x, r.t) for x in decided]
        held = (stream.next_emit, stream.dispatched, stream.source, stream.done, stream.evicted, stream.frame_of)
        state.update((pickle.dumps(held),))
        yield pd.DataFrame(out, columns=["stream_id", "source_idx", "frame_idx", "outcome", "t"]).astype(TYPES)

    return events.groupBy("stream_id").applyInPandasWithState(run, OUTCOME, "state binary", "append", GroupStateTimeout.NoTimeout)
