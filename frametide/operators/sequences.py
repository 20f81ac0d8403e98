"""Sequence analytics over a run: stable region, staleness, backlog, sampling, ordered emission.

Windows are partitioned by run or stream; each sorts its own rows and spills.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from frametide.operators.telemetry import fps_reference

# How a stable region is recognised.
SPAN = 5
SHORT_SECONDS = 20.0
CV, BAND, IN_BAND = 0.15, 0.15, 0.8
FLOOR_SHARE, TAIL_TOLERANCE, TAIL_SAMPLES = 0.30, 0.35, 5


def stable_region(history: DataFrame, runs: DataFrame | None = None, run: str = "run") -> DataFrame:
    """``run, n, start, end`` (end exclusive) of rows ``run, i, t, fps`` with i = 0, 1, ...

    The tail is trimmed while a sample leaves the band around the median of the five before it. The start is the first of five
    samples, over at least four seconds, that are above a share of the run's high rate, vary little and mostly lie in a band
    about their median. Short runs are taken nearly whole. ``runs`` adds runs without samples, which get (0, 0).
    """
    w = W.partitionBy(run).orderBy("i")
    before, ahead = w.rowsBetween(-TAIL_SAMPLES, -1), w.rowsBetween(0, SPAN - 1)
    positive = F.when(F.col("fps") > 0, F.col("fps"))
    h = history.withColumns({"base": F.percentile(positive, 0.5).over(before)})
    kept = (F.col("i") < SPAN + TAIL_SAMPLES) | F.col("base").isNull() | F.col("fps").between(F.col("base") * (1 - TAIL_TOLERANCE), F.col("base") * (1 + TAIL_TOLERANCE))
    every = W.partitionBy(run)
    h = h.withColumn("end", F.max(F.when(kept, F.col("i"))).over(every) + 1)
    high = F.percentile(F.when(F.col("i") < F.col("end"), positive), 0.9).over(every)
    h = h.withColumn("floor", F.coalesce(F.greatest(F.lit(1.0), high * FLOOR_SHARE), F.lit(0.0)))
    inside = h.filter(F.col("i") < F.col("end"))
    inside = inside.withColumns(
        {
            "cnt": F.count("*").over(ahead), "span": F.max("t").over(ahead) - F.min("t").over(ahead), "med": F.percentile("fps", 0.5).over(ahead),
            "sd": F.stddev_pop("fps").over(ahead), "vals": F.collect_list("fps").over(ahead),
        }
    )
    low, top = F.col("med") * (1 - BAND), F.col("med") * (1 + BAND)
    held = F.size(F.filter("vals", lambda v: (v >= low) & (v <= top)))
    good = (
        (F.col("cnt") == SPAN) & (F.col("span") >= SPAN - 1) & (F.col("med") > F.col("floor")) & (F.try_divide("sd", "med") <= CV)
        & (held >= IN_BAND * SPAN) & F.col("fps").between(low, top)
    )
    found = inside.groupBy(run).agg(F.min(F.when(good, F.col("i"))).alias("first_good"), F.min(F.when(F.col("fps") >= F.col("floor"), F.col("i"))).alias("first_high"), F.max("end").alias("end"))
    whole = history.groupBy(run).agg(F.count("*").alias("n"), (F.max("t") - F.min("t")).alias("seconds"))
    short, few = F.col("seconds") < SHORT_SECONDS, F.col("n") < SPAN
    start = F.when(few, 0).when(short, F.least(F.lit(2), F.col("n") - 1)).otherwise(F.coalesce("first_good", "first_high", F.lit(0)))
    end = F.when(few | short, F.col("n")).otherwise(F.col("end"))
    out = whole.join(found, run).select(run, "n", start.cast("long").alias("start"), F.greatest(start + 1, end).cast("long").alias("end"))
    if runs is None:
        return out
    zero = F.lit(0).cast("long")
    return runs.select(run).join(out, run, "left").select(run, *(F.coalesce(c, zero).alias(c) for c in ("n", "start", "end")))


def stable_fps_stats(history: DataFrame, regions: DataFrame, run: str = "run") -> DataFrame:
    """Least, mean and most fps inside the region, and when the first of the extremes was seen."""
    inside = history.join(regions.select(run, "start", "end"), run).filter("i >= start and i < end")
    return inside.groupBy(run).agg(
        F.min("fps").alias("fps_min"), F.avg("fps").alias("fps_mean"), F.max("fps").alias("fps_max"),
        F.min_by("t", F.struct((-F.col("fps")).alias("a"), F.col("t").alias("b"))).alias("t_max"), F.min_by("t", F.struct("fps", "t")).alias("t_min"),
    )


def staleness(events: DataFrame, stream: str = "stream_id") -> DataFrame:
    """``stream, source_idx, stale_frames, stale_ms`` of emitted frames.

    ``events``: ``stream, t, kind`` (ingest or emit), ``source_idx, fps``. A frame is as stale as the highest index read before it
    is emitted is ahead of it; reading at the same time counts.
    """
    order = W.partitionBy(stream).orderBy("t", F.when(F.col("kind") == "ingest", 0).otherwise(1), "source_idx").rowsBetween(W.unboundedPreceding, 0)
    seen = events.withColumn("top", F.max(F.when(F.col("kind") == "ingest", F.col("source_idx"))).over(order)).filter("kind = 'emit'")
    behind = F.greatest(F.lit(0).cast("long"), F.coalesce("top", "source_idx") - F.col("source_idx"))
    return seen.select(stream, "source_idx", behind.alias("stale_frames"), (behind * 1000.0 / fps_reference(F.lit(None).cast("double"), F.col("fps"))).alias("stale_ms"))


def dispatch_backlog(events: DataFrame, stream: str = "stream_id") -> DataFrame:
    """The event log with ``backlog``: frames dispatched less frames emitted so far. ``kind``: dispatch or emit."""
    order = W.partitionBy(stream).orderBy("t", "kind", "source_idx").rowsBetween(W.unboundedPreceding, 0)
    return events.withColumn("backlog", F.sum(F.when(F.col("kind") == "dispatch", 1).when(F.col("kind") == "emit", -1).otherwise(0)).over(order).cast("long"))


def queue_depth_samples(logged: DataFrame, millis: int = 250, stream: str = "stream_id") -> DataFrame:
    """The last state in each interval of ``millis`` that has one: ``stream, bin, t, backlog``."""
    bin_ = F.floor(F.col("t") / millis).cast("long")
    last = F.max(F.struct("t", "kind", "source_idx", "backlog")).alias("last")
    return logged.groupBy(stream, bin_.alias("bin")).agg(last).select(stream, "bin", "last.t", "last.backlog")


def ordered(emitted: DataFrame, index: str = "frame_idx", limit: int | None = None) -> DataFrame:
    """In frame order; the first ``limit`` frames where one is given (a top-k, not a global sort)."""
    out = emitted.orderBy(index)
    return out if limit is None else out.limit(limit)


def emission(results: DataFrame, dispatched: DataFrame, dropped: DataFrame) -> DataFrame:
    """Results of frames that were not dropped, with what is known of their dispatch: source index (else the frame's own), backlog and latency."""
    known = dispatched.select("frame_idx", "source_idx", "dispatch_ms", "backlog")
    alive = results.join(dropped.select("frame_idx"), "frame_idx", "left_anti").join(known, "frame_idx", "left")
    return alive.select(
        "frame_idx", F.coalesce("source_idx", "frame_idx").alias("source_idx"), F.coalesce("backlog", F.lit(0)).cast("long").alias("dispatch_backlog"),
        (F.col("result_ms") - F.col("dispatch_ms")).cast("double").alias("dispatch_to_result_ms"),
    )
