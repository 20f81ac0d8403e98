"""The report of a run: summary rows, console lines, trace document and plot data."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frametide.operators import sequences as S
from frametide.operators import telemetry as M

#: Runs that wrote no more frames than this get a rate alone.
LEAST_FRAMES = 10
TRACE = "latency_trace_detailed.json"


@dataclass
class Report:
    avg_fps: float
    stable: dict
    lines: list[str]
    trace_path: str | None = None


def plot_data(history: DataFrame, run: str = "run", least: int = 10) -> DataFrame:
    """``t, fps, stable``: the rate over time, with the stable region marked where there are enough samples to draw it."""
    marked = history.join(S.stable_region(history, run=run), run)
    inside = (F.col("n") >= least) & (F.col("i") >= F.col("start")) & (F.col("i") < F.col("end"))
    return marked.select(run, "i", "t", "fps", inside.alias("stable")).orderBy(run, "i")


def write_report(history: DataFrame, timings: DataFrame, queue: DataFrame, records: DataFrame, wall_s: float, output: str | None = None) -> Report:
    """Summarise one run. All that reaches the driver are single rows.

    ``history``: ``run, i, t, fps``; ``timings``: see :func:`frametide.operators.telemetry.average_timings`; ``queue``: one row of counters and
    ``bounded_latency, max_in_flight, drop_policy``; ``records``: ``dispatch_to_result_ms, dispatch_to_write_ms, dispatch_backlog, stale_frames, stale_ms``.
    """
    control = M.queue_control(queue)
    q = control.first()
    written = q["frames_written"]
    avg_fps = written / wall_s if wall_s > 0 else 0.0
    found = S.stable_fps_stats(history, S.stable_region(history)).first()
    stable = found.asDict() if found else {}
    lines = [f"Average FPS: {avg_fps:.2f}"]
    if stable:
        lines.append(f"Stable FPS: min {stable['fps_min']:.2f}, mean {stable['fps_mean']:.2f}, max {stable['fps_max']:.2f}")
    if written <= LEAST_FRAMES:
        return Report(avg_fps, stable, lines)
    t = M.average_timings(timings).withColumn("limit", M.bottleneck(F.col("inference"), F.col("preprocess"), F.col("read"))).first()
    lines += [f"{name}: {t[c] * 1000:.2f} ms" for name, c in (("Read", "read"), ("Preprocess", "preprocess"), ("Inference", "inference"), ("Suppression", "nms"), ("Drawing", "visual"))]
    lines.append(f"End to end: {1000 / avg_fps if avg_fps > 0 else 0:.2f} ms")
    lines += [
        f"Queue: {q['attempted']} seen, {written} written, {q['frames_dropped']} dropped ({q['drop_rate']:.2f}%), {q['retained_fps']:.2f} FPS retained",
        *(f"{r['metric']}: p50={r['p50']:.2f}, p95={r['p95']:.2f}, p99={r['p99']:.2f}" for r in M.latency_trace_summary(records).collect()),
        f"Bottleneck: {t['limit']}",
    ]
    path = None
    if output:
        path = os.path.join(output, TRACE)
        os.makedirs(output, exist_ok=True)
        body = json.loads(M.latency_trace_document(records, control).first()["document"])
        body["summary"]["queue_control"] |= {"run_wall_time_s": wall_s, "observed_throughput_fps": avg_fps}
        with open(path, "w", encoding="utf-8") as f:
            json.dump(body, f, indent=2)
    return Report(avg_fps, stable, lines, path)


HISTORY = "run long, i long, t double, fps double"


def history_of(spark: SparkSession, log: list[dict]) -> DataFrame:
    """``run, i, t, fps`` of a run's batches: ``log`` has a row for each, with ``began, ended, frames``."""
    began = min((b["began"] for b in log), default=0.0)
    rows = [(0, i, b["ended"] - began, b["frames"] / max(b["ended"] - b["began"], 1e-9)) for i, b in enumerate(log)]
    return spark.createDataFrame(rows, HISTORY)


def of_run(spark: SparkSession, log: list[dict], seen: int, written: int, wall_s: float, settings, output: str | None = None) -> Report:
    """The report of a live run from its batch log. A frame's latency is its batch's; reading and suppression are part of that."""
    batches = spark.createDataFrame([(b["frames"], b["ended"] - b["began"]) for b in log], "frames long, seconds double")
    each = batches.filter("frames > 0").select("frames", "seconds", F.explode(F.sequence(F.lit(1), F.col("frames"))))
    taken = F.col("seconds") / F.col("frames")
    none = F.lit(None).cast("double")
    timings = each.select(taken.alias("total"), taken.alias("inference"), none.alias("nms"), none.alias("read"), none.alias("preprocess"), none.alias("visual"), F.lit(wall_s).alias("wall_s"))
    ms = F.col("seconds") * 1000
    records = each.select(ms.alias("dispatch_to_result_ms"), ms.alias("dispatch_to_write_ms"), (F.col("frames") - 1).alias("dispatch_backlog"), F.lit(0).alias("stale_frames"), F.lit(0.0).alias("stale_ms"))
    emitted = sum(b["frames"] for b in log)
    counters = [(seen, written, seen - emitted if settings.bounded_latency else 0, settings.input_fps_cap, None, settings.bounded_latency, settings.max_in_flight, settings.drop_policy)]
    queue = spark.createDataFrame(counters, "frames_seen long, frames_written long, frames_dropped long, input_fps_cap double, loader_fps double, bounded_latency boolean, max_in_flight int, drop_policy string")
    return write_report(history_of(spark, log), timings, queue, records, wall_s, output)


def write_plot(history: DataFrame, path: str) -> None:
    """What a plot of the run shows, as JSON: a row for each batch."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump([r.asDict() for r in plot_data(history, least=1).collect()], f, indent=2)
