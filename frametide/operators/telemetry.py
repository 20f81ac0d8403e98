"""Run telemetry: percentiles, rates, queue control, latency by backlog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frametide.functions import text

DEFAULT_FPS = 30.0
MAX_IN_FLIGHT = 64
#: Backlog buckets: name, least, most.
BUCKETS = (("q_0_15", None, 15), ("q_16_31", 16, 31), ("q_32_plus", 32, None))
SUMMARY = ("mean", "p50", "p95", "p99", "min", "max")


def summary(value: Column) -> list[Column]:
    """Aggregates ``count, mean, p50, p95, p99, min, max``: linear interpolation, zeros where there is no value."""
    v = value.cast("double")
    at = F.percentile(v, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))

    def or_zero(x: Column) -> Column:
        return F.coalesce(x, F.lit(0.0))

    return [
        F.count(v).alias("count"), or_zero(F.avg(v)).alias("mean"),
        *(or_zero(F.get(at, F.lit(i))).alias(n) for i, n in enumerate(("p50", "p95", "p99"))),
        or_zero(F.min(v)).alias("min"), or_zero(F.max(v)).alias("max"),
    ]


def summary_struct(value: Column) -> Column:
    """The same as one struct, for nested documents."""
    return F.struct(*summary(value))


def average_timings(samples: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``worker_total, inference, nms, read, preprocess, visual, e2e_ms`` of ``total, inference, nms, read, preprocess, visual`` seconds.

    A missing value of the first three is no sample; reading and preprocessing are shared out over all frames that were read,
    drawing over those that were drawn. ``e2e_ms`` is 1000 over the average rate, ``wall_s`` being the run's seconds.
    """

    def share(total: str, n: Column) -> Column:
        return F.coalesce(F.try_divide(F.sum(total), n), F.lit(0.0)).alias(total)

    rate = F.try_divide(F.count("*").cast("double"), F.max("wall_s"))
    return samples.groupBy(*(by or [])).agg(
        F.coalesce(F.avg("total"), F.lit(0.0)).alias("worker_total"), F.coalesce(F.avg("inference"), F.lit(0.0)).alias("inference"),
        F.coalesce(F.avg("nms"), F.lit(0.0)).alias("nms"), share("read", F.count("read")), share("preprocess", F.count("read")), share("visual", F.count("visual")),
        F.coalesce(F.try_divide(F.lit(1000.0), rate), F.lit(0.0)).alias("e2e_ms"),
    )


def bottleneck(inference: Column, preprocess: Column, read: Column) -> Column:
    return F.when((inference > preprocess) & (inference > read), "GPU Inference").otherwise("CPU Preprocessing/Reading")


def fps_reference(cap: Column, loader: Column) -> Column:
    """The cap where it is positive, else the source's rate, else 30."""
    return F.when(cap > 0, cap).when(loader > 0, loader).otherwise(DEFAULT_FPS)


def queue_control(runs: DataFrame) -> DataFrame:
    """Adds ``attempted, retain_ratio, fps_reference, retained_fps, drop_rate`` to rows with the counters of a run."""
    seen, written, lost = F.col("frames_seen"), F.col("frames_written"), F.col("frames_dropped")
    attempted = F.when(seen > 0, seen).otherwise(written + lost)
    ratio = F.coalesce(F.try_divide(written.cast("double"), attempted), F.lit(0.0))
    reference = fps_reference(F.col("input_fps_cap"), F.col("loader_fps")).cast("double")
    return runs.withColumns(
        {
            "attempted": attempted,
            "retain_ratio": ratio,
            "fps_reference": reference,
            "retained_fps": reference * ratio,
            "drop_rate": F.coalesce(F.try_divide(lost * F.lit(100.0), attempted), F.lit(0.0)),
        }
    )


def drops_by_policy(dropped: DataFrame, by: list[str]) -> DataFrame:
    """Counts ``drop_oldest, drop_newest, latest_only`` of rows with a ``policy``; a policy without drops counts zero."""
    return dropped.groupBy(*by).agg(*(F.count_if(F.col("policy") == p).alias(p) for p in text.POLICIES))


def normalized_controls(rows: DataFrame, default: int = MAX_IN_FLIGHT) -> DataFrame:
    """``max_in_flight, drop_policy, input_fps_cap`` as a run uses them."""
    cap = F.col("input_fps_cap").try_cast("double")
    limit = F.when(F.col("max_in_flight") >= 1, F.col("max_in_flight")).otherwise(default)
    name = text.policy(F.coalesce("drop_policy", F.lit("")))
    return rows.withColumns({"max_in_flight": F.when(name == "latest_only", 1).otherwise(limit), "drop_policy": name, "input_fps_cap": F.when(cap > 0, cap)})


def bucket(backlog: Column) -> Column:
    return F.when(backlog <= 15, BUCKETS[0][0]).when(backlog <= 31, BUCKETS[1][0]).when(backlog >= 32, BUCKETS[2][0])


def latency_by_backlog(records: DataFrame) -> DataFrame:
    """A summary of ``dispatch_to_write_ms`` per backlog bucket; an empty bucket has zeros."""
    names = records.sparkSession.createDataFrame([(n,) for n, _, _ in BUCKETS], "bucket string")
    found = records.filter("dispatch_to_write_ms is not null").groupBy(bucket(F.col("dispatch_backlog")).alias("bucket"))
    found = found.agg(*summary(F.col("dispatch_to_write_ms")))
    joined = names.join(found, "bucket", "left")
    return joined.select("bucket", F.coalesce("count", F.lit(0)).alias("count"), *(F.coalesce(c, F.lit(0.0)).alias(c) for c in SUMMARY))


def latency_trace_summary(records: DataFrame) -> DataFrame:
    """``metric`` and its summary for latencies, backlog and staleness, in one pass over the records."""
    metrics = ("dispatch_to_result_ms", "dispatch_to_write_ms", "dispatch_backlog", "stale_frames", "stale_ms")
    one = records.agg(*(summary_struct(F.col(m)).alias(m) for m in metrics))
    rows = one.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("s")) for m in metrics))).alias("r"))
    return rows.select("r.metric", "r.s.*")


def malformed_by_device(parsed: DataFrame, examples: int = 5) -> DataFrame:
    """``device, n, first_lines``: malformed lines per device and the first few of them by arrival."""
    bad = parsed.filter("malformed")
    firsts = F.array_sort(F.collect_list(F.struct("seq", "line")))
    counts = bad.groupBy("device").agg(F.count("*").alias("n"))
    from pyspark.sql import Window as W

    top = bad.withColumn("r", F.row_number().over(W.partitionBy("device").orderBy("seq"))).filter(F.col("r") <= examples)
    lines = top.groupBy("device").agg(F.transform(firsts, lambda x: x["line"]).alias("first_lines"))
    return counts.join(lines, "device")


def fps_bins(emitted: DataFrame, run: str, t: str) -> DataFrame:
    """``run, i, fps``: frames per whole second of a run from its first frame to its last; empty seconds have zero.

    ``t`` is in seconds since the run's start.
    """
    second = F.floor(t).cast("long")
    counts = emitted.groupBy(run, second.alias("i")).agg(F.count("*").cast("double").alias("fps"))
    ends = counts.groupBy(run).agg(F.min("i").alias("a"), F.max("i").alias("b"))
    bins = ends.select(run, F.explode(F.sequence("a", "b")).alias("i"))
    return bins.join(counts, [run, "i"], "left").select(run, "i", F.coalesce("fps", F.lit(0.0)).alias("fps"))


def latency_trace_document(records: DataFrame, queue: DataFrame) -> DataFrame:
    """One row ``document``: the trace as JSON, with ``queue`` (one row of counters, see :func:`queue_control`)."""
    metrics = ("dispatch_to_result_ms", "dispatch_to_write_ms", "dispatch_backlog", "stale_frames", "stale_ms")
    buckets = [F.struct(*summary(F.when(bucket(F.col("dispatch_backlog")) == n, F.col("dispatch_to_write_ms")))).alias(n) for n, _, _ in BUCKETS]
    one = records.agg(*(summary_struct(F.col(m)).alias(m) for m in metrics), *buckets)
    q = queue.first()  # one row of counters
    if q is None:
        raise ValueError("the run has no counters")
    kinds = queue.schema

    def counter(name: str, alias: str | None = None) -> Column:
        return F.lit(q[name]).cast(kinds[name].dataType).alias(alias or name)

    control = F.struct(
        *(counter(n) for n in ("bounded_latency", "max_in_flight", "drop_policy", "input_fps_cap", "fps_reference")), counter("attempted", "frames_seen"), counter("frames_written"),
        counter("frames_dropped"), counter("drop_rate", "drop_rate_percent"), counter("retain_ratio"), counter("retained_fps", "retained_fps_estimate"),
    )
    parts = {"queue_control": control, **{m: F.col(m) for m in metrics[:2]}, "queue_backlog_frames": F.col("dispatch_backlog"), "freshness_lag_frames": F.col("stale_frames"), "freshness_lag_ms": F.col("stale_ms"), "queue_conditioned_dispatch_to_write_ms": F.struct(*(n for n, _, _ in BUCKETS))}
    return one.select(F.to_json(F.struct(F.struct(*(v.alias(k) for k, v in parts.items())).alias("summary")), {"ignoreNullFields": "false"}).alias("document"))
