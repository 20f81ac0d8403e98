import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from frametide.functions import text
from frametide.operators import sequences as S
from frametide.operators import telemetry as M
from frametide.operators.policy import Admission, replay

FPS = [0, 0, 0, 0, 0, 1, 4, 11, 32, 40, 40, 40, 40, 40, 40, 48, 40, 40, 48, 40, 56, 56, 48, 56, 80]
HISTORY = "run int, i long, t double, fps double"


def test_percentiles_and_empty(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=101).tolist()
    got = spark.createDataFrame([(x,) for x in v], "v double").agg(*M.summary(F.col("v"))).first()
    assert got["count"] == 101 and got["p95"] == pytest.approx(np.percentile(v, 95)) and got["mean"] == pytest.approx(np.mean(v))
    assert tuple(spark.createDataFrame([], "v double").agg(*M.summary(F.col("v"))).first()) == (0, 0, 0, 0, 0, 0, 0)


def test_stable_region(spark):
    h = spark.createDataFrame([(1, i, float(i), float(f)) for i, f in enumerate(FPS)], HISTORY)
    runs = spark.createDataFrame([(1,), (2,)], "run int")
    got = {r.run: (r.start, r.end) for r in S.stable_region(h, runs).collect()}
    assert got == {1: (9, 24), 2: (0, 0)}


def stable(values, times):
    """From the definition, sample by sample."""
    n = len(values)
    if n < 5:
        return 0, n
    if times[-1] - times[0] < 20:
        return min(2, n - 1), n
    end = n
    while end > 10:
        base = [v for v in values[end - 6 : end - 1] if v > 0]
        if not base or 0.65 * np.median(base) <= values[end - 1] <= 1.35 * np.median(base):
            break
        end -= 1
    positive = [v for v in values[:end] if v > 0]
    floor = max(1.0, 0.3 * np.percentile(positive, 90)) if positive else 0.0
    for i in range(end - 4):
        w = np.array(values[i : i + 5])
        m = np.median(w)
        if times[i + 4] - times[i] < 4 or m <= floor:
            continue
        band = (w >= 0.85 * m) & (w <= 1.15 * m)
        if np.std(w) / m <= 0.15 and band.mean() >= 0.8 and band[0]:
            return i, max(i + 1, end)
    start = next((i for i in range(end) if values[i] >= floor), 0)
    return start, max(start + 1, end)


def test_stable_region_against_definition(spark):
    rng = random.Random(3)
    runs = {}
    for r in range(60):
        n = rng.randrange(1, 45)
        step = rng.choice([0.5, 1.0, 1.5])
        base = rng.randrange(5, 60)
        runs[r] = ([float(max(0, round(base * min(1, i / 6) * rng.choice([1, 1, 1, 0.9, 1.1, 1.6, 0])))) for i in range(n)], [i * step for i in range(n)])
    h = spark.createDataFrame([(r, i, t, v) for r, (vs, ts) in runs.items() for i, (v, t) in enumerate(zip(vs, ts))], HISTORY)
    got = {r.run: (r.start, r.end) for r in S.stable_region(h).collect()}
    assert got == {r: stable(*x) for r, x in runs.items()}


def test_queue_control(spark):
    rows = spark.createDataFrame([(10, 8, 2, None, 25.0), (0, 3, 1, 12.0, 0.0), (0, 0, 0, -1.0, None)], "frames_seen long, frames_written long, frames_dropped long, input_fps_cap double, loader_fps double")
    a, b, c = M.queue_control(rows).collect()
    assert (a.attempted, a.retained_fps, a.retain_ratio, a.drop_rate) == (10, 20.0, 0.8, 20.0)
    assert (b.attempted, b.fps_reference, b.drop_rate) == (4, 12.0, 25.0)
    assert (c.attempted, c.fps_reference, c.retain_ratio, c.drop_rate) == (0, 30.0, 0.0, 0.0)


def test_latency_buckets(spark):
    df = spark.createDataFrame([(5, 10.0), (20, 20.0), (40, 30.0), (41, None)], "dispatch_backlog int, dispatch_to_write_ms double")
    got = {r.bucket: (r["count"], r.mean) for r in M.latency_by_backlog(df).collect()}
    assert got == {"q_0_15": (1, 10.0), "q_16_31": (1, 20.0), "q_32_plus": (1, 30.0)}
    empty = {r.bucket: r["count"] for r in M.latency_by_backlog(df.limit(0)).collect()}
    assert empty == {"q_0_15": 0, "q_16_31": 0, "q_32_plus": 0}


def test_controls_and_sources(spark):
    df = spark.createDataFrame([(None, " BAD ", "not-a-number"), (99, "latest_only", "30"), (0, None, "-2")], "max_in_flight int, drop_policy string, input_fps_cap string")
    assert [tuple(r) for r in M.normalized_controls(df).collect()] == [(64, "drop_oldest", None), (1, "latest_only", 30.0), (64, "drop_oldest", None)]
    names = spark.createDataFrame([("rtsp://cam",), ("0",), ("video.mp4",), ("httpfoo.mp4",)], "s string")
    assert [r[0] for r in names.select(text.is_stream(F.col("s"))).collect()] == [True, True, False, True]


@pytest.mark.parametrize(
    "source, save, js, want",
    [("demo.mp4", True, True, ("demo.mp4", "out/demo.mp4", "out/demo.json")), ("0", False, True, ("stream_output.mp4", None, "out/stream_output.json")), ("a/.hidden", False, True, (".hidden", None, "out/.hidden.json")), ("a/b.c.mp4", True, True, ("b.c.mp4", "out/b.c.mp4", "out/b.c.json"))],
)
def test_output_paths(spark, source, save, js, want):
    row = spark.createDataFrame([(source,)], "s string").select(text.output_paths(F.col("s"), "out", F.lit(save), F.lit(js)).alias("p")).first()["p"]
    assert tuple(row) == want


def test_messages(spark):
    lines = ["3|0.12|0.08|0.01|[[1, 2, 3, 4, 0.9, 0]]", "3|0.5|[]", "4|[]", "Ready.", "1|2|3|4", "x|1|1|1|[]", "5|1|1|1|oops", None]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    got = [r.m for r in df.select(text.parsed_message(F.col("line")).alias("m")).collect()]
    assert [m.malformed for m in got] == [False, False, False, True, True, True, True, True]
    assert (got[0].frame_idx, got[0].total, got[0].inference, got[0].nms, got[0].boxes) == (3, 0.12, 0.08, 0.01, [[1, 2, 3, 4, 0.9, 0]])
    assert (got[1].total, got[1].inference, got[1].nms, got[2].total) == (0.5, 0.5, 0, 0)


def test_encode_and_label_round_like_python(spark):
    box = F.array(F.struct(*(F.lit(v).alias(n) for n, v in zip(("x1", "y1", "x2", "y2", "conf", "cls"), (1.0, 2.0, 3.0, 4.0, 0.9, 0)))))
    df = spark.createDataFrame([(3, 0.12, 0.08, 0.01)], "f long, a double, b double, c double")
    assert df.select(text.encoded_message(F.col("f"), F.col("a"), F.col("b"), F.col("c"), box)).first()[0] == "3|0.120000|0.080000|0.010000|[[1.0, 2.0, 3.0, 4.0, 0.9, 0]]"
    values = [0.125, 0.145, 0.375, 0.005, 0.995, 0.5, 1.0, 0.285]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(text.fixed("v", 2)).collect()
    assert [r[0] for r in got] == [f"{v:.2f}" for v in values]


def test_admission_rules():
    newest = Admission("drop_newest", 2)
    assert [list(newest.arrive(i)) for i in range(3)] == [[], [], [(2, None, "dropped")]]
    oldest = Admission("drop_oldest", 2)
    out = [x for i in range(3) for x in oldest.arrive(i)]
    assert out == [(0, 0, "evicted")]
    assert list(oldest.complete(0)) == []  # late result of an evicted frame
    assert list(oldest.complete(2)) == [] and list(oldest.complete(1)) == [(1, 1, "emitted"), (2, 2, "emitted")]
    with pytest.raises(ValueError):
        Admission("other", 2)


@pytest.mark.parametrize("policy, cap", [("drop_newest", 1), ("drop_newest", 4), ("drop_oldest", 1), ("drop_oldest", 4), ("latest_only", 9)])
def test_replay_loses_nothing_and_keeps_order(spark, policy, cap):
    rng = random.Random(cap)
    rows = [(s, i * 10, "arrival", i) for s in range(3) for i in range(40)] + [(s, i * 10 + rng.randrange(1, 90), "completion", i) for s in range(3) for i in range(40)]
    got = replay(spark.createDataFrame(rows, "stream_id long, t long, kind string, source_idx long"), policy, cap).collect()
    for s in range(3):
        own = [r for r in got if r.stream_id == s]
        assert sorted(r.source_idx for r in own) == list(range(40))
        emitted = [r.source_idx for r in own if r.outcome == "emitted"]
        assert emitted == sorted(emitted) and emitted


def test_staleness_counts_reads_before_emission(spark):
    rows = [(1, 0, "ingest", 0, 25.0), (1, 1, "ingest", 1, 25.0), (1, 2, "emit", 0, 25.0), (1, 2, "ingest", 2, 25.0), (1, 9, "emit", 2, 25.0)]
    got = S.staleness(spark.createDataFrame(rows, "stream_id long, t long, kind string, source_idx long, fps double")).orderBy("source_idx").collect()
    assert [(r.source_idx, r.stale_frames, r.stale_ms) for r in got] == [(0, 2, 80.0), (2, 0, 0.0)]


def test_report(spark, tmp_path):
    from frametide.report import plot_data, write_report

    history = spark.createDataFrame([(1, i, float(i), 10.0) for i in range(11)], HISTORY)
    timings = spark.createDataFrame([(0.02, 0.01, 0.001, 0.01, 0.02, 0.005, 1.1)] * 11, "total double, inference double, nms double, read double, preprocess double, visual double, wall_s double")
    records = spark.createDataFrame([(5.0, 10.0, 3, 0.0, 0.0), (6.0, 12.0, 20, 1.0, 33.3)], "dispatch_to_result_ms double, dispatch_to_write_ms double, dispatch_backlog long, stale_frames double, stale_ms double")

    def queue(written):
        return spark.createDataFrame([(12, written, 1, None, 30.0, True, 4, "drop_oldest")], "frames_seen long, frames_written long, frames_dropped long, input_fps_cap double, loader_fps double, bounded_latency boolean, max_in_flight int, drop_policy string")

    r = write_report(history, timings, queue(11), records, 1.1, str(tmp_path / "out"))
    assert r.avg_fps == pytest.approx(10.0)
    trace = json.load(open(r.trace_path))["summary"]
    assert trace["queue_control"]["frames_dropped"] == 1 and trace["dispatch_to_write_ms"]["count"] == 2
    assert trace["queue_conditioned_dispatch_to_write_ms"]["q_16_31"]["count"] == 1
    short = write_report(history, timings, queue(10), records, 1.1, str(tmp_path / "none"))
    assert short.avg_fps == pytest.approx(10 / 1.1) and short.trace_path is None and not (tmp_path / "none").exists()
    assert plot_data(history).filter("stable").count() == 9
