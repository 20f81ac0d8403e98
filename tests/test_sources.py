import json
import os
import struct
import zlib

import numpy as np
import pytest

from frametide import cli
from frametide.detector import BrightBlocks
from frametide.settings import Settings, normalize_controls, parse_classes, parse_devices, parse_size, read_yaml, settle
from frametide.sources import frames, images, sinks
from frametide.streaming import detect as live


def png(path, image):
    """A plain RGB file, so that Spark has something to decode."""
    h, w, _ = image.shape
    raw = b"".join(b"\0" + row.tobytes() for row in image)

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "images"
    d.mkdir()
    bright = np.zeros((64, 96, 3), np.uint8)
    bright[16:32, 32:48] = 255
    png(d / "b.PNG", bright)
    png(d / "a.png", np.zeros((64, 96, 3), np.uint8))
    (d / "broken.jpg").write_bytes(b"not an image")
    (d / "ignore.txt").write_text("x")
    return d


def test_image_scan(spark, folder):
    got = images.read_images(spark, str(folder)).orderBy("path").collect()
    assert [os.path.basename(r.path) for r in got] == ["a.png", "b.PNG"] and (got[0].w, got[0].h) == (96, 64)
    assert images.read_images(spark, str(folder / "b.PNG")).count() == 1


def test_image_command(spark, folder, tmp_path):
    config = tmp_path / "c.yaml"
    config.write_text(f"mode: image\nruntime:\n  patch_size: 64\n  min_overlap: 16\ninput: {folder}\n")
    assert cli.main(["-c", str(config), "-o", str(tmp_path / "out"), "-sj", "-rs", "96,64"]) == 0
    out = json.load(open(tmp_path / "out" / "detections.json"))
    assert list(out) == ["a.png", "b.PNG"] and out["a.png"] == [] and out["b.PNG"][0][:4] == [32.0, 16.0, 48.0, 32.0]
    assert cli.main(["image", "-i", str(folder), "-o", str(tmp_path / "drawn"), "-sv", "-p", "64", "-mo", "16", "-rs", "96,64"]) == 0
    assert sorted(os.listdir(tmp_path / "drawn")) == ["a.png", "b.png"]


def npy_frames(path, n):
    path.mkdir()
    for i in range(n):
        image = np.zeros((64, 64, 3), np.uint8)
        image[16:32, 16 * (i % 4) : 16 * (i % 4) + 16] = 255
        np.save(path / f"{i:05d}.npy", image)


def test_frame_stream_delivers_every_frame_in_order(spark, tmp_path):
    npy_frames(tmp_path / "frames", 12)
    docs = []
    rows = frames.read_frames(spark, str(tmp_path / "frames"), rows=5)
    live.run(rows, BrightBlocks(), Settings(patch_size=64, min_overlap=16), lambda d, n: docs.extend(d.collect()), str(tmp_path / "state"))
    assert [r.frame_idx for r in docs] == list(range(12))
    assert [r.detections[0].bbox[0] for r in docs] == [16.0 * (i % 4) for i in range(12)]


def test_video_command_and_sampling(spark, tmp_path):
    npy_frames(tmp_path / "clip", 10)
    assert cli.main(["video", "-i", str(tmp_path / "clip"), "-o", str(tmp_path), "-p", "64", "-mo", "16", "-s", "3", "-off", "1", "-sj", "-nf", "2"]) == 0
    assert [d["frame_idx"] for d in json.load(open(tmp_path / "clip.json"))] == [1, 4]


@pytest.mark.parametrize("policy, want", [("drop_oldest", [8, 9, 10, 11]), ("drop_newest", [0, 1, 2, 3]), ("latest_only", [11])])
def test_drop_policies_change_a_run(spark, tmp_path, policy, want):
    npy_frames(tmp_path / "clip", 12)
    flags = ["--bounded-latency", "--max-in-flight", "4", "--drop-policy", policy]
    assert cli.main(["video", "-i", str(tmp_path / "clip"), "-o", str(tmp_path), "-p", "64", "-mo", "16", "-sj", "-plot", *flags]) == 0
    assert [d["frame_idx"] for d in json.load(open(tmp_path / "clip.json"))] == want
    assert sum(r["fps"] > 0 for r in json.load(open(tmp_path / "clip_fps.json"))) >= 1


def test_report_and_trace_of_a_run(spark, tmp_path, capsys):
    npy_frames(tmp_path / "clip", 12)
    assert cli.main(["video", "-i", str(tmp_path / "clip"), "-o", str(tmp_path), "-p", "64", "-mo", "16", "-sj", "--max-in-flight", "5"]) == 0
    assert [d["frame_idx"] for d in json.load(open(tmp_path / "clip.json"))] == list(range(12))
    said = capsys.readouterr().out
    assert "Average FPS" in said and "12 seen, 12 written, 0 dropped" in said
    assert json.load(open(tmp_path / "latency_trace_detailed.json"))["summary"]["dispatch_to_write_ms"]["count"] == 12


def test_offsets_are_names(tmp_path):
    npy_frames(tmp_path / "clip", 3)
    reader = frames.FrameFolder({"path": str(tmp_path / "clip"), "rows": 2}).simpleStreamReader(None)
    rows, end = reader.read(reader.initialOffset())
    assert [i for i, _ in rows] == [0, 1]
    np.save(tmp_path / "clip" / "00007.npy", np.zeros((4, 4, 3), np.uint8))
    again = [i for i, _ in reader.readBetweenOffsets(reader.initialOffset(), end)]
    rows, end = reader.read(end)
    assert again == [0, 1] and [i for i, _ in rows] == [2, 7]
    np.save(tmp_path / "clip" / "00001a0.npy", np.zeros((4, 4, 3), np.uint8))
    assert [i for i, _ in reader.read(end)[0]] == []


class Counting(BrightBlocks):
    """Writes a line for each call and each load."""

    def __init__(self, path):
        super().__init__()
        self.path = str(path)

    def load(self):
        with open(self.path, "a") as f:
            f.write("load\n")

    def detect(self, patches, conf, classes):
        with open(self.path, "a") as f:
            f.write("detect\n")
        return super().detect(patches, conf, classes)


def test_each_patch_is_seen_once(spark, tmp_path):
    from pyspark import cloudpickle

    import test_sources
    from frametide.plans.detect import detect

    cloudpickle.register_pickle_by_value(test_sources)
    image = np.zeros((64, 64, 3), np.uint8)
    image[16:32, 16:32] = 255
    rows = images.from_array(spark, image)
    found = detect(rows, Counting(tmp_path / "calls"), Settings(patch_size=64, min_overlap=16, global_context=True, conf=0.3)).collect()
    assert [(r.x1, r.y1, r.x2, r.y2) for r in found] == [(16.0, 16.0, 32.0, 32.0)]
    calls = open(tmp_path / "calls").read().split()
    assert calls.count("detect") == 2 and calls.count("load") == 1


def test_missing_source():
    with pytest.raises(ValueError):
        frames.FrameFolder({"path": "/nowhere/at/all"}).simpleStreamReader(None)


def test_frame_array_of_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], "frame_idx long, detections array<struct<bbox:array<double>,conf:double,class:int>>")
    assert sinks.write_frame_array(empty, str(tmp_path / "x.json")) == 0 and json.load(open(tmp_path / "x.json")) == []


def test_yaml_inheritance_and_precedence(tmp_path):
    (tmp_path / "base.yaml").write_text("mode: video\nruntime:\n  patch_size: 960\n  conf: 0.3\n")
    (tmp_path / "child.yaml").write_text("__base__: base.yaml\nruntime:\n  conf: 0.5\nnested:\n  stride: 3\n")
    file = read_yaml(str(tmp_path / "child.yaml"))
    assert file == {"mode": "video", "patch_size": 960, "conf": 0.5, "stride": 3}
    s = settle(file, {"conf": 0.7, "classes": "0,14"})
    assert (s.patch_size, s.conf, s.stride, s.classes, s.context_size) == (960, 0.7, 3, [0, 14], 960)
    with pytest.warns(UserWarning):
        assert read_yaml(str(tmp_path / "none.yaml")) == {}


def test_parsing():
    assert parse_size("2560,1440") == (2560, 1440) and parse_size(None) is None
    with pytest.raises(ValueError):
        parse_size("2560x1440")
    assert parse_classes("0,14") == [0, 14] and parse_classes("") is None
    assert parse_devices("0,1", 0) == ["cpu"] and parse_devices("all", 2) == [0, 1] and parse_devices("0,7", 2) == [0] and parse_devices("x", 1) == [0]
    assert normalize_controls(None, " BAD ", "not-a-number") == (64, "drop_oldest", None)
    assert normalize_controls(99, "latest_only", 30) == (1, "latest_only", 30.0)
    assert images.is_stream_source("rtsp://cam") and images.is_stream_source(0) and not images.is_stream_source("video.mp4")


def test_exit_codes(capsys):
    assert cli.main([]) == 1 and cli.main(["doctor"]) == 0 and cli.main(["export"]) == 1 and cli.main(["image"]) == 1
    assert cli.main(["image", "-i", "x", "-m", "net.engine"]) == 1
    with pytest.raises(SystemExit) as e:
        cli.main(["video", "--drop-policy", "bad"])
    assert e.value.code == 2


def test_api(spark, folder, tmp_path):
    from frametide.api import TiledDetector

    npy_frames(tmp_path / "clip", 4)
    with TiledDetector(BrightBlocks(), spark, patch_size=64, min_overlap=16, resize=(96, 64)) as d:
        out = d.predict_image(str(folder), str(tmp_path / "out"), save_json=True, save=True)
        assert {os.path.basename(k): len(v) for k, v in out.items()} == {"a.png": 0, "b.PNG": 1}
        assert sorted(os.listdir(tmp_path / "out")) == ["a.png", "b.png", "detections.json"]
        drawn = images.read_images(spark, str(tmp_path / "out")).orderBy("path").collect()[1]
        assert np.frombuffer(drawn.data, np.uint8).reshape(64, 96, 3)[16, 32].tolist() == [0, 0, 255]
        image = np.zeros((64, 96, 3), np.uint8)
        image[16:32, 32:48] = 255
        assert d.predict(image)[0][:4] == [32.0, 16.0, 48.0, 32.0] and d.predict(image, classes=[2]) == []
        assert d.predict_video(str(tmp_path / "clip"), resize=None, num_frames=3).count() == 3
