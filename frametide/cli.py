"""Command line: ``image``, ``video``, ``demo image|video``, ``export`` and ``doctor``.

Video files need a decoder, which is not part of this package: ``video`` reads a folder of numbered frames.
"""

from __future__ import annotations

import argparse
import sys

from frametide.settings import read_yaml, settle

COMMANDS = ("video", "image", "export")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="frametide", description="Tiled object detection on Spark")
    p.add_argument("-c", "--config", help="YAML settings")
    commands = p.add_subparsers(dest="command")
    shared = argparse.ArgumentParser(add_help=False, argument_default=argparse.SUPPRESS)
    for flags, options in (
        (("-c", "--config"), {}), (("-i", "--input"), {}), (("-o", "--output"), {}), (("-m", "--model"), {}), (("-d", "--device"), {}), (("-p", "--patch-size"), {"type": int}),
        (("-mo", "--min-overlap"), {"type": int}), (("-cf", "--conf"), {"type": float}), (("-iou", "--iou"), {"type": float}), (("-rs", "--resize"), {}), (("-cls", "--classes"), {}),
        (("-w", "--workers-per-gpu"), {"type": int}), (("-gc", "--global-context"), {"action": "store_true"}), (("-gs", "--global-size"), {"type": int}), (("-aug", "--augment"), {"action": "store_true"}),
        (("-sv", "--save"), {"action": "store_true"}), (("-sj", "--save-json"), {"action": "store_true"}),
    ):
        shared.add_argument(*flags, **options)
    video = argparse.ArgumentParser(add_help=False, argument_default=argparse.SUPPRESS)
    for flags, options in (
        (("-s", "--stride"), {"type": int}), (("-off", "--offset"), {"type": int}), (("-b", "--batch-size"), {"type": int}), (("-plot", "--plot-fps"), {"action": "store_true"}),
        (("-nf", "--num-frames"), {"type": int}), (("--bounded-latency",), {"action": "store_true"}), (("--max-in-flight",), {"type": int}),
        (("--drop-policy",), {"choices": ["drop_oldest", "drop_newest", "latest_only"]}), (("--input-fps-cap",), {"type": float}),
    ):
        video.add_argument(*flags, **options)
    commands.add_parser("image", parents=[shared])
    commands.add_parser("video", parents=[shared, video])
    demo = commands.add_parser("demo").add_subparsers(dest="demo", required=True)
    demo.add_parser("image", parents=[shared])
    demo.add_parser("video", parents=[shared, video])
    export = commands.add_parser("export")
    export.add_argument("-m", "--model")
    export.add_argument("-d", "--device")
    export.add_argument("--imgsz", type=int)
    export.add_argument("-b", "--batch", type=int)
    export.add_argument("--dynamic", action=argparse.BooleanOptionalAction, default=True)
    export.add_argument("--static", dest="dynamic", action="store_false")
    commands.add_parser("doctor")
    return p


def _config_path(argv: list[str]) -> str | None:
    return next((b for a, b in zip(argv, argv[1:]) if a in ("-c", "--config")), None)


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("frametide").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _detector_of(s, detector):
    from frametide.api import TiledDetector

    d = TiledDetector(detector, _session())
    d.settings = s
    return d


def run_image(s, detector) -> int:
    with _detector_of(s, detector) as d:
        found = d.predict_image(s.input, s.output or ".")
    print(f"{len(found)} images, {sum(map(len, found.values()))} boxes")
    return 0


def run_video(s, detector) -> int:
    with _detector_of(s, detector) as d:
        d.predict_video(s.input, s.output or ".")
    print("\n".join(d.report.lines))
    return 0


def doctor() -> int:
    import importlib.util

    print(f"Python: {sys.executable}")
    for name in ("pyspark", "pyarrow", "pandas", "numpy", "yaml"):
        print(f"{name}: {'found' if importlib.util.find_spec(name) else 'missing'}")
    return 0


def main(argv: list[str] | None = None, detector=None) -> int:
    """0: done; 1: no command, or what it needs is missing. ``detector`` stands in for the model."""
    argv = list(sys.argv[1:] if argv is None else argv)
    config = _config_path(argv)
    file = read_yaml(config) if config else {}
    given_command = next((a for a in argv if a in (*COMMANDS, "demo", "doctor")), None)
    if given_command is None and file.get("mode") in COMMANDS:
        argv = [file["mode"], *argv]
    args = vars(parser().parse_args(argv))
    command = args.pop("command")
    if command == "demo":
        command = args.pop("demo")
    if command is None:
        parser().print_help()
        return 1
    if command == "doctor":
        return doctor()
    if command == "export":
        print("Error: engine export needs vendor hardware and libraries that this package does not include", file=sys.stderr)
        return 1
    try:
        s = settle(file, args)
    except ValueError as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    if not s.input:
        print("Error: no input", file=sys.stderr)
        return 1
    if detector is None:
        if s.model not in (None, "bright-blocks"):
            print(f"Error: no adapter for the model {s.model}", file=sys.stderr)
            return 1
        from frametide.detector import BrightBlocks

        detector = BrightBlocks()
    return run_image(s, detector) if command == "image" else run_video(s, detector)


if __name__ == "__main__":
    raise SystemExit(main())
