"""Sources, paths and worker messages as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefixes of network streams, suffixes of images, names of drop policies.
STREAM_PREFIXES = ("rtsp", "rtmp", "http", "tcp")
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "bmp")
POLICIES = ("drop_oldest", "drop_newest", "latest_only")


def is_stream(source: Column) -> Column:
    """A network stream by its prefix, or a camera by its number."""
    return source.rlike(f"^({'|'.join(STREAM_PREFIXES)})") | source.rlike("^\\p{Nd}+$")


def is_image(path: Column) -> Column:
    return F.lower(path).rlike(f"\\.({'|'.join(IMAGE_SUFFIXES)})$")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def stem(name: Column) -> Column:
    """Without the last suffix; leading dots are part of the name."""
    return F.regexp_replace(name, "^(\\.*[^.].*)\\.[^.]*$", "$1")


def output_paths(source: Column, folder: str, save: Column, save_json: Column) -> Column:
    """Struct ``filename, save_path, json_path``; a path is null where it isn't asked for."""
    name = F.when(is_stream(source), "stream_output.mp4").otherwise(basename(source))
    return F.struct(
        name.alias("filename"), F.when(save, F.concat(F.lit(folder + "/"), name)).alias("save_path"), F.when(save_json, F.concat(F.lit(folder + "/"), stem(name), F.lit(".json"))).alias("json_path")
    )


def policy(name: Column) -> Column:
    clean = F.lower(F.trim(name))
    return F.when(clean.isin(*POLICIES), clean).otherwise("drop_oldest")


def fixed(value: Column | str, digits: int) -> Column:
    """Decimal text, rounded half to even on the exact binary value."""
    return F.call_function("format_number", F.col(value) if isinstance(value, str) else value, F.lit("0." + "0" * digits))


def parsed_message(line: Column) -> Column:
    """Struct ``fields, frame_idx, total, inference, nms, boxes, malformed`` of a worker's line.

    Lines have five, three or two fields between bars; the last of five is JSON and may hold bars. Other lines are malformed, as are
    numbers or JSON that don't parse; a malformed line has no values.
    """
    p = F.split(F.trim(line), "[|]", 5)
    n = F.size(p)

    def number(i: int) -> Column:
        return F.get(p, F.lit(i)).try_cast("double")

    frame = F.get(p, F.lit(0)).try_cast("bigint")
    boxes = F.from_json(F.get(p, F.lit(4)), "array<array<double>>")
    total = F.when(n >= 3, number(1)).when(n == 2, 0.0)
    inference = F.when(n == 5, number(2)).when(n == 3, number(1)).when(n == 2, 0.0)
    nms = F.when(n == 5, number(3)).when(n.isin(2, 3), 0.0)
    last = F.when(n == 5, boxes).when(n == 3, F.from_json(F.get(p, F.lit(2)), "array<array<double>>")).when(n == 2, F.from_json(F.get(p, F.lit(1)), "array<array<double>>"))
    good = n.isin(2, 3, 5) & frame.isNotNull() & total.isNotNull() & inference.isNotNull() & nms.isNotNull() & last.isNotNull()
    return F.struct(
        n.alias("fields"), F.when(good, frame).alias("frame_idx"), F.when(good, total).alias("total"), F.when(good, inference).alias("inference"),
        F.when(good, nms).alias("nms"), F.when(good, last).alias("boxes"), F.coalesce(~good, F.lit(True)).alias("malformed"),
    )


def encoded_message(frame: Column, total: Column, inference: Column, nms: Column, boxes: Column) -> Column:
    """The line of a worker: durations with six digits, boxes as JSON with a space after commas, as ``json.dumps`` writes them."""
    body = F.transform(boxes, lambda b: F.concat(F.lit("["), F.array_join(F.array(*(b[k].cast("string") for k in ("x1", "y1", "x2", "y2", "conf", "cls"))), ", "), F.lit("]")))
    return F.concat_ws("|", frame.cast("string"), fixed(total, 6), fixed(inference, 6), fixed(nms, 6), F.concat(F.lit("["), F.array_join(body, ", "), F.lit("]")))
