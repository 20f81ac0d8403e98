"""Tiling, letterbox and box algebra as column expressions (built-in functions alone)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def check_tiling(patch: int, overlap: int) -> None:
    if patch < 1 or overlap < 0 or overlap >= patch:
        raise ValueError("the overlap must be at least 0 and less than the patch")


def optimal_stride(dim: Column, patch: int, overlap: int) -> Column:
    """Spacing of the fewest evenly spread patches that overlap by at least ``overlap``; 0 where one patch covers all."""
    check_tiling(patch, overlap)
    spare = (dim - patch).cast("double")
    gaps = F.ceil(spare / (patch - overlap)).cast("double")
    return F.when(dim <= patch, 0.0).otherwise(spare / gaps)


def axis_starts(dim: Column, patch: int, overlap: int, snap_to_edge: bool = False) -> Column:
    """Array of patch starts along one axis.

    Starts are truncated, and the last is moved back where it would pass the edge. Rounding of the spacing can repeat the
    last start or leave one pixel uncovered; ``snap_to_edge`` repairs both and otherwise starts are kept as the formula has them.
    """
    stride = optimal_stride(dim, patch, overlap)
    last = F.ceil((dim - patch) / stride).cast("int")
    raw = F.transform(F.sequence(F.lit(0), last), lambda i: F.greatest(F.lit(0), F.least((i * stride).cast("int") + patch, dim) - patch))
    starts = F.when(dim <= patch, F.array(F.lit(0))).otherwise(raw)
    if snap_to_edge:
        edge = F.greatest(F.lit(0), dim - patch)
        starts = F.array_distinct(F.array_append(F.filter(starts, lambda x: x < edge), edge))
    return F.transform(starts, lambda x: x.cast("int"))


def tiles(width: Column, height: Column, patch: int, overlap: int, snap_to_edge: bool = False) -> Column:
    """Array of ``(patch_id, x0, y0, x1, y1)``, y outer and x inner. Ends are not clamped where the frame is smaller than a patch."""
    xs, ys = axis_starts(width, patch, overlap, snap_to_edge), axis_starts(height, patch, overlap, snap_to_edge)
    cells = F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: F.struct(x.alias("x0"), y.alias("y0")))))
    return F.transform(
        cells,
        lambda c, i: F.struct(i.alias("patch_id"), c["x0"].alias("x0"), c["y0"].alias("y0"), (c["x0"] + patch).alias("x1"), (c["y0"] + patch).alias("y1")),
    )


def letterbox(w: Column, h: Column, new_w: int, new_h: int, auto: bool = False, scale_fill: bool = False, scaleup: bool = True, stride: int = 32) -> Column:
    """Struct ``rx, ry, dw, dh, unpad_w, unpad_h, top, bottom, left, right`` of a fit into ``new_w`` x ``new_h``."""
    w, h = w.cast("double"), h.cast("double")
    r = F.least(new_h / h, new_w / w)
    if not scaleup:
        r = F.least(r, F.lit(1.0))
    rx = ry = r
    uw, uh = F.bround(w * r), F.bround(h * r)
    dw, dh = F.lit(float(new_w)) - uw, F.lit(float(new_h)) - uh
    if auto:
        dw, dh = F.pmod(dw, F.lit(float(stride))), F.pmod(dh, F.lit(float(stride)))
    elif scale_fill:
        dw, dh, uw, uh = F.lit(0.0), F.lit(0.0), F.lit(float(new_w)), F.lit(float(new_h))
        rx, ry = new_w / w, new_h / h
    dw, dh = dw / 2, dh / 2

    def side(x: Column, by: float) -> Column:
        return F.bround(x + by).cast("int")

    return F.struct(
        rx.alias("rx"), ry.alias("ry"), dw.alias("dw"), dh.alias("dh"), uw.cast("int").alias("unpad_w"), uh.cast("int").alias("unpad_h"),
        side(dh, -0.1).alias("top"), side(dh, 0.1).alias("bottom"), side(dw, -0.1).alias("left"), side(dw, 0.1).alias("right"),
    )


def prepare(w: Column, h: Column, new_w: int, new_h: int, resize: bool = False) -> Column:
    """The letterbox of an image for its buffer: the identity where sizes agree and no resize is asked for."""
    fit = letterbox(w, h, new_w, new_h)
    if resize:
        return fit
    zero, one = F.lit(0), F.lit(1.0)
    same = F.struct(one.alias("rx"), one.alias("ry"), F.lit(0.0).alias("dw"), F.lit(0.0).alias("dh"), w.cast("int").alias("unpad_w"), h.cast("int").alias("unpad_h"), *(zero.alias(n) for n in ("top", "bottom", "left", "right")))
    return F.when((w == new_w) & (h == new_h), same).otherwise(fit)


def inverse_clamp(value: Column, pad: Column, ratio: Column, limit: Column) -> Column:
    """A letterboxed coordinate back in the image, held inside it."""
    return F.greatest(F.lit(0.0), F.least((value - pad) / ratio, limit.cast("double")))


def center_crop(size: Column, target: int) -> tuple[Column, Column]:
    """Start and end of the centred part; the whole where the source is smaller."""
    start = F.greatest(F.lit(0), F.floor(size / 2).cast("int") - target // 2)
    return start, F.least(start + target, size)


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def area(a: Column) -> Column:
    return (a["x2"] - a["x1"]) * (a["y2"] - a["y1"])


def overlaps(a: Column, b: Column, threshold: float) -> Column:
    """Intersection over union above the threshold, without a division."""
    both = intersection(a, b)
    return both > threshold * (area(a) + area(b) - both)
