"""Pixel kernels on arrays of height x width x channels, run inside Arrow batches. Bilinear, with pixel centres aligned."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

BORDER = 114


@lru_cache(maxsize=256)
def _axis(n: int, m: int, times: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For ``m`` places on an axis of ``n``: the lower neighbours and then the upper ones, and the weights of either, each ``times`` over."""
    at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
    low = np.floor(at).astype(int)
    return np.concatenate((low, np.minimum(low + 1, n - 1))), np.repeat(1 - (at - low), times), np.repeat(at - low, times)


def resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    h, w, channels = image.shape
    if (w, h) == (width, height):
        return image
    ys, upper, lower = _axis(h, height)
    xs, left, right = _axis(w, width, channels)
    part = image.take(ys, axis=0)
    fewer = 2 * width < w  # what no place needs is left out before the arithmetic, which runs over whole rows
    part = (part.take(xs, axis=1) if fewer else part).astype(np.float32).reshape(2 * height, -1)
    rows = part[:height] * upper[:, None]
    rows += part[height:] * lower[:, None]
    del part  # a large image's arrays are the most that a worker holds

    def side(k: int) -> np.ndarray:
        return rows[:, k * width * channels : (k + 1) * width * channels] if fewer else rows.reshape(height, w, channels).take(xs[k * width : (k + 1) * width], axis=1).reshape(height, -1)

    out = side(0) * left
    out += side(1) * right
    return np.rint(out, out=out).astype(image.dtype).reshape(height, width, channels)


def letterbox(image: np.ndarray, unpad_w: int, unpad_h: int, top: int, bottom: int, left: int, right: int) -> np.ndarray:
    """The resize and border that :func:`frametide.functions.geometry.letterbox` has worked out."""
    fitted = resize(image, unpad_w, unpad_h)
    return np.pad(fitted, ((top, bottom), (left, right), (0, 0)), constant_values=BORDER)


def center_crop(image: np.ndarray, width: int, height: int) -> np.ndarray:
    h, w = image.shape[:2]
    x, y = max(0, w // 2 - width // 2), max(0, h // 2 - height // 2)
    return image[y : y + height, x : x + width]


def tile(image: np.ndarray, x0: int, y0: int, size: int) -> np.ndarray:
    """A patch, filled with black where it passes the border."""
    part = image[y0 : y0 + size, x0 : x0 + size]
    h, w = part.shape[:2]
    return part if (h, w) == (size, size) else np.pad(part, ((0, size - h), (0, size - w), (0, 0)))
