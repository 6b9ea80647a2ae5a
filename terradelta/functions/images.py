"""Grey and label images (binary, a byte a pixel, line by line), whole Arrow batches at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import masks


def data(images: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, and where each image begins (one more entry for the end)."""
    wide = images.fill_null(b"").cast(pa.large_binary())
    ends = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(images) + 1]
    return np.frombuffer(wide.buffers()[2] or b"", np.uint8), ends


def _packed(values: np.ndarray, size: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def gamma_bytes(images: pa.Array, gamma: np.ndarray) -> pa.Array:
    values, ends = data(images)
    size = np.diff(ends)
    known, of = np.unique(gamma, return_inverse=True)
    tables = np.clip((np.arange(256) / 255.0)[None, :] ** known[:, None] * 255.0, 0, 255).astype(np.uint8)
    return _packed(tables[np.repeat(of, size), values[ends[0] : ends[-1]]], size)


def class_runs(images: pa.Array, width: np.ndarray, wanted: np.ndarray) -> masks.Runs:
    values, ends = data(images)
    hit = np.flatnonzero(values[ends[0] : ends[-1]] == np.repeat(wanted, np.diff(ends)))
    row = np.searchsorted(ends - ends[0], hit, "right") - 1
    at = hit - (ends[row] - ends[0])
    number = masks._number(row, at // width[row], at % width[row])
    return masks.merged(masks.Runs(number, number + 1))


def colour_runs(images: pa.Array, width: np.ndarray, colour: tuple[int, int, int]) -> masks.Runs:
    values, ends = data(images)
    size = np.diff(ends) // 3
    row, t = masks._spread(size)
    at = ends[row] + 3 * t
    hit = np.flatnonzero(np.logical_and.reduce([values[at + k] == v for k, v in enumerate(colour)])) if len(at) else at
    number = masks._number(row[hit], t[hit] // width[row[hit]], t[hit] % width[row[hit]])
    return masks.merged(masks.Runs(number, number + 1))


#: Pixels that are worked out at once; an image with more is one block.
PIXELS = 1 << 20


def square_bytes(images: pa.Array, width: np.ndarray, side: np.ndarray) -> pa.Array:
    """Blocks of images, since a pixel takes some twenty numbers on its way."""
    if not len(images):
        return pa.array([], pa.binary())
    block = np.cumsum(side * side) // PIXELS
    first = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
    return pa.concat_arrays([_square_block(images.slice(a, b - a), width[a:b], side[a:b]) for a, b in zip(first, np.append(first[1:], len(side)), strict=True)])


def _square_block(images: pa.Array, width: np.ndarray, side: np.ndarray) -> pa.Array:
    values, ends = data(images)
    height = np.diff(ends) // np.maximum(width, 1)
    row, t = masks._spread(np.where(height > 0, side * side, 0))
    n = side[row]

    def axis(at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        place = np.clip((at + 0.5) * size / n - 0.5, 0, size - 1)
        low = np.minimum(np.floor(place).astype(np.int64), np.maximum(size - 2, 0))
        return low, np.minimum(low + 1, size - 1), place - low

    (y0, y1, fy), (x0, x1, fx) = axis(t // n, height[row]), axis(t % n, width[row])
    pixel = lambda y, x: values[ends[row] + y * width[row] + x].astype(float)
    left, right = pixel(y0, x0) * (1 - fy) + pixel(y1, x0) * fy, pixel(y0, x1) * (1 - fy) + pixel(y1, x1) * fy
    return _packed(np.rint(left * (1 - fx) + right * fx).astype(np.uint8), np.where(height > 0, side * side, 0))


@F.arrow_udf(T.BinaryType())
def _gamma(images: pa.Array, gamma: pa.Array) -> pa.Array:
    return gamma_bytes(images, gamma.fill_null(1.0).to_numpy(zero_copy_only=False).astype(float))


@F.arrow_udf(masks.RUNS)
def _class(images: pa.Array, width: pa.Array, wanted: pa.Array) -> pa.Array:
    return masks.to_arrow(class_runs(images, masks._ints(width), masks._ints(wanted)), len(images))


@F.arrow_udf(T.BinaryType())
def _square(images: pa.Array, width: pa.Array, side: pa.Array) -> pa.Array:
    return square_bytes(images, masks._ints(width), masks._ints(side))


def gamma_corrected(image: Column, gamma: Column) -> Column:
    return F.when(image.isNotNull(), _gamma(image, gamma))


def class_mask(labels: Column, width: Column, wanted: Column) -> Column:
    """The mask of the pixels of a label image that have the wanted class."""
    return F.when(labels.isNotNull(), _class(labels, width, wanted))


def colour_mask(labels: Column, width: Column, colour: tuple[int, int, int]) -> Column:
    """The mask of the pixels of a colour-coded label image, three bytes a pixel, that have that colour."""

    @F.arrow_udf(masks.RUNS)
    def mask(images: pa.Array, wide: pa.Array) -> pa.Array:
        return masks.to_arrow(colour_runs(images, masks._ints(wide), colour), len(images))

    return F.when(labels.isNotNull(), mask(labels, width))


def preprocessed(image: Column, settings: dict) -> Column:
    """The image as a config asks: {"mode": "none"} or {"mode": "gamma", "gamma": number}; other modes are an error, not a silent copy."""
    mode = settings.get("mode", "none")
    if mode == "none":
        return image
    if mode == "gamma":
        return gamma_corrected(image, F.lit(float(settings.get("gamma", 1.0))))
    raise ValueError(f"no such preprocessing: {mode}")


def resized(image: Column, width: Column, side: Column) -> Column:
    """An image made `side` pixels square, bilinear between pixel centres."""
    return F.when(image.isNotNull(), _square(image, width, side))
