"""Pixel operations on flat image arrays (F-9, F-18 .. F-20, A-13).

An image is a STRUCT(height INT, width INT, n_channels INT, data ARRAY<INT>)
with `data` in height-width-channel order (the layout of Spark's image
source, whose BGR channels must be reordered to RGB first). All operations
are per-row array expressions; each distinct image is processed once and
joined to its many questions afterwards (see `operators/qa.py`).
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from bytelane.functions.arrays import let
from bytelane.functions.bytes import bytes_to_array

MAX_CHANNEL_VALUES = 256
# which value stands for a bin between two edges
BIN_VALUES = {"lower": min, "upper": max, "mean": lambda lo, hi: (lo + hi) / 2}
# fixed values: 16-bit fixed-point luma weights of R, G, B and the rounding term
LUMA = (19595, 38470, 7471, 32768)


def _each_row(data: pa.Array, shapes: list[pa.Array], known: np.ndarray, move: Callable[..., np.ndarray]) -> pa.Array:
    """Lists of moved elements: `move(elements, *shape)` for each row that is `known`, else null."""
    values, offsets = data.values, data.offsets.to_numpy()
    # elements that can be null are moved by their places
    source = np.arange(len(values)) if values.null_count else values.to_numpy(zero_copy_only=False)
    numbers = [x.fill_null(0).to_numpy(zero_copy_only=False).tolist() for x in shapes]
    out = [move(source[a:b], *shape) if k else source[:0]
           for a, b, k, *shape in zip(offsets[:-1].tolist(), offsets[1:].tolist(), known.tolist(), *numbers, strict=True)]
    upto = pa.array(np.concatenate([[0], np.cumsum([len(o) for o in out])]).astype(np.int32), mask=np.append(~known, False))
    moved = pa.array(np.concatenate([*out, source[:0]]))
    return pa.ListArray.from_arrays(upto, (values.take(moved) if values.null_count else moved).cast(pa.int32()))


def _known(*columns: pa.Array) -> np.ndarray:
    return np.logical_and.reduce([c.is_valid().to_numpy(zero_copy_only=False) for c in columns])


@lru_cache(maxsize=64)
def _padded(row: int):
    """BINARY -> ARRAY<INT> of its bytes, filled up with zeros to whole rows."""

    def run(content: pa.Array) -> pa.Array:
        known = _known(content)
        data = [x.as_buffer() if k else b"" for x, k in zip(content, known.tolist(), strict=True)]
        upto = np.concatenate([[0], np.cumsum([-(-len(x) // row) * row for x in data])])
        pixels = np.zeros(int(upto[-1]), np.int32)
        for x, a in zip(data, upto.tolist(), strict=False):
            pixels[a:a + len(x)] = np.frombuffer(x, np.uint8)
        return pa.ListArray.from_arrays(pa.array(upto.astype(np.int32), mask=np.append(~known, False)), pa.array(pixels))

    run.__annotations__ = {"content": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<int>")


def image_from_bytes(content: Column | str, width: int, channels: int = 3) -> Column:
    """Read a byte string as an HWC image `width` pixels wide; the last row is zero-padded."""
    row = width * channels
    h = F.ceil(F.octet_length(content) / F.lit(row)).cast("int")
    return F.struct(h.alias("height"), F.lit(width).alias("width"), F.lit(channels).alias("n_channels"), _padded(row)(content).alias("data"))


def _positions(n: Column) -> Column:
    """0 .. n - 1, empty for n = 0 (a sequence would count down)."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def bgr_to_rgb(img: Column) -> Column:
    """Spark's image source stores gray, BGR or BGRA; three channels in RGB order.

    A gray value stands for all three channels; an image without pixels stays one.
    """

    def body(i: Column) -> Column:
        c = i["n_channels"]

        def channel(p: Column, nth: int) -> Column:
            return F.get(i["data"], p * c + F.when(c < 3, 0).otherwise(nth))

        data = F.flatten(F.transform(_positions(i["height"] * i["width"]), lambda p: F.array(channel(p, 2), channel(p, 1), channel(p, 0))))
        return F.struct(i["height"].alias("height"), i["width"].alias("width"), F.lit(3).alias("n_channels"), data.alias("data"))

    return let(img, body)


@lru_cache(maxsize=2)
def _layout(to_chw: bool):
    """Flat HWC <-> flat CHW data of the shape (height, width, channels)."""

    def move(x: np.ndarray, h: int, w: int, c: int) -> np.ndarray:
        if len(x) < h * w * c:
            raise ValueError(f"{len(x)} values are no image of {h} x {w} x {c}")
        if to_chw:
            return x[:h * w * c].reshape(h, w, c).transpose(2, 0, 1).ravel()
        return x[:h * w * c].reshape(c, h, w).transpose(1, 2, 0).ravel()

    def run(data: pa.Array, h: pa.Array, w: pa.Array, c: pa.Array) -> pa.Array:
        return _each_row(data, [h, w, c], _known(data, h, w, c), move)

    run.__annotations__ = dict.fromkeys(("data", "h", "w", "c", "return"), pa.Array)
    return F.arrow_udf(run, "array<int>")


def hwc_to_chw(img: Column) -> Column:
    """F-9: flat HWC data -> flat CHW data (the tensor layout)."""
    return _layout(True)(img["data"], img["height"], img["width"], img["n_channels"])


def chw_to_hwc(data: Column, height: Column, width: Column, channels: Column) -> Column:
    """F-9 inverse: flat CHW -> flat HWC."""
    return _layout(False)(data, height, width, channels)


@lru_cache(maxsize=1)
def _inside():
    """Flat HWC data without margins of (mh, mw) pixels on each side."""

    def move(x: np.ndarray, h: int, w: int, c: int, mh: int, mw: int) -> np.ndarray:
        whole = x[:h * w * c]
        if len(whole) == h * w * c:
            return whole.reshape(h, w, c)[mh:h - mh, mw:w - mw].ravel()
        k = np.arange(len(whole))  # an image that ends early
        y, at = k // (w * c), k // c % w
        return whole[(y >= mh) & (y < h - mh) & (at >= mw) & (at < w - mw)]

    def run(data: pa.Array, h: pa.Array, w: pa.Array, c: pa.Array, mh: pa.Array, mw: pa.Array) -> pa.Array:
        return _each_row(data, [h, w, c, mh, mw], _known(data, h, w, c), move)

    run.__annotations__ = dict.fromkeys(("data", "h", "w", "c", "mh", "mw", "return"), pa.Array)
    return F.arrow_udf(run, "array<int>")


def crop(img: Column, factor_h: float, factor_w: float) -> Column:
    """F-18: center crop; margin = int(min(dim * factor, dim / 2)) on each side.

    Both factors must be non-zero, else the image is unchanged (as the
    reference's truthiness guard does).
    """
    if not (factor_h and factor_w):
        return img
    h, w, c = img["height"], img["width"], img["n_channels"]
    mh = F.floor(F.least(h * F.lit(float(factor_h)), h / 2.0)).cast("int")
    mw = F.floor(F.least(w * F.lit(float(factor_w)), w / 2.0)).cast("int")
    kept = _inside()(img["data"], h, w, c, mh, mw)
    return F.struct((h - 2 * mh).alias("height"), (w - 2 * mw).alias("width"), c.alias("n_channels"), kept.alias("data"))


def bin_lookup(n_bins: int, mode: str = "mean") -> list[int]:
    """The value that stands for each channel value 0 .. 255 (256 entries).

    n bins cut [0, 255] at the edges k * 255 / n; a value belongs to the last
    bin whose lower edge it reaches. With 255 bins or more nothing is merged.
    """
    if n_bins < 1:
        raise ValueError(f"{n_bins} bins cannot hold any value")
    top = MAX_CHANNEL_VALUES - 1
    if n_bins >= top:
        return list(range(MAX_CHANNEL_VALUES))
    edges = [k * (top / n_bins) for k in range(n_bins)]
    stand_in = [int(BIN_VALUES[mode](lo, hi)) for lo, hi in zip(edges, [*edges[1:], top])]
    return [stand_in[bisect_right(edges, v) - 1] for v in range(MAX_CHANNEL_VALUES)]


def downsample_channels(data: Column, n_bins: int, mode: str = "mean") -> Column:
    """F-19: map every channel value through the bin table (built once on the driver)."""
    lut = F.array(*[F.lit(v) for v in bin_lookup(n_bins, mode)])
    return F.transform(data, lambda v: F.element_at(lut, v + 1))


def grayscale(img: Column) -> Column:
    """F-20: RGB -> 8-bit luma with 16-bit fixed-point weights; gray stays gray."""
    r_w, g_w, b_w, rnd = LUMA

    def body(i: Column) -> Column:
        n = i["height"] * i["width"]
        luma = F.transform(
            _positions(n),
            lambda p: F.shiftright(
                F.element_at(i["data"], p * 3 + 1) * r_w
                + F.element_at(i["data"], p * 3 + 2) * g_w
                + F.element_at(i["data"], p * 3 + 3) * b_w
                + F.lit(rnd),
                16,
            ),
        )
        return F.struct(i["height"].alias("height"), i["width"].alias("width"), F.lit(1).alias("n_channels"), luma.alias("data"))

    return let(img, lambda i: F.when(i["n_channels"] == 1, i).otherwise(body(i)))


def dense_remap(a: Column, range_start: int) -> Column:
    """A-13: STRUCT(remapped, unique, inverse): sorted distinct values, each value's
    index among them, and that index shifted to start at `range_start`."""

    def body(x: Column) -> Column:
        return let(
            F.array_sort(F.array_distinct(x)),
            lambda u: let(
                F.transform(x, lambda v: F.array_position(u, v) - 1),
                lambda inv: F.struct(
                    F.transform(inv, lambda j: j + F.lit(range_start)).alias("remapped"),
                    u.alias("unique"),
                    inv.alias("inverse"),
                ),
            ),
        )

    return let(a, body)


# ---------------------------------------------------------------------------
# F-21 / F-22: resizing needs a per-image resampling kernel; it runs as an
# Arrow batch function over image rows, once per distinct image.
LANCZOS_A = 3
FIXED_BITS = 22


def _lanczos(x: np.ndarray) -> np.ndarray:
    x = np.abs(x)
    return np.where(x < LANCZOS_A, np.sinc(x) * np.sinc(x / LANCZOS_A), 0.0)


@lru_cache(maxsize=1024)
def _resample_matrix(n_in: int, n_out: int) -> np.ndarray:
    """(n_out, n_in) Lanczos-3 weights (antialiased when shrinking) as integers of `FIXED_BITS` fraction bits."""
    scale = n_in / n_out
    fscale = max(scale, 1.0)
    support = LANCZOS_A * fscale
    m = np.zeros((n_out, n_in))
    for i in range(n_out):
        center = (i + 0.5) * scale
        lo = max(int(center - support + 0.5), 0)
        hi = min(int(center + support + 0.5), n_in)
        j = np.arange(lo, hi)
        w = _lanczos((j - center + 0.5) * (1.0 / fscale))
        s = w.sum()
        m[i, lo:hi] = w / s if s else w
    # half away from zero; the products below stay under 2**53, so doubles hold them exactly
    return np.trunc(m * (1 << FIXED_BITS) + np.copysign(0.5, m))


def _resample(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Weighted sums along the first axis, rounded and clipped to a byte."""
    return np.clip(np.floor((weights @ rows + (1 << (FIXED_BITS - 1))) / (1 << FIXED_BITS)), 0, 255)


def resize_array(hwc: np.ndarray, width: int, height: int) -> np.ndarray:
    """Resize an (H, W, C) uint8 array: horizontal pass, then vertical, in fixed point with a byte after each."""
    h, w, c = hwc.shape
    x = hwc.astype(np.float64).transpose(1, 0, 2).reshape(w, h * c)
    x = _resample(_resample_matrix(w, width), x).reshape(width, h, c).transpose(1, 0, 2)
    y = _resample(_resample_matrix(h, height), x.reshape(h, width * c))
    return y.reshape(height, width, c).astype(np.uint8)


def resize_images(df, key: str, img: str, width: int, height: int):
    """F-21: `(key, img)` rows -> `(key, img)` resized to (width, height) with Lanczos-3.

    Two passes of 8-bit resampling with 22-bit integer weights, the rule that
    imaging libraries use for bytes: sums are rounded to a byte after each
    pass, so every engine that follows it gets the same bytes.
    """
    if not (width and height):
        return df.select(key, img)
    flat = df.select(key, F.col(f"{img}.height").alias("h"), F.col(f"{img}.width").alias("w"),
                     F.col(f"{img}.n_channels").alias("c"), F.col(f"{img}.data").alias("d"))
    key_type = flat.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            data, offsets = batch.column("d").flatten().to_numpy(zero_copy_only=False), batch.column("d").offsets.to_numpy()
            offsets = offsets - offsets[0]
            shapes = zip(*(batch.column(c).to_pylist() for c in ("h", "w", "c")), strict=True)
            out = [resize_array(data[a:b].reshape(shape), width, height).ravel() for a, b, shape in zip(offsets[:-1], offsets[1:], shapes, strict=True)]
            upto = np.concatenate([[0], np.cumsum([len(o) for o in out])]).astype(np.int32)
            pixels = np.concatenate([*out, np.zeros(0, np.uint8)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array(np.full(batch.num_rows, height, np.int32)), pa.array(np.full(batch.num_rows, width, np.int32)),
                 batch.column("c"), pa.ListArray.from_arrays(pa.array(upto), pa.array(pixels))], names=[key, "h", "w", "c", "d"])

    res = flat.mapInArrow(run, f"{key} {key_type}, h INT, w INT, c INT, d ARRAY<INT>")
    return res.select(key, F.struct(F.col("h").alias("height"), F.col("w").alias("width"),
                                    F.col("c").alias("n_channels"), F.col("d").alias("data")).alias(img))


def process_images(df, key: str, img: str, *, crop_hw=None, resize_wh=None, bins=None, shift_start=None):
    """F-22: crop -> resize -> flatten to CHW -> channel bins -> optional dense remap.

    Applied to each distinct image once; join the result to its questions (J-1).
    Steps follow the reference's guards: crop needs both factors, resize both
    sizes, the remap only runs after binning.
    """
    x = df.select(key, F.col(img).alias("_img"))
    if crop_hw and crop_hw[0] and crop_hw[1]:
        x = x.select(key, crop(F.col("_img"), *crop_hw).alias("_img"))
    if resize_wh and resize_wh[0] and resize_wh[1]:
        x = resize_images(x, key, "_img", resize_wh[0], resize_wh[1])
    # the layout only moves values, so it may come before the steps that map each value (and Spark
    # does not evaluate an Arrow function over a lambda over another Arrow function)
    x = x.select(key, hwc_to_chw(F.col("_img")).alias("pixels"))
    if bins:
        x = x.select(key, downsample_channels(F.col("pixels"), bins).alias("pixels"))
        if shift_start:
            x = x.select(key, dense_remap(F.col("pixels"), shift_start)["remapped"].alias("pixels"))
    return x
