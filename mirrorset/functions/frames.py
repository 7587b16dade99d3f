"""Pixel-level column functions over gray frames kept as array<smallint>."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mirrorset.functions.bits import col, let, pack_bits
from mirrorset.schema import BLACK_LIMIT, BRIGHTNESS_SCALE, FRAME_SIDE, WHITE_LIMIT


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda acc, x: acc + x)


def sad(a, b) -> Column:
    """Sum of absolute pixel differences (JVM side; fine for small frames)."""
    return _sum(F.zip_with(col(a), col(b), lambda x, y: F.abs(x - y).cast("bigint")))


def gray_diff(a, b) -> Column:
    return sad(a, b) / (F.size(col(a)) * F.lit(BRIGHTNESS_SCALE))


def _kept_pairs(a, b, ignore_black: bool, ignore_white: bool) -> Column:
    pairs = F.zip_with(col(a), col(b), lambda x, y: F.struct(x.alias("x"), y.alias("y")))

    def keep(p):
        ok = F.lit(True)
        if ignore_black:
            ok = ok & (p["x"] > BLACK_LIMIT) & (p["y"] > BLACK_LIMIT)
        if ignore_white:
            ok = ok & (p["x"] < WHITE_LIMIT) & (p["y"] < WHITE_LIMIT)
        return ok

    return F.filter(pairs, keep)


def masked_sad(a, b, ignore_black: bool, ignore_white: bool) -> Column:
    """(sum, count) over the pixels that neither side's mask drops."""
    kept = _kept_pairs(a, b, ignore_black, ignore_white)
    return F.struct(
        _sum(F.transform(kept, lambda p: F.abs(p["x"] - p["y"]).cast("bigint"))).alias("total"),
        F.size(kept).cast("bigint").alias("pixels"))


def gray_diff_masked(a, b, ignore_black: bool, ignore_white: bool) -> Column:
    """Null (never a match) when no pixel survives the masks."""
    parts = masked_sad(a, b, ignore_black, ignore_white)
    return parts["total"] / (F.nullif(parts["pixels"], F.lit(0)) * F.lit(BRIGHTNESS_SCALE))


def flip_rows(gray, side: int | Column) -> Column:
    """Mirror every row of a square frame."""
    s = F.lit(side) if isinstance(side, int) else side
    g = col(gray)
    return F.transform(g, lambda _, i: F.get(
        g, (F.floor(i / s) * s + s - 1 - i % s).cast("int")))


def dark_pixels(gray) -> Column:
    return F.size(F.filter(col(gray), lambda x: x <= BLACK_LIMIT))


def is_bright(gray, dark_percent: float = 80.0) -> Column:
    return dark_pixels(gray) * F.lit(100.0) < F.size(col(gray)) * F.lit(dark_percent)


def is_bright_rgb(rgb, dark_percent: float = 80.0) -> Column:
    """A pixel is dark only when all three channels are; incomplete pixels are ignored."""
    c = col(rgb)
    n = F.floor(F.size(c) / 3).cast("int")
    dark = F.size(F.filter(F.sequence(F.lit(0), n - 1), lambda i: (
        (F.get(c, i * 3) <= BLACK_LIMIT) & (F.get(c, i * 3 + 1) <= BLACK_LIMIT)
        & (F.get(c, i * 3 + 2) <= BLACK_LIMIT))))
    return F.when(n > 0, dark * F.lit(100.0) < n * F.lit(dark_percent)).otherwise(F.lit(False))


def median_bits(coefficients) -> Column:
    """64 numbers -> 64-bit hash: bit i is set when coefficient i exceeds the median."""
    c = col(coefficients)
    ordered = F.sort_array(c)
    median = (F.get(ordered, F.lit(31)) + F.get(ordered, F.lit(32))) / F.lit(2.0)
    return let(median, lambda m: pack_bits(F.transform(c, lambda x: x > m)))


# --- Arrow batches: one numpy pass per batch, used after candidates are known -----------------

def _matrix(values: pa.Array) -> np.ndarray:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    flat = values.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(values), -1) if len(values) else flat.reshape(0, 0)


def _on_valid(a: pa.Array, b: pa.Array, compute, out_type) -> pa.Array:
    """Apply ``compute`` to the rows where both sides exist; the others become null."""
    ok = a.is_valid().to_numpy(zero_copy_only=False) & b.is_valid().to_numpy(zero_copy_only=False)
    out = np.zeros(len(a), dtype=np.float64 if out_type == pa.float64() else np.int64)
    missing = ~ok
    if ok.any():
        if not ok.all():
            a, b = a.filter(pa.array(ok)), b.filter(pa.array(ok))
        values, empty = compute(a, b)
        out[ok] = values
        if empty is not None:
            missing[np.flatnonzero(ok)[empty]] = True
    return pa.array(out, type=out_type, mask=missing)


@F.arrow_udf(T.LongType())
def sad_batch(a: pa.Array, b: pa.Array) -> pa.Array:
    return _on_valid(a, b, lambda x, y: (
        np.abs(_matrix(x).astype(np.int32) - _matrix(y).astype(np.int32)).sum(axis=1), None), pa.int64())


def grid_sums(side: int, grid: int):
    """Pixel sums of a grid x grid partition of the frame, summed over all positions of a file."""
    step = max(1, -(-side // grid))

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def run(gray: pa.Array) -> pa.Array:
        if len(gray) == 0:
            return pa.array([], type=pa.list_(pa.int32()))
        frame = _matrix(gray).astype(np.int32).reshape(len(gray), -1, side, side).sum(axis=1)
        out = np.zeros((len(gray), grid, grid), dtype=np.int32)
        for y in range(grid):
            for x in range(grid):
                out[:, y, x] = frame[:, y * step:(y + 1) * step, x * step:(x + 1) * step].sum(axis=(1, 2))
        offsets = pa.array(np.arange(len(gray) + 1, dtype=np.int32) * grid * grid)
        return pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))

    return run


def masked_mean_batch(k: int, ignore_black: bool, ignore_white: bool):
    """Sum over k positions of the masked difference; null when a position has no pixel left."""

    def compute(a: pa.Array, b: pa.Array):
        x = _matrix(a).astype(np.int32).reshape(len(a), k, -1)
        y = _matrix(b).astype(np.int32).reshape(len(b), k, -1)
        keep = np.ones(x.shape, dtype=bool)
        if ignore_black:
            keep &= (x > BLACK_LIMIT) & (y > BLACK_LIMIT)
        if ignore_white:
            keep &= (x < WHITE_LIMIT) & (y < WHITE_LIMIT)
        count = keep.sum(axis=2)
        total = (np.abs(x - y) * keep).sum(axis=2)
        diff = (total / np.maximum(count, 1) / BRIGHTNESS_SCALE).sum(axis=1)
        return diff, (count == 0).any(axis=1)

    @F.arrow_udf(T.DoubleType())
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return _on_valid(a, b, compute, pa.float64())

    return run


def _dct_basis() -> np.ndarray:
    """Rows: the 64 products of the eight lowest non-constant vertical/horizontal cosines."""
    n, freq = FRAME_SIDE, np.arange(1, 9)[:, None]
    wave = np.cos((2 * np.arange(n)[None, :] + 1) * freq * np.pi / (2 * n)).astype(np.float32)
    return np.einsum("vy,ux->vuyx", wave, wave).reshape(64, n * n)


def phash_batch():
    """32x32 gray frames -> 64-bit perceptual hash, as one matrix product per Arrow batch."""
    basis = _dct_basis()

    @F.arrow_udf(T.LongType())
    def run(gray: pa.Array) -> pa.Array:
        valid = gray.is_valid().to_numpy(zero_copy_only=False)
        out = np.zeros(len(gray), dtype=np.int64)
        if valid.any():
            pixels = _matrix(gray.filter(pa.array(valid))).astype(np.float32)
            coef = pixels @ basis.T * np.float32(2.0 / FRAME_SIDE)
            mid = np.sort(coef, axis=1)[:, 31:33].mean(axis=1, dtype=np.float32)
            bits = np.packbits(coef > mid[:, None], axis=1, bitorder="little")
            out[valid] = np.ascontiguousarray(bits).view("<i8").ravel()
        return pa.array(out, type=pa.int64(), mask=~valid)

    return run
