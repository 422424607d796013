"""Pooling of token vectors and of frame maps (array of channels, each an array of frames)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beatloom.functions.arrays import _finite, let

# How sample bounds map to frames.
DOWNSAMPLING = 5
MARGIN_FRAMES = 2
MIN_FRAMES = 3

VALUES = 1 << 20  # vector values averaged at once


def masked_mean(vectors: Column | Callable[[pa.Array], pa.Array], tokens: Column, dim: int, pad: int = 0) -> Column:
    """Mean of the vectors whose token is not padding; NULL where an array, or the vector of a real token, is missing.

    ``vectors``: an array of vectors beside the ``tokens``, or a function that makes the vectors of an array of tokens, one
    each, so that they are made where they are averaged. Array work without a shuffle, done on Arrow batches; the
    vectors of a row are summed in their order."""
    if isinstance(vectors, Column):

        @F.arrow_udf(T.ArrayType(T.DoubleType()))
        def beside(given: pa.Array, ids: pa.Array) -> pa.Array:
            return _masked_means(given, ids, dim, pad)

        return beside(vectors, tokens)

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def made(ids: pa.Array) -> pa.Array:
        return _masked_means(vectors, ids, dim, pad)

    return made(tokens)


def _masked_means(vectors: pa.Array | Callable[[pa.Array], pa.Array], tokens: pa.Array, dim: int, pad: int, most: int = VALUES) -> pa.Array:
    """The means of a batch, of rows with about ``most`` vector values at a time."""
    step = max(1, most // max(1, dim * int(_sizes(tokens).max(initial=0))))
    part = lambda i: vectors if callable(vectors) else vectors.slice(i, step)
    starts = range(0, max(1, len(tokens)), step)
    return pa.concat_arrays([_masked_mean_rows(part(i), tokens.slice(i, step), dim, pad) for i in starts])


def _masked_mean_rows(vectors: pa.Array | Callable[[pa.Array], pa.Array], tokens: pa.Array, dim: int, pad: int) -> pa.Array:
    rows, size, flat = len(tokens), _sizes(tokens), tokens.flatten()
    row = np.repeat(np.arange(rows), size)
    known = np.array(tokens.is_valid())
    real = np.array(pc.not_equal(flat, pad).fill_null(False))
    if callable(vectors):
        picked = vectors(flat).filter(pa.array(real))
    else:
        known &= np.asarray(vectors.is_valid())
        real &= known[row]
        place = (np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size))[real]
        held = _sizes(vectors)
        at = (np.cumsum(held) - held)[row[real]] + place
        picked = vectors.flatten().take(pa.array(at, mask=place >= held[row[real]]))
    row = row[real]
    count = np.bincount(row, minlength=rows)
    known &= np.bincount(row[np.asarray(picked.is_valid())], minlength=rows) == count
    width = _sizes(picked)
    start = np.cumsum(width) - width
    values = picked.flatten().cast(pa.float64())
    value, valued = np.asarray(values.fill_null(0.0)), np.asarray(values.is_valid())
    # A vector that is longer than ``dim`` lengthens the mean by NULLs.
    length = np.full(rows, dim)
    np.maximum.at(length, row, width)
    total = np.zeros((rows, int(length.max(initial=dim))))
    lost = np.ones(total.shape, bool)
    for k in range(dim):
        has = width > k
        cell = start[has] + k
        total[:, k] = np.bincount(row[has], value[cell], minlength=rows)
        lost[:, k] = np.bincount(row[has], valued[cell], minlength=rows) < count
    total /= np.maximum(count, 1e-9)[:, None]
    inside = np.arange(total.shape[1]) < length[:, None]
    ends = pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32())
    return pa.ListArray.from_arrays(ends, pa.array(total[inside], mask=lost[inside]), mask=pa.array(~known))


def _sizes(lists: pa.Array) -> np.ndarray:
    return np.asarray(pc.list_value_length(lists).fill_null(0)).astype(np.int64)


def _widened(span: Column, before: Column, after: Column, frames: Column) -> Column:
    """The span (lo, hi) moved outwards, within 0 and ``frames``."""
    return F.struct(F.greatest(span["lo"] - before, F.lit(0)).alias("lo"), F.least(span["hi"] + after, frames).alias("hi"))


def frame_range(start: Column, end: Column, stride: int, frames: Column) -> Column:
    """Struct (lo, hi): the frames that a range of samples touches, a margin on both sides,
    and where that is short, so many more that the least number is reached."""
    slow = lambda sample: F.rint(sample / F.lit(float(DOWNSAMPLING)))
    touched = F.struct(
        F.floor(slow(start) / stride).cast("int").alias("lo"),
        F.ceil(F.greatest(slow(end), slow(start) + 1) / stride).cast("int").alias("hi"),
    )
    margin = F.lit(MARGIN_FRAMES)

    def at_least(span: Column) -> Column:
        lacking = F.greatest(F.lit(MIN_FRAMES) - (span["hi"] - span["lo"]), F.lit(0))
        before = F.floor(lacking / 2).cast("int")
        return let(_widened(span, before, lacking - before, frames), not_empty(lacking))

    def not_empty(lacking: Column):
        # A range past the last frame takes the frame at its place, where there is one.
        one = lambda span: F.struct(span["lo"].alias("lo"), F.least(span["lo"] + 1, frames).alias("hi"))
        return lambda span: F.when((lacking > 0) & (span["hi"] <= span["lo"]), one(span)).otherwise(span)

    return let(let(touched, lambda span: _widened(span, margin, margin, frames)), at_least)


def roi_pool(channels: Column, start: Column, end: Column, stride: int) -> Column:
    """Mean of every channel over the range, then maximum of every channel.
    Non-finite frames count as 0; NULL when the range lies beyond the frames."""
    frames = F.size(F.element_at(channels, 1))

    def pool(t: Column) -> Column:
        part = lambda ch: F.transform(F.slice(ch, t["lo"] + 1, t["hi"] - t["lo"]), lambda x: F.when(_finite(x), x).otherwise(0.0))
        cut = F.transform(channels, part)
        avg = F.transform(cut, lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a))
        return F.when(t["hi"] > t["lo"], F.concat(avg, F.transform(cut, lambda a: F.array_max(a))))

    return let(frame_range(start, end, stride, frames), pool)


def adaptive_pool(channels: Column, bins: int = 10) -> Column:
    """Every channel averaged into ``bins`` bins, then every channel's bin maxima.
    Bin i covers [floor(i*L/bins), ceil((i+1)*L/bins))."""
    edges = F.sequence(F.lit(0), F.lit(bins - 1))

    def cuts(a: Column) -> Column:
        lo = lambda i: F.floor(i * F.size(a) / bins).cast("int")
        hi = lambda i: F.ceil((i + 1) * F.size(a) / bins).cast("int")
        return F.transform(edges, lambda i: F.slice(a, lo(i) + 1, hi(i) - lo(i)))

    avg = F.transform(channels, lambda a: F.transform(cuts(a), lambda b: F.aggregate(b, F.lit(0.0), lambda s, x: s + x) / F.size(b)))
    top = F.transform(channels, lambda a: F.transform(cuts(a), lambda b: F.array_max(b)))
    return F.concat(F.flatten(avg), F.flatten(top))
