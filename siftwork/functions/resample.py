"""Grey pictures of any size as the small grids that difference hashes are made of.

A picture is its width, its height and one byte a pixel, row by row. Both kinds of resampling are
separable: a sparse table of weights for each side, applied to rows and then to columns.

``windowed``: a sinc with three lobes, stretched over as many pixels as a cell covers. Weights are
rounded to 22 bits and each of the two passes rounds to whole greys and clips to 0..255, rows first.
``area``: the exact average of what a cell covers, in whole numbers, rounded half to even once, at
the end. A cell smaller than a pixel takes the pixels it lies in.

A picture is unreadable if a part of it is null, a side isn't positive, or there are more or fewer
pixels than its sides say; its grid is null. Hashes of the two kinds can't be compared.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keys import dhash, sha256

COLUMNS, ROWS = 9, 8
KINDS = ("windowed", "area")
#: Fixed values of windowed resampling: lobes on a side, and bits that a weight is rounded to.
LOBES, WEIGHT_BITS = 3, 22
#: Bytes of the weights that a Python process keeps, at most.
KEPT_BYTES = 48 << 20


def windowed_weights(size: int, cells: int) -> list[tuple[int, int, int]]:
    """``cell, pixel, weight`` for a side of ``size`` pixels, weights in units of 2^-22."""
    scale = size / cells
    stretch = max(scale, 1.0)
    out = []
    for cell in range(cells):
        centre = (cell + 0.5) * scale
        first = max(0, int(centre - LOBES * stretch + 0.5))
        last = min(size, int(centre + LOBES * stretch + 0.5))
        at = [(x - centre + 0.5) / stretch for x in range(first, last)]
        raw = [_sinc(t) * _sinc(t / LOBES) if -LOBES <= t < LOBES else 0.0 for t in at]
        total = sum(raw)
        for x, w in enumerate(raw, first):
            share = w / total * (1 << WEIGHT_BITS)
            out.append((cell, x, int(share + (0.5 if share >= 0 else -0.5))))
    return out


def _sinc(t: float) -> float:
    return 1.0 if t == 0 else math.sin(math.pi * t) / (math.pi * t)


def area_weights(size: int, cells: int) -> list[tuple[int, int, int]]:
    """``cell, pixel, weight`` for a side; a cell's weights, in units of 1/cells pixel, add up to ``size``."""
    out = []
    for cell in range(cells):
        begin, end = cell * size, (cell + 1) * size
        for x in range(begin // cells, -(-end // cells)):
            out.append((cell, x, min(end, (x + 1) * cells) - max(begin, x * cells)))
    return out


_kept: OrderedDict[tuple[str, int, int], np.ndarray] = OrderedDict()
_held = [0]


def _matrix(kind: str, size: int, cells: int) -> np.ndarray:
    """The weights of a side as a matrix. The last ones are kept, up to ``KEPT_BYTES``: a long side's has megabytes."""
    key = (kind, size, cells)
    if key in _kept:
        _kept.move_to_end(key)
        return _kept[key]
    made = np.zeros((size, cells))
    if kind == "area":
        # area_weights for all pixels of a cell at once
        for cell in range(cells):
            begin, end = cell * size, (cell + 1) * size
            first, last = begin // cells, -(-end // cells)
            x = np.arange(first, last, dtype=np.int64)
            made[first:last, cell] = np.minimum(end, (x + 1) * cells) - np.maximum(begin, x * cells)
    else:
        for cell, x, w in windowed_weights(size, cells):
            made[x, cell] = w
    _kept[key] = made
    _held[0] += made.nbytes
    while _held[0] > KEPT_BYTES and len(_kept) > 1:
        _held[0] -= _kept.popitem(last=False)[1].nbytes
    return made


def resampled(pixels: np.ndarray, kind: str, columns: int = COLUMNS, rows: int = ROWS) -> np.ndarray:
    """The grid of a picture given as a matrix of greys. Sums of products stay whole in doubles."""
    across, down = _matrix(kind, pixels.shape[1], columns), _matrix(kind, pixels.shape[0], rows)
    if kind == "area":
        # numerator and denominator are whole, so halves are seen exactly
        total, whole = down.T @ (pixels @ across), float(pixels.shape[0] * pixels.shape[1])
        floor = np.floor(total / whole)
        rest = total - floor * whole
        up = (2 * rest > whole) | ((2 * rest == whole) & (floor % 2 == 1))
        return (floor + up).astype(np.int64)
    half, unit = float(1 << (WEIGHT_BITS - 1)), float(1 << WEIGHT_BITS)
    passed = lambda sums: np.clip(np.floor((sums + half) / unit), 0, 255)
    flat = pixels.astype(np.float64)
    # a side that already has as many pixels as the grid passes unchanged
    flat = flat if pixels.shape[1] == columns else passed(flat @ across)
    return (flat if pixels.shape[0] == rows else passed(down.T @ flat)).astype(np.int64)


def grid(pixels: Column, width: Column, height: Column, kind: str = "windowed", columns: int = COLUMNS, rows: int = ROWS) -> Column:
    """The grid of a picture, row by row, as an array of int; null for an unreadable one."""
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")

    @F.pandas_udf("array<int>")
    def made(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for p, w, h in batches:
            shaped = (np.frombuffer(x, np.uint8).reshape(int(b), int(a)) for x, a, b in zip(p, w, h))
            yield pd.Series([resampled(m, kind, columns, rows).ravel().tolist() for m in shaped], index=p.index, dtype=object)

    # the function sees readable pictures only: others are a picture of one pixel, and null after it
    good = readable(pixels, width, height)
    one = [F.when(good, pixels).otherwise(F.lit(b"\0")), F.when(good, width).otherwise(1).cast("int"), F.when(good, height).otherwise(1).cast("int")]
    return F.when(good, made(*one))


def readable(pixels: Column, width: Column, height: Column) -> Column:
    """True if a picture has all the pixels that its sides say."""
    fits = (width > 0) & (height > 0) & (F.octet_length(pixels).cast("long") == width.cast("long") * height.cast("long"))
    return F.coalesce(fits, F.lit(False))


def with_key(pictures: DataFrame, name: str, content: str, pixels: str, width: str, height: str, kind: str = "windowed") -> DataFrame:
    """``pictures`` with what tells them apart as the struct ``name``: content hash, difference hash of
    pixels and sides; null for an unreadable picture.

    ``windowed`` grids are read for falling neighbours, ``area`` grids for rising ones.
    """
    p, w, h = F.col(pixels), F.col(width), F.col(height)
    made = pictures.withColumn("_grid", grid(p, w, h, kind))
    hashed = dhash(F.col("_grid"), COLUMNS, ROWS, rising=kind == "area")
    whole = F.struct(sha256(F.col(content)).alias("sha256"), hashed.alias("dhash"), w.cast("int").alias("width"), h.cast("int").alias("height"))
    return made.withColumn(name, F.when(F.col("_grid").isNotNull(), whole)).drop("_grid")
