"""Glyphs of a page compared by place in Python workers."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pairs of glyphs that are compared together.
_PAIRS = 1 << 21
#: So many distinct whole numbers in a row are counted without sorting.
_NARROW = 1 << 20


def told_by_page(rows: DataFrame, page: Sequence[str], run: Callable[..., dict], columns: Sequence[Column | str], kinds: dict[str, str],
                 *known) -> DataFrame:
    """(page, kinds): the rows that ``run`` tells of each page, as a dict of equally long columns, from ``known`` and the page's ``columns`` as Arrow arrays.

    An aggregate: where ``rows`` are dealt by page, they stay in place, and so does what is told.
    """
    whole = F.arrow_udf(_aggregate(run, known), ", ".join(f"`{n}` array<{k}>" for n, k in kinds.items()))
    told = rows.groupBy(*page).agg(whole(*columns).alias("_told"))
    return told.select(*page, F.inline(F.arrays_zip(*[F.col(f"_told.{n}").alias(n) for n in kinds])))


def has_page(page: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in page])


def _aggregate(run: Callable[..., dict], known: Sequence) -> Callable:
    def told(first: pa.Array, *more: pa.Array) -> Any:
        return run(*known, first, *more)

    # By these hints Spark tells an aggregate; as text they would not be found in the workers.
    told.__annotations__ = {"first": pa.Array, "more": pa.Array, "return": Any}
    return told


def numbers(column: pa.Array) -> np.ndarray:
    """As doubles; null is NaN."""
    return column.cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False)


def values(column: pa.Array) -> np.ndarray:
    """What becomes the same column again in what is told."""
    plain = column.to_numpy(zero_copy_only=False)
    return plain if not column.null_count else np.array(column.to_pylist(), object)


def doubles(found: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Numbers that are null where they are not ``there``."""
    if there.all():
        return found
    found = found.astype(object)
    found[~there] = None
    return found


def valid(column: pa.Array) -> np.ndarray:
    return column.is_valid().to_numpy(zero_copy_only=False)


def codes(column: pa.Array) -> np.ndarray:
    """Whole numbers that are equal and ordered as the values are; null comes first and is -1 unless numbers are their own codes."""
    if pa.types.is_integer(column.type) and not column.null_count:
        return column.to_numpy(zero_copy_only=False).astype(np.int64)
    words = column.dictionary_encode()
    rank = np.empty(len(words.dictionary), np.int64)
    rank[pc.sort_indices(words.dictionary).to_numpy()] = np.arange(len(rank))
    at = words.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    return np.where(at < 0, -1, rank[at]) if len(rank) else np.full(len(column), -1, np.int64)


def dense(*keys: np.ndarray) -> np.ndarray:
    """One number for each combination of whole numbers, ordered as they are, the first key first."""
    found = np.zeros(len(keys[0]), np.int64)
    for key in keys:
        if not len(key):
            return found
        low, high = int(key.min()), int(key.max())
        if high - low >= _NARROW:
            key, low, high = np.unique(key, return_inverse=True)[1], 0, len(key)
        found = found * (high - low + 1) + (key - low)
        if int(found.max()) >= 1 << 40:
            found = np.unique(found, return_inverse=True)[1]
    return found


def near(group: np.ndarray, x: np.ndarray, y: np.ndarray, own: np.ndarray, x0: np.ndarray, x1: np.ndarray, y0: np.ndarray, y1: np.ndarray,
         height: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (box, point) of one group of which the box holds the point, edges included, a part of the boxes at a time.

    ``group``, ``x``, ``y`` are those of the points, ``own`` and the sides those of the boxes. Points lie in bands of ``height``, sorted
    by x in a band; a box looks through the bands that it touches and that hold points of its group.
    """
    fine = np.isfinite(x) & np.isfinite(y)
    points, boxes = np.flatnonzero(fine), np.flatnonzero((x0 <= x1) & (y0 <= y1))
    if not len(points) or not len(boxes):
        return
    band = np.floor(y[points] / height)
    order = np.lexsort((x[points], band, group[points]))
    points, band = points[order], band[order]
    px, py, pg = x[points], y[points], group[points]
    new = np.concatenate([[True], (pg[1:] != pg[:-1]) | (band[1:] != band[:-1])])
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(px))
    # Bands as one number of group and band, and points as one of their band's place and x, so that both are found by bisection.
    kind = np.unique(pg[start])
    low, high = band.min(), band.max()
    tall = high - low + 3
    bands = np.searchsorted(kind, pg[start]) * tall + (band[start] - low + 1)
    left = px.min()
    wide = px.max() - left + 1.0
    along = (np.cumsum(new) - 1) * wide + (px - left)
    slack = 4 * np.spacing(len(start) * wide)
    at = np.searchsorted(kind, own[boxes])
    there = (at < len(kind)) & (kind[np.minimum(at, len(kind) - 1)] == own[boxes])
    boxes, at = boxes[there], at[there]

    def bounded(v):
        return np.clip(np.floor(v / height) - low, -1, high - low + 1) + 1

    first = np.searchsorted(bands, at * tall + bounded(y0[boxes]))
    n_bands = np.searchsorted(bands, at * tall + bounded(y1[boxes]), "right") - first
    n_bands = np.maximum(n_bands, 0)
    for lo, hi in _parts(n_bands):
        box, step = _spread(n_bands[lo:hi])
        one = first[lo:hi][box] + step
        box = boxes[lo:hi][box]
        base = one * wide - left
        a = np.maximum(np.searchsorted(along, base + np.clip(x0[box], left - 0.25, left + wide) - slack), start[one])
        b = np.minimum(np.searchsorted(along, base + np.clip(x1[box], left - 0.25, left + wide) + slack, "right"), end[one])
        n = np.maximum(b - a, 0)
        for u, v in _parts(n):
            k, step = _spread(n[u:v])
            hit, of = a[u:v][k] + step, box[u:v][k]
            held = (px[hit] >= x0[of]) & (px[hit] <= x1[of]) & (py[hit] >= y0[of]) & (py[hit] <= y1[of])
            yield of[held], points[hit[held]]


def _spread(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``sizes[i]`` things: i, and its number from 0."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _parts(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of ``sizes`` that sum up to about ``_PAIRS``."""
    total, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + _PAIRS, "right")))
        yield at, to
        at = to
