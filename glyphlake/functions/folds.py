"""Scans that depend on all before them, inside one cell: a text's sentences, units, matches or strokes.

Each takes arrays that come from one text or one column of a page, and runs through them once.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTS = T.ArrayType(T.IntegerType())
_PLACES = T.ArrayType(T.StructType([T.StructField("line", T.IntegerType()), T.StructField("used", T.IntegerType())]))
_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType())]))
_CELLS = T.ArrayType(T.StructType([T.StructField("top", T.DoubleType()), T.StructField("height", T.DoubleType())]))


def _over_arrays(fold: Callable, kind: T.DataType, *arrays) -> Column:
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([None if any(v is None for v in row) else fold(*row) for row in zip(*columns)], dtype=object)

    if len(arrays) == 1:
        return F.pandas_udf(lambda a: run(a), kind)(*arrays)
    return F.pandas_udf(lambda a, b: run(a, b), kind)(*arrays)


def pack(lengths, targets: tuple[int, ...], min_tail: int) -> Column:
    """Per sentence the number of its passage; -1 for a last passage shorter than ``min_tail``."""
    def fold(sizes):
        out, passage, total = [], 0, 0
        for n in sizes:
            out.append(passage)
            total += int(n)
            if total >= targets[passage % len(targets)]:
                passage, total = passage + 1, 0
        return out if total >= min_tail else [p if p < passage else -1 for p in out]

    return _over_arrays(fold, _INTS, lengths)


def wrap(lengths, whole, k: int) -> Column:
    """Per segment the (line, used) that its first character finds, in lines of ``k`` cells.

    A ``whole`` segment, which is no longer than a line, goes to the next one if it does not fit; others run on.
    """
    def fold(sizes, kept):
        out, line, used = [], 0, 0
        if any(n is None or n != n for n in sizes):
            return None
        for n, one in zip(map(int, sizes), kept):
            if one and used + n > k and used:
                line, used = line + 1, 0
            out.append({"line": line, "used": used})
            used += n
            if used > k:
                line, used = line + (used - 1) // k, (used - 1) % k + 1
        return out

    return _over_arrays(fold, _PLACES, lengths, whole)


def greedy(starts, lengths) -> Column:
    """(start, length) of the matches taken from left to right, each after the end of the one before."""
    def fold(at, sizes):
        out, end = [], 0
        for p, n in zip(at, sizes):
            if p >= end:
                out.append({"start": int(p), "length": int(n)})
                end = p + n
        return out

    return _over_arrays(fold, _SPANS, starts, lengths)


def cells(starts, ends, em: float) -> Column:
    """Character cells of a column from its strokes, given in order.

    Strokes join while together they stay within 1.15 ``em`` and less than 0.45 apart; what is taller
    is cut into equal parts; what is lower than 0.85 grows to 0.9, by half of each gap at most.
    """
    def fold(lows, highs):
        joined: list[list[int]] = []
        for a, b in zip(lows, highs):
            if joined and b - joined[-1][0] + 1 <= em * 1.15 and a - joined[-1][1] - 1 < em * 0.45:
                joined[-1][1] = b
            else:
                joined.append([a, b])
        spans = []
        for a, b in joined:
            parts = max(1, int((b - a + 1) / em + 0.5))
            each = (b - a + 1) / parts
            spans += [(a + i * each, each) for i in range(parts)]
        out = []
        for i, (top, height) in enumerate(spans):
            if height < em * 0.85:
                above = (top - spans[i - 1][0] - spans[i - 1][1]) / 2 if i else float("inf")
                below = (spans[i + 1][0] - top - height) / 2 if i + 1 < len(spans) else float("inf")
                grow = (em * 0.9 - height) / 2
                top, height = top - min(grow, above), height + min(grow, above) + min(grow, below)
            out.append({"top": float(top), "height": float(height)})
        return out

    return _over_arrays(fold, _CELLS, starts, ends)
