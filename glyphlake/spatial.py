"""Point-in-box joins as equi joins on grid cells.

A theta join is a nested loop. On each axis a box is put on the grid level whose
cell is at least as long as its side there, so it covers at most two cells per
axis, also when it is long and thin; a point looks into one cell per pair of levels
that its group's boxes have. The exact test runs afterwards.

Every level more is a row more per point, so ``base`` should be about the side of the
usual box: smaller boxes share the finest level.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE_CELL = 16.0
#: For windows and regions of a screen, which are hundreds of units wide: nearly all share one level.
SCREEN_CELL = 1024.0


def _level(side: Column, base: float) -> Column:
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(side, F.lit(base)) / F.lit(base)))).cast("int")


def _cell(value: Column, level: Column, base: float) -> Column:
    return F.floor(value / (F.lit(base) * F.pow(F.lit(2.0), level))).cast("bigint")


def cell_join(points: DataFrame, boxes: DataFrame, on: Sequence[str],
              axes: Sequence[tuple[str, str, str]], base: float = BASE_CELL) -> DataFrame:
    """Inner join where every axis has ``low <= point <= high``.

    ``axes`` lists (point column, box low column, box high column). Column names
    other than ``on`` must differ between the sides.
    """
    boxed, levels, cells = boxes, [], []
    for i, (_, lo, hi) in enumerate(axes):
        boxed = boxed.where(F.col(lo) <= F.col(hi)).withColumn(f"_l{i}", _level((F.col(hi) - F.col(lo)).cast("double"), base))
        levels.append(f"_l{i}")
        cells.append(f"_c{i}")
    used = boxed.select(*on, *levels).distinct()
    for i, (_, lo, hi) in enumerate(axes):
        first, last = (_cell(F.col(c), F.col(f"_l{i}"), base) for c in (lo, hi))
        boxed = boxed.withColumn(f"_c{i}", F.explode(F.sequence(first, last)))
    found = points.join(used, list(on))
    for i, (p, _, _) in enumerate(axes):
        found = found.withColumn(f"_c{i}", _cell(F.col(p), F.col(f"_l{i}"), base))
    joined = found.join(boxed, [*on, *levels, *cells])
    for p, lo, hi in axes:
        joined = joined.where((F.col(p) >= F.col(lo)) & (F.col(p) <= F.col(hi)))
    return joined.drop(*levels, *cells)


def overlap_join(ours: DataFrame, theirs: DataFrame, on: Sequence[str],
                 axes: Sequence[tuple[str, str, str, str]], base: float = BASE_CELL) -> DataFrame:
    """Inner join where on every axis the two intervals meet, edges included.

    ``axes`` lists (our low, our high, their low, their high). Two boxes are compared on the
    coarser of their levels, where each covers at most two cells per axis; a pair counts in
    the cell that holds the low corner of its common part.
    """
    for side, at in (("a", 0), ("b", 2)):
        df = ours if side == "a" else theirs
        for i, axis in enumerate(axes):
            lo, hi = axis[at:at + 2]
            df = df.where(F.col(lo) <= F.col(hi)).withColumn(f"_{side}{i}", _level((F.col(hi) - F.col(lo)).cast("double"), base))
        ours, theirs = (df, theirs) if side == "a" else (ours, df)
    n = range(len(axes))
    mine, other, cells = ([f"_{s}{i}" for i in n] for s in "abc")
    left = ours.join(theirs.select(*on, *other).distinct(), list(on))
    right = theirs.join(ours.select(*on, *mine).distinct(), list(on))
    top = [F.greatest(f"_a{i}", f"_b{i}") for i in n]
    for i, (alo, ahi, blo, bhi) in enumerate(axes):
        left = left.withColumn(cells[i], F.explode(F.sequence(_cell(F.col(alo), top[i], base), _cell(F.col(ahi), top[i], base))))
        right = right.withColumn(cells[i], F.explode(F.sequence(_cell(F.col(blo), top[i], base), _cell(F.col(bhi), top[i], base))))
    met = left.join(right, [*on, *mine, *other, *cells])
    for i, (alo, ahi, blo, bhi) in enumerate(axes):
        met = met.where((F.col(alo) <= F.col(bhi)) & (F.col(blo) <= F.col(ahi))
                        & (F.col(cells[i]) == _cell(F.greatest(alo, blo), top[i], base)))
    return met.drop(*mine, *other, *cells)
