"""Glyphs of upright columns set onto the character cells that a page's ink shows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphlake.functions.places import codes, dense, doubles, has_page, near, numbers, told_by_page, valid, values

#: A pair of cells may merge up to so many column widths; a cell may be halved from so many on; so often in all.
MERGE, HALVE, REPAIRS = 1.15, 1.4, 3
Box = tuple[float, float, float, float]


def repair(cells: list[Box], n: int, em: float) -> list[Box] | None:
    """``n`` cells (x0, y0, x1, y1) from those of a column, by few merges and halvings; None if that cannot be.

    Too many cells: the two neighbours that are lowest together become one. Too few: the tallest is halved.
    """
    cells = list(cells)
    for _ in range(REPAIRS):
        if len(cells) == n:
            break
        if len(cells) > n:
            heights = [b[3] - a[1] for a, b in zip(cells, cells[1:])]
            at = min(range(len(heights)), key=heights.__getitem__, default=None)
            if at is None or heights[at] > em * MERGE:
                return None
            a, b = cells[at:at + 2]
            cells[at:at + 2] = [(min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))]
        else:
            at = max(range(len(cells)), key=lambda i: cells[i][3] - cells[i][1], default=None)
            if at is None or cells[at][3] - cells[at][1] < em * HALVE:
                return None
            x0, y0, x1, y1 = cells[at]
            cells[at:at + 1] = [(x0, y0, x1, (y0 + y1) / 2), (x0, (y0 + y1) / 2, x1, y1)]
    return cells if len(cells) == n else None


def column_counts(line: np.ndarray, at: np.ndarray, n: np.ndarray, x0: np.ndarray, x1: np.ndarray, n_cells: np.ndarray,
                  slack: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The column of each line (-1: none), and the glyphs and the state of each column.

    A line belongs to the first column around its mean x ``at``. The state is ``index`` for as many glyphs as cells,
    ``repair`` if they differ by no more than the repairs allowed, else ``kept``.
    """
    zero = [np.zeros(len(v), np.int64) for v in (at, x0)]
    column = np.full(len(line), len(x0))
    for of, hit in near(zero[0], at, zero[0].astype(float), zero[1], x0 - slack, x1 + slack, *[zero[1].astype(float)] * 2, 1.0):
        np.minimum.at(column, hit, of)
    column[column == len(x0)] = -1
    held = column >= 0
    n_glyphs = np.bincount(column[held], weights=n[held], minlength=len(x0)).astype(np.int64)
    off = np.abs(n_glyphs - n_cells)
    # A column without lines is none.
    lined = np.bincount(column[held], minlength=len(x0)) > 0
    return column, n_glyphs, np.where(~lined | (off > REPAIRS), "kept", np.where(off == 0, "index", "repair"))


def repaired_cells(sides: np.ndarray, start: np.ndarray, n_cells: np.ndarray, n_glyphs: np.ndarray, em: np.ndarray,
                   state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Boxes (x0, y0, x1, y1) of all columns that have one for each glyph, at once or after a few repairs; their start and number by column.

    ``sides`` are the boxes of the cells, from top to bottom behind each column's ``start``.
    """
    boxes, size = [sides], np.where(state == "index", n_cells, 0)
    first, end = start.copy(), len(sides)
    for c in np.flatnonzero(state == "repair"):
        found = repair(list(map(tuple, sides[start[c]:start[c] + n_cells[c]].tolist())), int(n_glyphs[c]), float(em[c]))
        if found:
            boxes.append(np.array(found))
            first[c], size[c], end = end, len(found), end + len(found)
    return np.concatenate(boxes), first, size


def reanchor(glyphs: DataFrame, cells: DataFrame, page: Sequence[str], slack: int = 2) -> DataFrame:
    """``glyphs`` (page, li, ci, x, y, w, h, ..) with the boxes of their cells, and ``anchored``: index, repair or kept.

    The lines of a column, by the place of their first glyph, share its cells (page, col, x, y, w, h) from top to
    bottom, glyph by glyph; but only if there are as many glyphs as cells, at once or after a few repairs. Glyphs of
    other columns, and of lines outside all columns, keep their boxes.
    """
    box = [F.col(c).cast("double").alias(c) for c in "xywh"]
    rest = [c for c in glyphs.columns if c not in (*page, "li", "ci", *"xywh")]
    kinds = {c: glyphs.schema[c].dataType.simpleString() for c in ("li", "ci", *rest)}
    kind = cells.schema["col"].dataType.simpleString()
    ours = glyphs.select(*page, F.lit(True).alias("_glyph"), F.lit(None).cast(kind).alias("col"), *box, "li", "ci", *rest)
    theirs = cells.where(has_page(page)).select(*page, F.lit(False).alias("_glyph"), "col", *box, *[F.lit(None).cast(k).alias(c) for c, k in kinds.items()])
    # The glyphs and cells of a page travel together.
    told = told_by_page(ours.unionByName(theirs), page, _anchored, ["_glyph", "col", *"xywh", *kinds], {
        **kinds, **dict.fromkeys("xywh", "double"), "anchored": "string"}, list(kinds), float(slack))
    return told.select(*page, "li", "ci", *[c for c in glyphs.columns if c not in (*page, "li", "ci")], "anchored")


def _anchored(names: Sequence[str], slack: float, is_glyph: pa.Array, col: pa.Array, x: pa.Array, y: pa.Array, w: pa.Array, h: pa.Array,
              *more: pa.Array) -> dict:
    """``reanchor`` of one page."""
    sides = [numbers(c) for c in (x, y, w, h)]
    is_glyph = is_glyph.to_numpy(zero_copy_only=False)
    g, k = np.flatnonzero(is_glyph), np.flatnonzero(~is_glyph & valid(col))
    gx, gy, gw, gh = (v[g] for v in sides)
    more = [c.take(pa.array(g)) for c in more]
    li, ci, has_li, has_ci = codes(more[0]), codes(more[1]), valid(more[0]), valid(more[1])

    # Lines, with the mean x and the first y of their glyphs.
    whole = np.flatnonzero(has_li)
    line, of = np.unique(li[whole], return_inverse=True)
    n, middle = np.bincount(of, minlength=len(line)), (gx + gw / 2)[whole]
    there = ~np.isnan(middle)
    with np.errstate(invalid="ignore"):
        at = np.bincount(of[there], weights=middle[there], minlength=len(line)) / np.bincount(of[there], minlength=len(line))
    first, top = np.full(len(line), -np.inf), np.flatnonzero(has_ci[whole])
    top = top[np.lexsort((ci[whole[top]], of[top]))]
    lead = top[np.unique(of[top], return_index=True)[1]]
    first[of[lead]] = np.where(np.isnan(gy[whole[lead]]), -np.inf, gy[whole[lead]])

    # Columns, with their cells from top to bottom.
    kx, ky, kw, kh = (v[k] for v in sides)
    column, own = np.unique(codes(col)[k], return_inverse=True)
    order = np.lexsort((*(np.where(np.isnan(v), -np.inf, v) for v in (kx, ky)), own))
    n_cells = np.bincount(own, minlength=len(column))
    start = np.cumsum(n_cells) - n_cells
    cells = np.column_stack([kx, ky, kx + kw, ky + kh])[order]
    x0 = np.fmin.reduceat(cells[:, 0], start) if len(column) else np.zeros(0)
    x1 = np.fmax.reduceat(cells[:, 2], start) if len(column) else np.zeros(0)
    on, n_glyphs, state = column_counts(line, at, n, x0, x1, n_cells, slack)
    boxes, start, size = repaired_cells(cells, start, n_cells, n_glyphs, x1 - x0, state)

    # Glyphs in the order of their column.
    place = on[of]
    held = np.flatnonzero(place >= 0)
    held = held[size[place[held]] > 0]
    held = held[np.lexsort((ci[whole[held]], line[of[held]], first[of[held]], place[held]))]
    place, glyph = place[held], whole[held]
    new = np.concatenate([[True], place[1:] != place[:-1]])[:len(place)]
    rank = np.arange(len(place)) - np.flatnonzero(new)[np.cumsum(new) - 1] if len(place) else place
    fits = (rank < size[place]) & has_ci[glyph]
    glyph, spot, how = glyph[fits], start[place[fits]] + rank[fits], state[place[fits]]

    # A glyph takes each box that was given to its place in the text; places may come twice.
    both = np.unique(dense(li, ci), return_inverse=True)[1] if len(g) else li
    given = np.argsort(both[glyph], kind="stable")
    n_given = np.bincount(both[glyph], minlength=len(g))
    before = np.cumsum(n_given) - n_given
    mine = np.where(has_li & has_ci, n_given[both], 0)
    row = np.repeat(np.arange(len(g)), np.maximum(mine, 1))
    step = np.arange(len(row)) - np.repeat(np.cumsum(np.maximum(mine, 1)) - np.maximum(mine, 1), np.maximum(mine, 1))
    put = mine[row] > 0
    at = given[before[both[row[put]]] + step[put]]
    taken = boxes[spot[at]]
    out = {}
    for i, c in enumerate("xywh"):
        side, known = (gx, gy, gw, gh)[i][row], valid((x, y, w, h)[i])[g[row]]
        new = taken[:, i] if i < 2 else taken[:, i] - taken[:, i - 2]
        side[put] = np.where(np.isnan(new), side[put], new)
        known[put] |= ~np.isnan(new)
        out[c] = doubles(side, known)
    anchored = np.full(len(row), "kept", object)
    anchored[put] = how[at]
    rows = pa.array(row)
    return {name: values(c.take(rows)) for name, c in zip(names, more)} | out | {"anchored": anchored}
