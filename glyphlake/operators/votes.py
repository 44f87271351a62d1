"""Several reads of one page brought to one text, glyph by glyph and by place."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphlake.functions.places import codes, dense, has_page, near, numbers, told_by_page, valid, values

CELL = 32.0
#: A reading counts for a glyph within so many units, or half the glyph if that is more.
REACH = 6.0


def vote(passes: DataFrame, page: Sequence[str], order: str = "pass", grown: bool = False) -> DataFrame:
    """(page, li, ci, ch, votes, passes, conf) for each glyph of the page's first pass.

    From every pass, the first included, the glyph counts whose centre is nearest to the base glyph's (by the longer
    of both axes), nearer than ``max(REACH, half the base glyph)`` and in the nine cells around it; never the glyph of
    equal index. The character that most passes read replaces the base's if it has strictly more votes; of several,
    the smallest. Glyphs that only later passes have are left out.

    ``passes`` has (page, ``order``, li, ci, ch, x, y, w, h). Of equally near glyphs the first by cell, line and index counts.
    ``grown``: with a column ``vote`` in front of ``li``, the vote over the first ``vote`` passes (numbered from 0) for
    each number of them up to all; a page's glyphs are met once for all of these.
    """
    kind = {c: passes.schema[c].dataType.simpleString() for c in ("li", "ci", "ch")}
    found = told_by_page(passes.where(has_page(page)), page, _votes, [order, "li", "ci", "ch", *[F.col(c).cast("double") for c in "xywh"]], {
        "vote": "int", "ch": kind["ch"], "votes": "bigint", "passes": "bigint", "li": kind["li"], "ci": kind["ci"]}, grown)
    return found.select(*page, *(["vote"] if grown else []), "li", "ci", "ch", "votes", "passes", (F.col("votes") / F.col("passes")).alias("conf"))


def _votes(grown: bool, passes: pa.Array, lines: pa.Array, places: pa.Array, chars: pa.Array, *sides: pa.Array) -> dict:
    """``vote`` of one page's passes."""
    x, y, w, h = (numbers(c) for c in sides)
    cx, cy = x + w / 2, y + h / 2
    gx, gy = np.floor(cx / CELL), np.floor(cy / CELL)
    turn, li, ci, ch = (codes(c) for c in (passes, lines, places, chars))
    known = valid(passes)
    turns = np.unique(turn[known])
    base = np.flatnonzero(known & (turn == (turns[0] if len(turns) else 0)) & np.isfinite(cx) & np.isfinite(cy))
    base = base[np.lexsort((ch[base], ci[base], li[base]))]
    # Glyphs of one place in the text and one character count together.
    new = np.ones(len(base), bool)
    new[1:] = (li[base[1:]] != li[base[:-1]]) | (ci[base[1:]] != ci[base[:-1]]) | (ch[base[1:]] != ch[base[:-1]])
    glyph, lead = np.cumsum(new) - 1, base[new]
    tol = np.fmax(REACH, np.fmax(w, h)[base] * 0.5)
    bx, by = cx[base], cy[base]
    met = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    everywhere = np.zeros(len(cx), np.int64)
    for of, hit in near(everywhere, cx, cy, everywhere[base], bx - tol, bx + tol, by - tol, by + tol, CELL / 4):
        far = np.maximum(np.abs(cx[hit] - bx[of]), np.abs(cy[hit] - by[of]))
        ok = (far < tol[of]) & (np.abs(gx[hit] - gx[base[of]]) <= 1) & (np.abs(gy[hit] - gy[base[of]]) <= 1)
        met.append((glyph[of[ok]], hit[ok], far[ok]))
    ours, theirs, away = (np.concatenate(v) for v in zip(*met))
    # The nearest reading of each pass for each glyph.
    spot = dense(ours, turn[theirs])
    if len(spot) and int(spot.max()) > 8 * len(spot):
        spot = np.unique(spot, return_inverse=True)[1]
    least = np.full(int(spot.max()) + 1 if len(spot) else 0, np.inf)
    np.minimum.at(least, spot, away)
    kept = away == least[spot]
    spot, ours, theirs = spot[kept], ours[kept], theirs[kept]
    tied = np.bincount(spot, minlength=len(least))[spot] > 1
    few = np.flatnonzero(tied)
    if len(few):
        few = few[np.lexsort((ci[theirs[few]], li[theirs[few]], gy[theirs[few]], gx[theirs[few]], spot[few]))]
        few = few[np.concatenate([[True], spot[few[1:]] != spot[few[:-1]]])]
        kept = np.concatenate([np.flatnonzero(~tied), few])
        ours, theirs = ours[kept], theirs[kept]
    n_chars, found = int(ch.max()) + 2, []
    for n in range(1, int(turns.max()) + 2 if len(turns) else 1) if grown else [None]:
        among = slice(None) if n is None else turn[theirs] < n
        kinds, counts = np.unique(ours[among] * n_chars + ch[theirs[among]] + 1, return_counts=True)
        if not len(kinds):
            continue
        of, char = kinds // n_chars, kinds % n_chars - 1
        starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        glyphs, sizes = of[starts], np.diff(np.append(starts, len(of)))
        top = np.maximum.reduceat(counts, starts)
        best = np.minimum.reduceat(np.where(counts == np.repeat(top, sizes), char, n_chars), starts)
        own = np.ones(len(lead), np.int64)
        mine = (char == ch[lead[of]]) & (char >= 0)
        own[of[mine]] = counts[mine]
        own = own[glyphs]
        held = len(turns) if n is None else int((turns < n).sum())
        found.append((glyphs, np.full(len(glyphs), n or 0), np.where(top > own, best, ch[lead[glyphs]]), np.maximum(top, own), np.full(len(glyphs), held)))
    glyphs, vote_, char, votes, held = (np.concatenate(v) for v in zip(*found)) if found else [np.zeros(0, np.int64)] * 5
    # A row that has each character.
    where = np.zeros(n_chars, np.int64)
    where[ch + 1] = np.arange(len(ch))
    at = pa.array(lead[glyphs])
    return {"vote": vote_, "ch": values(chars.take(pa.array(where[char + 1]))), "votes": votes, "passes": held,
            "li": values(lines.take(at)), "ci": values(places.take(at))}


def voted_lines(votes: DataFrame, page: Sequence[str]) -> DataFrame:
    """(page, li, text, votes, conf): lines of ``vote``, their votes, and the share of votes they could have had."""
    return votes.groupBy(*page, "li").agg(
        F.expr("listagg(ch, '') within group (order by ci)").alias("text"), F.sum("votes").alias("votes"),
        (F.sum("votes") / F.sum("passes")).alias("conf"))
