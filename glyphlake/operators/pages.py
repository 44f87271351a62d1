"""Joins and reports over pages of lines, glyphs, cells and windows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphlake.operators.geometry import drop_covered
from glyphlake.chains import chain
from glyphlake.functions.places import codes, dense, has_page, near, numbers, told_by_page, valid, values
from glyphlake.ordered import Ordered
from glyphlake.spatial import SCREEN_CELL, cell_join, overlap_join

Names = Sequence[str]


def upper_median(value: str) -> Column:
    """The upper of the two middle values."""
    return -F.expr(f"percentile_disc(0.5) within group (order by -{value})")


def _edges(boxes: DataFrame, prefix: str, keep: Names) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    return boxes.select(*keep, x.alias(f"{prefix}x0"), (x + F.col("w")).alias(f"{prefix}x1"),
                        y.alias(f"{prefix}y0"), (y + F.col("h")).alias(f"{prefix}y1"))


def _hidden_parts(rects: DataFrame, on: Names, rect_id: str, z: str) -> DataFrame:
    """(on, rect_id, by, x, y, w, h): what each window in front hides of a window, local to it."""
    mine = _edges(rects, "a", [*on, rect_id, F.col(z).alias("_az")])
    front = _edges(rects.where((F.col("layer") == 0) & (F.coalesce("alpha", F.lit(1.0)) > 0.05)), "b",
                   [*on, F.col(rect_id).alias("by"), F.col(z).alias("_bz")])
    met = overlap_join(mine, front, on, [("ax0", "ax1", "bx0", "bx1"), ("ay0", "ay1", "by0", "by1")], SCREEN_CELL).where("_bz < _az")
    low, high = ({v: one(f"a{v}{i}", f"b{v}{i}") for v in "xy"} for one, i in ((F.greatest, 0), (F.least, 1)))
    return met.where((high["x"] - low["x"] > 1) & (high["y"] - low["y"] > 1)).select(
        *on, rect_id, "by", *[(low[v] - F.col(f"a{v}0")).alias(v) for v in "xy"],
        *[(high[v] - low[v]).alias(s) for v, s in (("x", "w"), ("y", "h"))])


def occluders(rects: DataFrame, on: Names, rect_id: str, z: str) -> DataFrame:
    """(on, rect_id, by, x, y, w, h): windows in front of each window that hide more than one unit of it each way.

    Only visible windows of the ordinary layer hide. The common part is local to the window, in whole units.
    """
    whole = {c: (F.floor if c in "xy" else F.ceil)(c).cast("int") for c in "xywh"}
    return _hidden_parts(rects, on, rect_id, z).withColumns(whole)


def visible_fraction(rects: DataFrame, on: Names, rect_id: str, z: str, displays: Sequence[tuple[float, float, float, float]],
                     steps: int = 20) -> DataFrame:
    """(on, rect_id, visible): share of ``steps`` x ``steps`` sample points on a display (x, y, w, h) and not behind a window.

    A hiding window covers some columns and some rows of sample points. They are bits, and the points are words of
    bits, a few columns a word, so a pair of windows stays one row and a window's hidden points are one fixed row.
    """
    per = 63 // steps  # columns of points in a word
    if not per:
        raise ValueError("more than 63 sample points a side")

    def at(low, side, i):
        return low + (F.lit(i) + F.lit(0.5)) * side / F.lit(float(steps))

    def bits(test):
        """The numbers i for which ``test(i)`` holds."""
        return reduce(lambda a, b: a.bitwiseOR(b), [F.when(test(i), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint") for i in range(steps)])

    def words(columns, rows):
        def column(i, slot):
            return F.when(F.shiftright(columns, i).bitwiseAND(F.lit(1)) == 1, F.shiftleft(rows, steps * slot)).otherwise(F.lit(0).cast("bigint"))

        return [reduce(lambda a, b: a.bitwiseOR(b), [column(i, i - first) for i in range(first, min(first + per, steps))])
                for first in range(0, steps, per)]

    def count(masks):
        return reduce(lambda a, b: a + b, [F.bit_count(m) for m in masks])

    x, y, w, h = (F.col(c) for c in "xywh")
    own = rects.select(*on, rect_id, "x", "y", "w", "h").withColumns({
        f"_{v}{d}": bits(lambda i: (at(low, side, i) >= display[k]) & (at(low, side, i) < display[k] + display[k + 2]))
        for d, display in enumerate(displays) for k, (v, low, side) in enumerate((("x", x, w), ("y", y, h)))})
    seen = [words(F.col(f"_x{d}"), F.col(f"_y{d}")) for d in range(len(displays))]
    n_words = -(-steps // per)
    shown = {f"_s{k}": reduce(lambda a, b: a.bitwiseOR(b), [s[k] for s in seen], F.lit(0).cast("bigint")) for k in range(n_words)}
    own = own.select(*on, rect_id, "w", "h", *[c.alias(n) for n, c in shown.items()])
    hidden = _hidden_parts(rects, on, rect_id, z).select(*on, rect_id, *[F.col(c).alias(f"_{c}") for c in "xywh"])
    # Hidden parts are local to the window, so are the sample points here.
    hidden = hidden.join(own.select(*on, rect_id, "w", "h"), [*on, rect_id]).withColumns({out: bits(
        lambda i: (at(F.lit(0.0), F.col(side), i) >= F.col(f"_{v}")) & (at(F.lit(0.0), F.col(side), i) < F.col(f"_{v}") + F.col(f"_{side}")))
        for v, side, out in (("x", "w", "_i"), ("y", "h", "_j"))})
    covered = hidden.select(*on, rect_id, *[m.alias(f"_h{k}") for k, m in enumerate(words(F.col("_i"), F.col("_j")))]).groupBy(
        *on, rect_id).agg(*[F.bit_or(f"_h{k}").alias(f"_h{k}") for k in range(n_words)])
    free = [F.col(f"_s{k}").bitwiseAND(F.bitwise_not(F.coalesce(f"_h{k}", F.lit(0).cast("bigint")))) for k in range(n_words)]
    return own.join(covered, [*on, rect_id], "left").select(*on, rect_id, (count(free) / float(steps * steps)).alias("visible"))


def mark_ruby(lines: DataFrame, page: Names, kana: str, least: float = 0.8) -> DataFrame:
    """(page, li, base): small lines that set the reading of the line below them, with the first such line.

    ``lines`` has (page, li, x0, x1, y0, y1, h, ``kana``: share of kana).
    """
    tall = lines.where("h > 0").groupBy(*page).agg(F.max("h").alias("_max"), F.min("h").alias("_min"))
    small = lines.join(tall.where("_min < _max * 0.65").select(*page), list(page), "left_semi").where(
        (F.col("h") > 0) & (F.col(kana) >= least)).select(
        *page, "li", *[F.col(c).alias(f"s_{c}") for c in ("x0", "x1", "y1", "h")],
        (F.col("y1") - F.col("h") * 0.5).alias("_lo"), (F.col("y1") + F.col("h") * 1.2).alias("_hi"))
    bases = lines.where("h > 0").select(*page, F.col("li").alias("base"), *[F.col(c).alias(f"b_{c}") for c in ("x0", "x1", "y0", "h")])
    met = cell_join(bases, small, page, [("b_y0", "_lo", "_hi")]).where(
        "li <> base and b_y0 > _lo and b_y0 < _hi and s_h >= b_h * 0.35 and s_h <= b_h * 0.65 "
        "and (least(s_x1, b_x1) - greatest(s_x0, b_x0)) / greatest(1, s_x1 - s_x0) >= 0.4")
    return met.groupBy(*page, "li").agg(F.min("base").alias("base"))


def attach_hints(bands: DataFrame, lines: DataFrame, page: Names) -> DataFrame:
    """(page, li, hint): texts of the bands right above each line, in band order.

    ``bands`` has (page, band, y0, y1, text), ``lines`` (page, li, top).
    """
    reach = bands.withColumns({"_h": F.col("y1") - F.col("y0")}).withColumns(
        {"_lo": F.col("y1") - F.col("_h"), "_hi": F.col("y1") + F.col("_h") * 2.5})
    met = cell_join(lines, reach, page, [("top", "_lo", "_hi")]).where("top > _lo and top < _hi")
    nearest = met.groupBy(*page, "band", "text").agg(F.min_by("li", F.struct(F.col("top") - F.col("y1"), "li")).alias("li"))
    return nearest.groupBy(*page, "li").agg(F.expr("listagg(text, '') within group (order by band)").alias("hint"))


def merge_remainder(primary: DataFrame, secondary: DataFrame, on: Names, box_id: str, share: float = 0.3) -> DataFrame:
    """All primary boxes, and the tall secondary ones of which no primary box covers more than ``share``."""
    tall = secondary.where("h > w")
    mine, other = _edges(tall, "a", [*on, box_id]), _edges(primary, "b", on)
    both = "(least(ax1, bx1) - greatest(ax0, bx0)) * (least(ay1, by1) - greatest(ay0, by0))"
    met = overlap_join(mine, other, on, [("ax0", "ax1", "bx0", "bx1"), ("ay0", "ay1", "by0", "by1")]).where(
        f"{both} > {share} * (ax1 - ax0) * (ay1 - ay0)").select(*on, box_id).distinct()
    return primary.unionByName(tall.join(met, [*on, box_id], "left_anti"))


def unexplained_cells(cells: DataFrame, lines: DataFrame, on: Names, point_id: str, cell: int, floor: int = 24) -> DataFrame:
    """(on, n, flagged): marks outside every line box grown by one cell; groups without any have no row."""
    grown = lines.select(*on, *[(F.col(c) - cell).alias(c) for c in "xy"], *[(F.col(c) + 2 * cell).alias(c) for c in "wh"])
    return drop_covered(cells, grown, list(on), point_id, SCREEN_CELL).groupBy(*on).agg(
        F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) >= floor).alias("flagged"))


def assign_columns(lines: DataFrame, columns: DataFrame, on: Names, line_id: str, at: str, place: str, slack: int = 2) -> DataFrame:
    """(on, line_id, place): the first column whose span, a little widened, holds the line's ``at``."""
    wide = columns.select(*on, place, (F.col("x0") - slack).alias("_lo"), (F.col("x1") + slack).alias("_hi"))
    return cell_join(lines, wide, on, [(at, "_lo", "_hi")]).groupBy(*on, line_id).agg(F.min(place).alias(place))


def map_strip(glyphs: DataFrame, cells: DataFrame, page: Names, rows: str, row_height: float, pad: float, pitch: float) -> DataFrame:
    """Glyphs of a strip with their source cell: row by middle height, cell by middle position.

    ``glyphs`` has (page, x, y, w, h, ``rows``: rows of its strip), ``cells`` (page, row, cell, ..). Others are left out.
    """
    middle = F.floor((F.col("y") + F.col("h") / 2) / row_height)
    row = F.least(F.greatest(middle, F.lit(0)), F.col(rows) - 1).cast("int")
    cell = F.floor((F.col("x") + F.col("w") / 2 - pad) / pitch + 0.5).cast("int")
    return glyphs.withColumns({"row": row, "cell": cell}).join(cells, [*page, "row", "cell"])


def match_glyphs(truth: DataFrame, got: DataFrame, page: Names, label: str, glyph_id: Names) -> DataFrame:
    """(page, glyph_id, matched, placed): is the label read anywhere on the page, and is its nearest reading in place.

    A reading in place is at most two tolerances away in sum, so the nearest is sought in that
    square alone; labels that fill a page are never paired all with all.
    """
    sides = [F.col(c).cast("double").alias(f"_{c}") for c in "xywh"]
    asked = truth.select(*page, *glyph_id, F.lit(True).alias("_asked"), F.col(label).alias("_label"), *sides)
    kinds = {c: asked.schema[c].dataType.simpleString() for c in glyph_id}
    none = [F.lit(None).cast("double").alias(f"_{c}") for c in "wh"]
    read = got.where(has_page(page)).select(*page, *[F.lit(None).cast(k).alias(c) for c, k in kinds.items()], F.lit(False).alias("_asked"),
                                            F.col(label).alias("_label"), *sides[:2], *none)
    found = told_by_page(asked.unionByName(read), page, _matches, ["_asked", "_label", "_x", "_y", "_w", "_h", *glyph_id], {
        **kinds, "matched": "boolean", "placed": "boolean"}, list(glyph_id))
    return found.select(*page, *glyph_id, "matched", "placed")


def _matches(names: Sequence[str], asked: pa.Array, label: pa.Array, *columns: pa.Array) -> dict:
    """``match_glyphs`` of one page: the rows that are asked for, and those read."""
    asked, char = asked.to_numpy(zero_copy_only=False), codes(label)
    x, y, w, h = (numbers(c) for c in columns[:4])
    truth, got = np.flatnonzero(asked), np.flatnonzero(~asked & (char >= 0))
    ids = [c.take(pa.array(truth)) for c in columns[4:]]
    tol = np.fmax(12.0, np.fmax(w[truth] * 0.7, h[truth] * 0.7))
    tx, ty, own = x[truth], y[truth], char[truth]
    glyph = np.unique(dense(*(codes(c) for c in ids)), return_inverse=True)[1] if ids else np.zeros(len(truth), np.int64)
    nearest, in_place = (np.full(int(glyph.max()) + 1 if len(glyph) else 0, np.inf) for _ in range(2))
    for of, hit in near(char[got], x[got], y[got], own, tx - 2 * tol, tx + 2 * tol, ty - 2 * tol, ty + 2 * tol, 32.0):
        dx, dy = np.abs(x[got[hit]] - tx[of]), np.abs(y[got[hit]] - ty[of])
        np.minimum.at(nearest, glyph[of], dx + dy)
        ok = (dx <= tol[of]) & (dy <= tol[of])
        np.minimum.at(in_place, glyph[of[ok]], (dx + dy)[ok])
    # Of equally near readings one in place counts, since the order of readings is not kept.
    placed = (np.isfinite(nearest) & (in_place == nearest))[glyph]
    for c in ids:
        placed &= valid(c)
    return {n: values(c) for n, c in zip(names, ids)} | {"matched": np.isin(own, char[got]), "placed": placed}


def placement_report(matches: DataFrame, page: Names, least: int = 8, rate: float = 0.7) -> DataFrame:
    """(page, n, coverage, placement, ok): shares of glyphs read and in place."""
    report = matches.groupBy(*page).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("matched").cast("double")).alias("coverage"),
        F.avg(F.col("placed").cast("double")).alias("placement"), F.count_if("matched").alias("_m"), F.count_if("placed").alias("_p"))
    return report.withColumn("ok", (F.col("_m") >= least) & (F.col("_p") >= F.col("_m") * rate)).drop("_m", "_p")


def cells_containing(truth: DataFrame, cells: DataFrame, on: Names, point_id: str) -> DataFrame:
    """(on, point_id, n, error): number of cells around each point, and its distance from the centre of a single one."""
    edges = cells.withColumns({"_x1": F.col("x") + F.col("w"), "_y1": F.col("y") + F.col("h")})
    met = cell_join(truth, edges, on, [("px", "x", "_x1"), ("py", "y", "_y1")])
    away = F.greatest(F.abs(F.col("x") + F.col("w") / 2 - F.col("px")), F.abs(F.col("y") + F.col("h") / 2 - F.col("py")))
    found = met.groupBy(*on, point_id).agg(F.count(F.lit(1)).alias("n"), F.max(away).alias("error"))
    rows = truth.select(*on, point_id).join(found, [*on, point_id], "left")
    return rows.select(*on, point_id, F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") == 1, F.col("error")).alias("error"))


def cell_metrics(truth: DataFrame, cells: DataFrame, on: Names, point_id: str) -> DataFrame:
    """(on, recall, dup, error, ratio): points in one cell and in several, median distance (-1: none), cells per point."""
    met = cells_containing(truth, cells, on, point_id).groupBy(*on).agg(
        F.avg((F.col("n") == 1).cast("double")).alias("recall"), F.avg((F.col("n") > 1).cast("double")).alias("dup"),
        F.coalesce(F.expr("percentile(error, 0.5)"), F.lit(-1.0)).alias("error"), F.count(F.lit(1)).alias("_n"))
    sizes = cells.groupBy(*on).agg(F.count(F.lit(1)).alias("_cells"))
    return met.join(sizes, list(on), "left").select(
        *on, "recall", "dup", "error", (F.coalesce("_cells", F.lit(0)) / F.col("_n")).alias("ratio"))


def word_boxes(groups: DataFrame, glyphs: DataFrame, line: Names, group_id: str, start: str, length: str, pad: int = 2) -> DataFrame:
    """(group_id, x0, y0, x1, y1, conf): the box around a match's glyphs; a glyph without confidence counts as sure.

    A match is as long as a dictionary key at most, so its positions are spelled out and met by equality.
    """
    places = groups.select(*line, group_id, F.explode(F.sequence(F.col(start), F.col(start) + F.col(length) - 1)).alias("ci"))
    return places.join(glyphs, [*line, "ci"]).groupBy(group_id).agg(
        (F.min("x") - pad).alias("x0"), (F.min("y") - pad).alias("y0"), (F.max(F.col("x") + F.col("w")) + pad).alias("x1"),
        (F.max(F.col("y") + F.col("h")) + pad).alias("y1"), F.min(F.coalesce("conf", F.lit(1.0))).alias("conf"))


def page_evidence(lines: DataFrame, page: Names) -> DataFrame:
    """(page, n_across, n_down, rejected, native_down, mostly_down): what a page's lines say of its direction.

    ``lines`` has (page, n, w, h, down, cjk).
    """
    n, long = F.count(F.lit(1)), (F.col("n") >= 2) & F.col("cjk")
    across, down = (F.coalesce(F.sum(F.when(t, F.col("n"))), F.lit(0)) for t in (~F.col("down"), F.col("down")))
    return lines.groupBy(*page).agg(
        across.alias("n_across"), down.alias("n_down"),
        ((n >= 8) & (F.count_if((F.col("n") == 1) & F.col("cjk")) > n * 0.7)).alias("rejected"),
        ((F.count_if(long) >= 2) & (F.count_if(long & (F.col("h") > F.col("w") * 2)) * 2 >= F.count_if(long))).alias("native_down"),
        (down > across * 2).alias("mostly_down"))


def picket_fence(glyphs: DataFrame, page: Names, line: str) -> DataFrame:
    """(page, n, n_fence, fence): pages most of whose lines set single glyphs far apart."""
    keys = [*page, line]
    # The glyphs of a line are bounded by the line.
    rows = Ordered(glyphs, keys, ["ci"], bounded=True).scan(lead={"_next": "x"}).df.withColumn("_gap", F.col("_next") - F.col("x") - F.col("w"))
    lines = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), upper_median("h").alias("_em"), upper_median("_gap").alias("_gap"))
    fence = F.count_if((F.col("_em") > 0) & (F.col("_gap") > F.col("_em") * 0.6))
    n = F.count(F.lit(1))
    return lines.where("_n >= 3").groupBy(*page).agg(
        n.alias("n"), fence.alias("n_fence"), ((fence >= 3) & (fence * 5 > n * 3)).alias("fence"))


def profile(cells: DataFrame, keys: Names, pos: str) -> DataFrame:
    """(keys, pos, n): marks at every position between the first and last of the key, zeros included."""
    counts = cells.groupBy(*keys, pos).agg(F.count(F.lit(1)).alias("n"))
    spine = counts.groupBy(*keys).agg(F.min(pos).alias("_lo"), F.max(pos).alias("_hi")).select(
        *keys, F.explode(F.sequence("_lo", "_hi")).alias(pos))
    return spine.join(counts, [*keys, pos], "left").fillna(0, ["n"])


def standout(cells: DataFrame, tile: Names, value: str, delta: float = 60, more_than: int = 4) -> DataFrame:
    """Cells that differ from their tile's median by more than ``delta``; tiles of few cells have none."""
    ground = cells.where(F.col(value).isNotNull()).groupBy(*tile).agg(upper_median(value).alias("_bg"), F.count(F.lit(1)).alias("_n"))
    return cells.join(ground.where(F.col("_n") > more_than), list(tile)).where(F.abs(F.col(value) - F.col("_bg")) > delta).drop("_bg", "_n")


def ruby_bands(bands: DataFrame, keys: Names) -> DataFrame:
    """(keys, start, end): bands set closely above a band about twice as high, widened for erasing."""
    rows = Ordered(bands, keys, ["start"]).scan(lead={"_s": "start", "_e": "end"}).df
    h0, h1 = F.col("end") - F.col("start") + 1, F.col("_e") - F.col("_s") + 1
    ok = (h0 >= 6) & (h0 >= h1 * 0.30) & (h0 <= h1 * 0.65) & (F.col("_s") - F.col("end") < h1 * 0.8)
    return rows.where(ok).select(*keys, (F.col("start") - 4).alias("start"), (F.col("_s") - 2).alias("end"))


def group_bands(bands: DataFrame, keys: Names, order: str, text: str, kana: Column, least: float = 0.7) -> DataFrame:
    """(keys, grp, n, text, keep): bands that share rows with the first of their group, and whether their text reads as ruby.

    From the top, a band opens a group unless it shares rows with the band that opened the last one; that it
    shares rows with other members does not count. ``kana`` is the share of kana in the column ``text``.
    """
    rows = Ordered(bands, keys, ["y", order]).scan(number="_n").df
    # The next group opens at the first band that begins at or below the bottom: behind as many as begin above it.
    tops = rows.select(*keys, F.col("y").alias("_at"), F.lit(1).alias("_one"), "_n")
    ends = rows.select(*keys, (F.col("y") + F.col("h")).alias("_at"), F.lit(0).alias("_one"), "_n")
    above = Ordered(tops.unionByName(ends), keys, ["_at", "_one", "_n"]).scan(run={"_above": ("sum", "_one")}).df.where("_one = 0")
    pointers = above.select(*keys, "_n", (F.greatest("_above", "_n") + 1).alias("_next"))
    opened = chain(pointers, keys, "_n", "_next").withColumn("_new", F.lit(1))
    marked = rows.join(opened, [*keys, "_n"], "left").fillna(0, ["_new"])
    found = Ordered(marked, keys, ["_n"]).scan(run={"grp": ("sum", "_new")}).df.groupBy(*keys, "grp").agg(
        F.count(F.lit(1)).alias("n"), F.expr(f"listagg({text}, '') within group (order by {order})").alias(text))
    return found.withColumn("keep", (F.coalesce(F.length(text), F.lit(0)) == 0) | (kana >= least))


def attach_labels(lines: DataFrame, keys: Names, order: str, line: str, label: Column, quote: Column, bounded: bool = False) -> DataFrame:
    """(keys, sense, text): a label goes before the next line, a quotation behind the line before it.

    ``bounded``: the lines of a key are those of one text and fit one task.
    """
    marked = lines.withColumns({"_label": label, "_quote": quote}).withColumn("_real", (~F.col("_label")).cast("int"))
    kept = (F.col("_real") == 1) & (~F.col("_quote") | (F.col("_n") == 1))
    rows = (Ordered(marked, keys, [order], bounded=bounded).scan(run={"_n": ("sum", "_real")}).with_columns({
        "_kept": kept.cast("int"),
        "_m": F.when(F.col("_label"), F.struct(F.col(line).alias("v"))).when(kept, F.struct(F.lit(None).cast("string").alias("v")))})
        .scan(run={"_last": ("last", "_m"), "sense": ("sum", "_kept")}).scan(lag={"_mark": "_last"}).df)
    text = F.concat_ws(" ", F.when(F.col("_kept") == 1, F.col("_mark.v")), line)
    return rows.where("_real = 1").withColumn("_t", text).groupBy(*keys, "sense").agg(
        F.expr(f"listagg(_t, ' ') within group (order by {order})").alias("text"))


def layout_shift(lines: DataFrame, keys: Names, page: str, limit: float = 3) -> DataFrame:
    """(keys, page, shift, moved): the farthest that the first glyph of an equal line moved since the page before.

    ``lines`` has (keys, page, li, text, x, y, frame); pages are numbered without gaps. A changed frame is a move.
    """
    frames = lines.groupBy(*keys, page).agg(F.max("frame").alias("frame"))
    before = lines.groupBy(*keys, page, "text").agg(F.max_by(F.struct("x", "y"), "li").alias("_p")).withColumn(page, F.col(page) + 1)
    met = lines.join(before, [*keys, page, "text"]).groupBy(*keys, page).agg(F.max(F.greatest(
        F.abs(F.col("x") - F.col("_p.x")), F.abs(F.col("y") - F.col("_p.y")))).alias("shift"))
    was = frames.select(*keys, (F.col(page) + 1).alias(page), F.col("frame").alias("_was"))
    rows = frames.join(was, [*keys, page]).join(met, [*keys, page], "left").fillna(0, ["shift"])
    return rows.select(*keys, page, "shift", ((F.col("shift") > limit) | ~F.col("frame").eqNullSafe(F.col("_was"))).alias("moved"))


def reading_order(lines: DataFrame, page: Names, main: str, cross: str, tie: str, tolerance: float) -> DataFrame:
    """Lines numbered along ``main``; those less than ``tolerance`` after the one before share a band and go along ``cross``."""
    rows = (Ordered(lines, page, [main, tie]).scan(lag={"_was": main})
            .with_columns({"_new": F.coalesce((F.col(main) - F.col("_was") > tolerance).cast("int"), F.lit(1))})
            .scan(run={"_band": ("sum", "_new")}).df)
    return Ordered(rows, page, ["_band", cross, tie]).scan(number="line_order").df.drop("_was", "_new", "_band")


def admit_passes(passes: DataFrame, keys: Names, order: Names, n: str, votes: int, every: int) -> DataFrame:
    """The first pass of a page, and every ``every``-th later one that read at least half as many glyphs; ``votes`` in all."""
    base = passes.groupBy(*keys).agg(F.min_by(n, F.struct(*order)).alias("_base"))
    rows = Ordered(passes, keys, order).scan(number="_i").df.join(base, list(keys))
    ok = rows.where((F.col("_i") == 1) | (((F.col("_i") - 1) % every == 0) & (F.col(n) * 2 >= F.col("_base"))))
    return Ordered(ok, keys, order).scan(number="vote").df.where(F.col("vote") <= votes).drop("_i", "_base")
