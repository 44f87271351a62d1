"""Boxes, lines and pages of glyphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphlake.ordered import Ordered
from glyphlake.spatial import BASE_CELL, cell_join


def hit_test(points: DataFrame, boxes: DataFrame, on: list[str], point_id: str, box_id: str) -> DataFrame:
    """(on, point_id, box_id): the box around each point whose centre is nearest; ties to the lower id."""
    edges = boxes.withColumns({"_x1": F.col("x") + F.col("w"), "_y1": F.col("y") + F.col("h")})
    met = cell_join(points, edges, on, [("px", "x", "_x1"), ("py", "y", "_y1")])
    away = F.pow(F.col("px") * 2 - F.col("x") * 2 - F.col("w"), 2) + F.pow(F.col("py") * 2 - F.col("y") * 2 - F.col("h"), 2)
    return met.groupBy(*on, point_id).agg(F.min_by(box_id, F.struct(away.alias("a"), F.col(box_id))).alias(box_id))


def drop_covered(points: DataFrame, covers: DataFrame, on: list[str], point_id: str, base: float = BASE_CELL) -> DataFrame:
    """Points inside no cover, edges included. ``base``: about the side of the usual cover."""
    edges = covers.withColumns({"_x1": F.col("x") + F.col("w"), "_y1": F.col("y") + F.col("h")})
    met = cell_join(points.select(*on, point_id, "px", "py"), edges.select(*on, "x", "y", "_x1", "_y1"), on,
                    [("px", "x", "_x1"), ("py", "y", "_y1")], base)
    return points.join(met.select(*on, point_id).distinct(), [*on, point_id], "left_anti")


def line_geometry(glyphs: DataFrame, keys: list[str]) -> DataFrame:
    """Bounding box, mean x and upper median height of each line."""
    height = F.expr("percentile_disc(0.5) within group (order by -h)")
    return glyphs.groupBy(*keys).agg(
        F.min("x").alias("x0"), F.max(F.col("x") + F.col("w")).alias("x1"), F.min("y").alias("y0"),
        F.max(F.col("y") + F.col("h")).alias("y1"), F.avg("x").alias("mean_x"), (-height).cast("int").alias("median_h"))


def line_orientation(glyphs: DataFrame, keys: list[str]) -> DataFrame:
    """``columnar``: glyph centres spread more down than across; null for a single glyph, which takes its page's."""
    cx, cy = F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2
    spread = (F.max(cy) - F.min(cy)) > (F.max(cx) - F.min(cx))
    return glyphs.groupBy(*keys).agg(F.when(F.count(F.lit(1)) >= 2, spread).alias("columnar"))


def columns_rtl(lines: DataFrame, page: list[str], x: str, tie: str) -> DataFrame:
    """Lines of a page from right to left."""
    return Ordered(lines.withColumn("_x", -F.col(x)), page, ["_x", tie]).scan(number="line_order").df.drop("_x")


def reading_order_check(lines: DataFrame, page: list[str], order: str) -> DataFrame:
    """(page, moves_left, goes_down): share of steps to a line further left, and of lines that end below their start."""
    rows = Ordered(lines, page, [order]).scan(lead={"_next": "x0"}).df
    return rows.groupBy(*page).agg(
        F.avg(F.when(F.col("_next").isNotNull(), (F.col("_next") < F.col("x0")).cast("double"))).alias("moves_left"),
        F.avg((F.col("y1") > F.col("y0")).cast("double")).alias("goes_down"))
