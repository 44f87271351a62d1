"""Arithmetic on boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flip_y(y: Column, h: Column, height: Column) -> Column:
    """Top edge from the top, of a box whose ``y`` counts from the bottom."""
    return height - y - h


def unrotate_ccw(x: Column, y: Column, w: Column, h: Column, width: Column) -> dict[str, Column]:
    """The box before its image, then ``width`` wide, was turned by 90 degrees to the left."""
    return {"x": width - y - h, "y": x, "w": h, "h": w}


def to_window(x: Column, y: Column, region_x: Column, region_y: Column, window_x: Column, window_y: Column) -> dict[str, Column]:
    """A position inside a region as one inside the window around it."""
    return {"x": x + region_x - window_x, "y": y + region_y - window_y}


def subdivide(tokens: DataFrame, text: str) -> DataFrame:
    """A token of n characters as n boxes of equal width (x, w); blanks have none."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    rows = tokens.withColumn("_n", F.length(text)).select(
        *[c for c in tokens.columns if c != text], "_n", F.posexplode(chars).alias("ci", "ch"))
    return rows.where(~F.col("ch").rlike("^(?U)[\\s﻿]$")).withColumns(
        {"x": F.col("x") + F.col("w") * F.col("ci") / F.col("_n"), "w": F.col("w") / F.col("_n")}).drop("_n")
