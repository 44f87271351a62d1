"""Preferences, catalogues and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphlake.ordered import Ordered


def catalogue_status(catalogue: DataFrame, installed: DataFrame, label: str) -> DataFrame:
    """The catalogue with ``installed``: is there an installed row of that label."""
    have = installed.select(label).distinct().withColumn("installed", F.lit(True))
    return catalogue.join(have, label, "left").fillna(False, ["installed"])


def merge_prefs(saved: DataFrame, manifest: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, name, enabled, place): saved choices that the manifest lists, then its other names, enabled.

    ``saved`` has (keys, name, enabled, ord), ``manifest`` (keys, name, ord). A key without a manifest keeps
    what it saved. One key's names are a list that a person sorts by hand.
    """
    both = saved.select(*keys, "name", "enabled", F.col("ord").alias("_ord"), F.lit(True).alias("_saved")).join(
        manifest.select(*keys, "name", F.col("ord").alias("_new"), F.lit(True).alias("_listed")), [*keys, "name"], "full")
    bound = manifest.select(*keys).distinct().withColumn("_bound", F.lit(True))
    rows = both.join(bound, keys, "left").where("_listed or _bound is null").withColumns({
        "enabled": F.coalesce("enabled", F.lit(True)), "_late": F.col("_saved").isNull(), "_at": F.coalesce("_ord", "_new")})
    found = Ordered(rows, keys, ["_late", "_at", "name"], bounded=True).scan(number="place").df
    return found.select(*keys, "name", "enabled", "place")


def swap_priority(prefs: DataFrame, moves: DataFrame, keys: list[str]) -> DataFrame:
    """``prefs`` (keys, name, ord, shown) after each key's move (keys, name, delta) past the next shown name.

    Hidden names keep their places; a move past an end does nothing. One move a key.
    """
    shown = Ordered(prefs.where("shown"), keys, ["ord"], bounded=True).scan(number="_n").df.select(*keys, "name", "ord", "_n")
    mover = shown.join(moves.select(*keys, "name", "delta"), [*keys, "name"]).select(
        *keys, F.col("name").alias("_a"), F.col("ord").alias("_ao"), (F.col("_n") + F.col("delta")).alias("_n"))
    pair = shown.join(mover, [*keys, "_n"]).select(*keys, "_a", "_ao", F.col("name").alias("_b"), F.col("ord").alias("_bo"))
    rows = prefs.join(pair, keys, "left")
    new = F.when(F.col("name") == F.col("_a"), F.col("_bo")).when(F.col("name") == F.col("_b"), F.col("_ao")).otherwise(F.col("ord"))
    return rows.withColumn("ord", new).drop("_a", "_ao", "_b", "_bo")


def assert_min(totals: DataFrame, **floors: int) -> DataFrame:
    """``totals`` as it is; running it fails where a column is below its floor or null."""
    for name, floor in floors.items():
        low = ~F.coalesce(F.col(name) >= floor, F.lit(False))
        totals = totals.withColumn(name, F.when(low, F.raise_error(F.lit(f"{name} is below {floor}"))).otherwise(F.col(name)))
    return totals
