"""Row filters and validations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphlake.functions.text import strip
from glyphlake.ordered import Ordered


def in_range_or(value: Column, low, high, current) -> Column:
    """``value`` if it lies in the range, else the current setting."""
    return F.when(value.between(low, high), value).otherwise(F.lit(current))


def valid_request(text: Column, longest: int = 512) -> Column:
    return F.coalesce(F.length(text) <= longest, F.lit(False))


def validate_requests(requests: DataFrame, text: str, channel: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Valid requests, and per channel the first rejected one with the number of its rejects."""
    ok = requests.where(valid_request(F.col(text)))
    rest = [F.col(c) for c in requests.columns if c != channel]
    rejects = requests.where(~valid_request(F.col(text))).groupBy(channel).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("first"), F.count(F.lit(1)).alias("n_rejects"))
    return ok, rejects


def valid_region(x: Column, y: Column, w: Column, h: Column, limit: float = 4000) -> Column:
    def finite(c):
        c = c.cast("double")
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))

    return finite(x) & finite(y) & finite(w) & finite(h) & (w > 0) & (w < limit) & (h > 0) & (h < limit)


def has_script(text: Column, cls: str, n: int = 10) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[{cls}]")) >= n, F.lit(False))


def every_nth(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The first row of each key and every ``n``-th after it."""
    numbered = Ordered(df, keys, order).scan(number="_n").df
    return numbered.where((F.col("_n") - 1) % n == 0).drop("_n")


def drop_blank_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    return lines.withColumn(line, strip(line)).where(F.col(line) != "")


def latest_asset(listing: DataFrame, rules: DataFrame, repo: str, name: str) -> DataFrame:
    """(repo, asset, error): per rule the greatest name that matches its ``pattern``. Rules are few and broadcast by size."""
    met = listing.select(F.col(repo).alias("repo"), F.col(name).alias("_name")).join(rules, "repo").where(
        F.expr("_name rlike pattern"))
    best = met.groupBy("repo").agg(F.max("_name").alias("asset"))
    return rules.select("repo").join(best, "repo", "left").withColumn(
        "error", F.when(F.col("asset").isNull(), F.lit("no matching asset")))
