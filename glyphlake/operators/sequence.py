"""Operators along an order: edges, changes, gaps, runs, sessions, carried values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphlake.ordered import Ordered

Names = Sequence[str]


def press_edges(events: DataFrame, keys: Names, order: Names, held: Column) -> DataFrame:
    """Rows where the flag turns from off to on."""
    rows = Ordered(events.withColumn("_on", F.coalesce(held, F.lit(False))), keys, order).scan(lag={"_was": "_on"}).df
    return rows.where(F.col("_on") & ~F.coalesce("_was", F.lit(False))).drop("_on", "_was")


def changes_only(df: DataFrame, keys: Names, order: Names, value: str) -> DataFrame:
    """Rows whose value differs from the one before; the first of a key always stays."""
    rows = Ordered(df, keys, order).scan(number="_n", lag={"_was": value}).df
    return rows.where((F.col("_n") == 1) | ~F.col(value).eqNullSafe(F.col("_was"))).drop("_n", "_was")


def dwell(events: DataFrame, keys: Names, order: Names, at: str, least: int) -> DataFrame:
    """Events that are followed by nothing of their key for ``least``."""
    rows = Ordered(events, keys, order).scan(lead={"_next": at}).df
    return rows.where(F.col("_next").isNull() | (F.col("_next") - F.col(at) >= least)).drop("_next")


def silence_gaps(events: DataFrame, keys: Names, order: Names, at: str, least: int) -> DataFrame:
    """(keys, start, end, gap): stretches of at least ``least`` between two events."""
    rows = Ordered(events, keys, order).scan(lead={"_next": at}).df.where(F.col("_next") - F.col(at) >= least)
    return rows.select(*keys, F.col(at).alias("start"), F.col("_next").alias("end"), (F.col("_next") - F.col(at)).alias("gap"))


def sample_failures(events: DataFrame, keys: Names, order: Names, failed: Column, n: int = 10) -> DataFrame:
    """Of each unbroken row of failures the first and every ``n``-th; a success starts anew."""
    rows = events.withColumn("_ok", (~F.coalesce(failed, F.lit(False))).cast("int"))
    runs = Ordered(rows, keys, order).scan(run={"_run": ("sum", "_ok")}).df.where("_ok = 0")
    numbered = Ordered(runs, [*keys, "_run"], order).scan(number="nth").df
    return numbered.where((F.col("nth") == 1) | (F.col("nth") % n == 0)).drop("_ok", "_run")


def carry_section(lines: DataFrame, keys: Names, order: Names, heading: Column, section: Column) -> DataFrame:
    """``section`` of the last heading above; a heading without one clears it."""
    marked = lines.withColumn("_s", F.when(heading, F.struct(section.alias("v"))))
    rows = Ordered(marked, keys, order).scan(run={"_last": ("last", "_s")}).df
    return rows.withColumn("section", F.col("_last.v")).drop("_s", "_last")


def skip_unchanged(passes: DataFrame, keys: Names, order: Names, content: str) -> DataFrame:
    """Rows whose content differs from the row before, compared by hash."""
    rows = changes_only(passes.withColumn("_h", F.sha2(F.coalesce(F.col(content), F.lit("")), 256)), keys, order, "_h")
    return rows.drop("_h")


def runs(profile: DataFrame, keys: Names, pos: str, count: str, least: int, gap: int) -> DataFrame:
    """(keys, start, end): stretches of positions above ``least`` with fewer than ``gap`` others between them."""
    ink = profile.where(F.col(count) > least)
    rows = Ordered(ink, keys, [pos]).scan(lag={"_was": pos}).df.withColumn(
        "_new", F.coalesce((F.col(pos) - F.col("_was") > gap).cast("int"), F.lit(1)))
    numbered = Ordered(rows, keys, [pos]).scan(run={"_run": ("sum", "_new")}).df
    return numbered.groupBy(*keys, "_run").agg(F.min(pos).alias("start"), F.max(pos).alias("end")).drop("_run")


def sessions(events: DataFrame, keys: Names, order: Names, at: str, gap: int) -> DataFrame:
    """(keys, start, end, n): events of a key less than ``gap`` apart."""
    rows = Ordered(events, keys, order).scan(lag={"_was": at}).df.withColumn(
        "_new", F.coalesce((F.col(at) - F.col("_was") >= gap).cast("int"), F.lit(1)))
    numbered = Ordered(rows, keys, order).scan(run={"_run": ("sum", "_new")}).df
    return numbered.groupBy(*keys, "_run").agg(
        F.min(at).alias("start"), F.max(at).alias("end"), F.count(F.lit(1)).alias("n")).drop("_run")


def latest_only(replies: DataFrame, keys: Names, order: Names, seq: str) -> DataFrame:
    """Replies that are not older than a newer one seen before them."""
    rows = Ordered(replies, keys, order).scan(run={"_top": ("max", seq)}).df
    return rows.where(F.col(seq) >= F.col("_top")).drop("_top")


def latest_import(archives: DataFrame, title: str, order: Names) -> DataFrame:
    """The last import of each title; rows without a title all stay."""
    cols = archives.columns
    named = archives.where(F.coalesce(F.col(title), F.lit("")) != "")
    last = named.groupBy(title).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_b")).select("_b.*")
    return last.unionByName(archives.where(F.coalesce(F.col(title), F.lit("")) == ""))


def assign_variants(passages: DataFrame, key: str, variants: int, per: int) -> DataFrame:
    """``per`` renderings of each numbered passage, with variant (i + 3 r) mod ``variants``."""
    rows = passages.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(per - 1))))
    return rows.withColumn("variant", ((F.col(key) + F.col("repeat") * 3) % variants).cast("int"))


def as_of(left: DataFrame, right: DataFrame, keys: Names, at: str, value: str) -> DataFrame:
    """``left`` with the ``value`` of the last row of ``right`` at or before it; both sides are merged, not joined."""
    cols = left.columns
    rows = left.withColumns({"_side": F.lit(1), "_v": F.lit(None)}).unionByName(
        right.select(*keys, at, F.lit(0).alias("_side"), F.struct(F.col(value).alias("v")).alias("_v"),
                     *[F.lit(None).alias(c) for c in cols if c not in (*keys, at)]))
    tie = [c for c in cols if c not in (*keys, at)]
    found = Ordered(rows, keys, [at, "_side", *tie]).scan(run={"_last": ("last", "_v")}).df.where("_side = 1")
    return found.select(*cols, F.col("_last.v").alias(value))


def correlate(requests: DataFrame, replies: DataFrame, keys: Names) -> DataFrame:
    """(keys, asked, told, latency): each request with the first reply of its keys that is not older.

    A request that was first answered by a failure has no row; one without any reply stays open, with nulls.
    ``requests`` has (keys, asked), ``replies`` (keys, told, ok). Of replies of one time a good one counts first.
    """
    met = requests.join(replies, list(keys), "left")
    due = F.col("told") >= F.col("asked")
    first = F.min(F.when(due, F.struct("told", (~F.coalesce("ok", F.lit(False))).alias("failed")))).alias("_r")
    found = met.groupBy(*keys, "asked").agg(first).where(~F.coalesce(F.col("_r.failed"), F.lit(False)))
    return found.select(*keys, "asked", F.col("_r.told").alias("told"), (F.col("_r.told") - F.col("asked")).alias("latency"))
