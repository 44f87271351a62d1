"""Line messages and the page payloads in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A page message: its lines in order, each with its glyphs in order.
PAYLOAD = "lines array<struct<li int, chars array<struct<c string, x int, y int, w int, h int, conf double>>>>"


def parse_ndjson(lines: DataFrame, line: str, schema: str) -> DataFrame:
    """Rows of the JSON objects; blank and unreadable lines are skipped."""
    parsed = F.from_json(line, f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    rows = lines.where(F.trim(line) != "").select(*[c for c in lines.columns if c != line], parsed.alias("_m"))
    return rows.where("_m is not null and _m._bad is null").select(*rows.columns[:-1], "_m.*").drop("_bad")


def read_ndjson(spark: SparkSession, path: str, schema: str, stream: bool = False) -> DataFrame:
    """Messages of a folder of line files, as a table or a stream."""
    return parse_ndjson((spark.readStream if stream else spark.read).text(path), "value", schema)


def route(crop: Column, idle: Column, frame: Column, unchanged: Column) -> Column:
    """The kind of a message; the first test that holds decides."""
    return (F.when(F.coalesce(crop, F.lit(False)), "crop").when(F.coalesce(idle, F.lit(False)), "idle")
            .when(frame.isNull(), "other").when(F.coalesce(unchanged, F.lit(False)), "heartbeat").otherwise("payload"))


def _hundredths(share: Column) -> Column:
    """Numbers of 0..1 at two decimals. Decimals are slow, so only what lies near a half is rounded as one."""
    at = share * 100
    return F.when(F.abs(at - F.floor(at) - 0.5) < 1e-6, F.round(share, 2)).otherwise(F.floor(at + 0.5) / 100)


def assemble_payload(glyphs: DataFrame, page: list[str]) -> DataFrame:
    """(page, payload): one JSON message per page, of the shape ``PAYLOAD``.

    Positions are cut toward zero, sizes rounded up, the confidence brought into 0..1 at two
    decimals and left out when null. A page's message is as long as its text times a constant,
    and it is gathered line by line first.
    """
    whole = {"x": F.col("x").cast("int"), "y": F.col("y").cast("int"), "w": F.ceil("w").cast("int"), "h": F.ceil("h").cast("int"),
             "conf": F.when(F.col("conf").isNotNull(), _hundredths(F.greatest(F.lit(0.0), F.least(F.lit(1.0), "conf"))))}
    glyph = F.struct("ci", F.struct(F.col("ch").alias("c"), "x", "y", "w", "h", "conf").alias("g"))
    lines = glyphs.withColumns(whole).groupBy(*page, "li").agg(F.sort_array(F.collect_list(glyph)).getField("g").alias("chars"))
    pages = lines.groupBy(*page).agg(F.sort_array(F.collect_list(F.struct("li", "chars"))).alias("lines"))
    return pages.select(*page, F.to_json(F.struct("lines")).alias("payload"))


def flatten_payload(pages: DataFrame, page: list[str], payload: str = "payload") -> DataFrame:
    """(page, li, ci, ch, x, y, w, h, conf): a row per glyph; lines without glyphs have none."""
    rows = pages.where(F.trim(payload) != "").select(*page, F.from_json(
        payload, f"{PAYLOAD}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("_m"))
    # Tests of what is generated stay above; those of the parsed message would be made below a shuffle, where it is parsed once more.
    lines = rows.select(*page, F.when(F.col("_m._bad").isNull(), F.col("_m.lines")).alias("_l")).select(*page, F.explode_outer("_l").alias("l"))
    return lines.select(*page, "l.li", F.posexplode("l.chars").alias("ci", "g")).select(
        *page, "li", "ci", F.col("g.c").alias("ch"), "g.x", "g.y", "g.w", "g.h", "g.conf")


def job_progress(events: DataFrame, job: str, at: list[str], done: str, total: str, phase: str) -> DataFrame:
    """(job, phase, percent) by the latest event of each job; no percent without a total."""
    last = events.groupBy(job).agg(F.max_by(F.struct(done, total, phase), F.struct(*at)).alias("l"))
    share = F.floor(F.col(f"l.{done}") * 100 / F.nullif(F.col(f"l.{total}"), F.lit(0)) + 0.5)
    return last.select(job, F.col(f"l.{phase}").alias("phase"), share.cast("int").alias("percent"))
