"""Records of dictionary banks, as rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphlake.ordered import Ordered

_WHOLE = "(-?\\d+)(?:\\.0+)?"


def bank_records(members: DataFrame, payload: str, min_len: int) -> DataFrame:
    """One row (.., pos, rec) per record; records that are no arrays, or too short, are left out.

    ``rec`` holds texts; a nested value keeps its JSON. A payload that is no array has no records.
    """
    rows = members.select(*[c for c in members.columns if c != payload],
                          F.posexplode(F.from_json(payload, "array<string>")).alias("pos", "_rec"))
    rec = F.when(F.ltrim("_rec").startswith("["), F.from_json("_rec", "array<string>"))
    return rows.withColumn("rec", rec).where(F.size("rec") >= min_len).drop("_rec")


def _at(i: int) -> Column:
    """Value ``i`` of the record; null past its end."""
    return F.get("rec", F.lit(i))


def load_terms(records: DataFrame, label: Column) -> DataFrame:
    """Each record under its expression and its reading, once if they are equal; no reading is '', no score 0."""
    reading = F.coalesce(_at(1), F.lit(""))
    rows = records.withColumns({
        "_key": F.explode(F.array_distinct(F.array(F.coalesce(_at(0), F.lit("")), reading))), "_reading": reading})
    return rows.where(F.col("_key") != "").select(
        *[c for c in records.columns if c != "rec"], F.col("_key").alias("key"), F.col("_reading").alias("reading"),
        F.coalesce(_at(4).try_cast("bigint"), F.lit(0)).alias("score"),
        _at(5).alias("gloss_json"), label.alias("dict"))


def load_kanji(records: DataFrame, label: Column) -> DataFrame:
    """Characters with their readings and meanings, from records of at least five values."""
    return records.where((F.size("rec") >= 5) & (F.coalesce(_at(0), F.lit("")) != "")).select(
        _at(0).alias("char"), F.coalesce(_at(1), F.lit("")).alias("on_yomi"), F.coalesce(_at(2), F.lit("")).alias("kun_yomi"),
        F.coalesce(F.from_json(_at(4), "array<string>"), F.array().cast("array<string>")).alias("meanings"), label.alias("dict"))


def load_pitch(records: DataFrame) -> DataFrame:
    """(term, reading, position) of records tagged ``pitch``; positions that are no whole numbers are left out."""
    body = F.from_json(_at(2), "reading string, pitches array<string>")
    rows = records.where(_at(1) == "pitch").select(_at(0).alias("term"), body.alias("b")).select(
        "term", F.coalesce("b.reading", F.lit("")).alias("reading"), F.explode("b.pitches").alias("p"))
    at = F.regexp_extract("p", f'"position"\\s*:\\s*{_WHOLE}\\s*[,}}]', 1)
    return rows.withColumn("position", F.when(at != "", at.cast("int"))).where("position is not null").drop("p")


def load_freq(records: DataFrame, source: Column) -> DataFrame:
    """(term, source, value): the lowest whole rank of records tagged ``freq``.

    The rank stands bare or under ``value`` or ``frequency``, which may hold one more ``value``.
    """
    inner = F.coalesce(F.get_json_object(_at(2), "$.value"), F.get_json_object(_at(2), "$.frequency"))
    nested = F.when(inner.startswith("{"), F.get_json_object(inner, "$.value")).otherwise(inner)
    found = F.when(F.ltrim(_at(2)).startswith("{"), nested).otherwise(_at(2))
    whole = F.regexp_extract(found, f"^{_WHOLE}$", 1)
    rows = records.where(_at(1) == "freq").select(
        _at(0).alias("term"), source.alias("source"), F.when(whole != "", whole.cast("bigint")).alias("value"))
    return rows.where("value is not null").groupBy("term", "source").agg(F.min("value").alias("value"))


def read_terms(current: DataFrame, legacy: DataFrame, kanji: str = "KANJIDIC") -> DataFrame:
    """Terms of both layouts in one shape: the older one has (key, sense, is_kanji) and no reading, label or score."""
    old = legacy.select("key", F.col("sense").alias("gloss_json"), F.when(F.col("is_kanji"), kanji).alias("dict"))
    rows = current.select("key", "reading", "dict", "score", "gloss_json").unionByName(old, allowMissingColumns=True)
    return rows.fillna("", ["reading", "dict"]).fillna(0, ["score"])


def media_assets(members: DataFrame, path: str, types: Mapping[str, str], other: str) -> DataFrame:
    """Members that have an extension, with their content type."""
    ext = F.lower(F.regexp_extract(path, "\\.([A-Za-z0-9]+)$", 1))
    kinds = F.create_map(*[F.lit(v) for pair in types.items() for v in pair])
    return members.withColumn("ext", ext).where("ext <> ''").withColumn(
        "content_type", F.coalesce(F.try_element_at(kinds, F.col("ext")), F.lit(other)))


def register(archives: DataFrame, known: DataFrame, stem: str, title: str, tie: list[str]) -> DataFrame:
    """Archives with label and place: the known ones in their order, the rest by name.

    ``known`` has (stem, label, ord) and is a short fixed list.
    """
    rows = archives.join(known.select(F.col("stem").alias(stem), "label", "ord"), stem, "left")
    rows = rows.withColumns({"label": F.coalesce("label", F.nullif(F.col(title), F.lit("")), F.col(stem)),
                             "_new": F.col("ord").isNull(), "_ord": F.coalesce("ord", F.lit(0))})
    return Ordered(rows, [], ["_new", "_ord", stem, *tie]).scan(number="place").df.drop("_new", "_ord", "ord")
