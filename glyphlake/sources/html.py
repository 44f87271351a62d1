"""Paragraphs of HTML pages, with the readings set above their words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
# Marks put in place of the ruby tags; control characters do not occur in HTML texts.
_OPEN, _READ, _READ_END, _CLOSE = "\u0001", "\u0002", "\u0003", "\u0004"


def _plain(text: Column) -> Column:
    text = F.regexp_replace(text, "<[^>]*>", "")
    for name, char in _ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def _segments(part: Column) -> Column:
    """Array of (text, ruby); ``ruby`` is null for plain text."""
    marked = F.regexp_replace(part, "(?is)<rp\\b[^>]*>.*?</rp\\s*>", "")
    marked = F.regexp_replace(marked, f"[{_OPEN}-{_CLOSE}]", "")
    for tag, mark in (("<ruby\\b[^>]*>", _OPEN), ("</ruby\\s*>", _CLOSE), ("<rt\\b[^>]*>", _READ), ("</rt\\s*>", _READ_END)):
        marked = F.regexp_replace(marked, f"(?i){tag}", mark)
    marked = F.translate(_plain(marked), "​﻿\r\n\t", "")
    marked = F.regexp_replace(marked, f"{_OPEN}([^{_OPEN}-{_CLOSE}]*){_CLOSE}", "$1")
    unit = f"([^{_OPEN}-{_CLOSE}]+)(?:{_READ}([^{_OPEN}-{_CLOSE}]*){_READ_END})?"
    texts, rubies = (F.regexp_extract_all(marked, F.lit(unit), F.lit(i)) for i in (1, 2))
    return F.zip_with(texts, rubies, lambda t, r: F.struct(t.alias("text"), F.nullif(r, F.lit("")).alias("ruby")))


def html_paragraphs(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, para_no, segments): ``<p>`` opens a paragraph and ``<br>`` begins the next one.

    Scripts and styles are skipped, parts that hold an image and empty ones are left out, and
    ``para_no`` counts all parts from 0. Null pages have no paragraphs. Named entities of
    ``_ENTITIES`` are read, others stay as they stand.
    """
    text = F.regexp_replace(html, "(?is)<script\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>", "")
    bodies = F.slice(F.split(text, "(?i)<p(?:\\s[^>]*)?>"), 2, 1 << 30)
    parts = F.flatten(F.transform(bodies, lambda b: F.split(F.regexp_replace(b, "(?is)</p\\s*>.*$", ""), "(?i)<br\\s*/?>")))
    rows = pages.select(key, F.posexplode(parts).alias("para_no", "_part")).where(~F.col("_part").rlike("(?i)<img\\b"))
    return rows.select(key, "para_no", _segments(F.col("_part")).alias("segments")).where(F.size("segments") > 0)


def plain_text(segments) -> Column:
    """The text of a paragraph without its readings."""
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")
