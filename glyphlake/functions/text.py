"""Text expressions. Everything is a Column except the compatibility fold."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphlake.functions import fixed


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(text) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(_col(text), "(?U)^[\\s\ufeff]+|[\\s\ufeff]+$", "")


def _fold(texts: pd.Series) -> pd.Series:
    return texts.map(lambda s: unicodedata.normalize("NFKC", s), na_action="ignore")


# Full-width ASCII and the ideographic blank fold one to one, so they stay in the JVM.
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))) + "\u3000"
_NARROW = "".join(map(chr, range(0x21, 0x7F))) + " "


def _narrow(text: Column) -> Column:
    return F.translate(text, _WIDE, _NARROW)


def _odd(text: Column) -> Column:
    return text.rlike(f"[^{fixed.NFKC_STABLE}]")


def nfkc(text) -> Column:
    """Compatibility fold. Only rows with a character that needs it reach Python."""
    text = _narrow(_col(text))
    fold = F.pandas_udf(_fold, T.StringType())
    return F.coalesce(fold(F.when(_odd(text), text)), text)


def normalize_eval(text, include_ruby: bool = False, fold: bool = True) -> Column:
    """Comparable form of a truth or hypothesis text."""
    lines = F.split(_col(text), "\\R")
    if include_ruby:
        lines = F.transform(lines, lambda s: F.regexp_replace(s, "^#ruby:", ""))
    kept = F.array_join(F.filter(lines, lambda s: ~s.startswith("#")), "\n")
    kept = nfkc(kept) if fold else kept
    return F.regexp_replace(F.regexp_replace(kept, "[・.．…]{3,}", "…"), "(?U)\\s+", "")


#: Distances up to here are found in a band of the table.
NEAR = 16


def edit_distance(a, b) -> Column:
    """Levenshtein distance. Equal texts cost their length, of near ones only a band of the table is filled."""
    a, b = _col(a), _col(b)
    near = F.nullif(F.levenshtein(a, b, NEAR), F.lit(-1))
    return F.when(a == b, F.lit(0)).otherwise(F.coalesce(near, F.levenshtein(a, b)))


def prefixes(text, max_len: int = fixed.MAX_MATCH) -> Column:
    """Array of (len, surface) for every prefix of at most ``max_len`` glyphs."""
    text = _col(text)
    n = F.least(F.lit(max_len), F.length(text))
    # Spelled out, not a lambda: Spark compiles it.
    spans = F.array(*[F.struct(F.lit(i).alias("len"), F.left(text, F.lit(i)).alias("surface")) for i in range(1, max_len + 1)])
    return F.slice(spans, F.lit(1), n)


def short_step(name) -> Column:
    """A short name for an inflection step."""
    name = _col(name)
    return (F.when(name.rlike("^[\\x00-\\x7F]"), F.regexp_replace(name, " Form$", ""))
            .otherwise(F.regexp_replace(name, " [A-Za-z][\\s\\S]*$", "")))


def compact_route(steps) -> Column:
    """Drop elements equal to the one before."""
    steps = _col(steps)
    return F.filter(steps, lambda s, i: (i == 0) | (s != F.get(steps, i - 1)))


def class_fraction(text, counted: str, among: str) -> Column:
    """Characters in class ``counted`` over characters matching ``among``; 0 when none."""
    text = _col(text)
    n = F.regexp_count(text, F.lit(among))
    return F.when(n > 0, F.regexp_count(text, F.lit(counted)) / n).otherwise(F.lit(0.0))


def kana_fraction(text, variant: str = "letters") -> Column:
    """Share of kana among kana and kanji, or among all non-blank characters."""
    if variant == "letters":
        kana = fixed.HIRAGANA_LETTERS + fixed.KATAKANA_LETTERS
        return class_fraction(text, f"[{kana}]", f"[{kana}{fixed.KANJI}]")
    return class_fraction(text, f"[{fixed.KANA_BLOCKS}]", "(?U)\\S")


def is_cjk(text, cls: str = fixed.CJK) -> Column:
    return _col(text).rlike(f"[{cls}]")


def morae(kana) -> Column:
    """Kana grouped so that small kana stay with the one before."""
    return F.regexp_extract_all(_col(kana), F.lit(f"[\\s\\S][{fixed.SMALL_KANA}]*"), F.lit(0))


def pitch_contour(moras, position) -> Column:
    """Per mora: is it high, and does the pitch fall after it."""
    p = _col(position)

    def shape(m, i):
        high = (F.when(p == 0, i > 0).when(p == 1, i == 0).otherwise((i > 0) & (i < p)))
        return F.struct(m.alias("mora"), high.alias("high"), ((p > 0) & (i == p - 1)).alias("fall"))

    return F.transform(_col(moras), shape)


def quoted_examples(text, opening: str = "「", closing: str = "」") -> Column:
    return F.regexp_extract_all(_col(text), F.lit(f"{opening}[^{closing}]*{closing}"), F.lit(0))


# The line patterns of plain glosses. The ideographic blank counts as a blank.
_NUMBERED = ("^[\\s\u3000]*(?:[\\u2460-\\u24ff\\u2776-\\u277f\\u3220-\\u3229\\u3251-\\u325f\\u32b1-\\u32bf]"
             "|[\\d\\uff10-\\uff19]{1,2}[.、)）]\\s?)")


def classify_line(line) -> Column:
    """``head``, ``ex``, ``row``, ``numbered``, ``label`` or empty, for one trimmed line."""
    line = _col(line)
    return (F.when(line.rlike("^[\\s\u3000]*[\\[［〘【][^\\]］〙】]{1,14}[\\]］〙】][\\s\u3000]*$"), "head")
            .when(line.rlike("^[\\s\u3000]*[「『].{1,120}[」』][\\s\u3000]*$"), "ex")
            .when(line.rlike("[|｜][^|｜]*[|｜]"), "row")
            .when(line.rlike(_NUMBERED), "numbered")
            .when(line.rlike("[：:][\\s\u3000]*$") & (F.length(line) <= 9), "head")
            .when(line.rlike("^[\\s\u3000]*[^\\s\u3000：:]{1,8}[：:][\\s\u3000]*"), "label")
            .otherwise(""))


def line_label(line) -> Column:
    """The short label in front of a colon, empty when there is none."""
    return F.regexp_extract(_col(line), "^[\\s\u3000]*([^\\s\u3000：:]{1,8})[：:][\\s\u3000]*", 1)


def heading_text(line) -> Column:
    line = F.regexp_replace(_col(line), "^[\\s\u3000\\[［〘【]+", "")
    return F.regexp_replace(line, "[\\]］〙】：:\\s\u3000]+$", "")


def row_cells(line, separators: str = "[|｜]") -> Column:
    cells = F.transform(F.split(_col(line), separators), strip)
    return F.filter(cells, lambda c: c != "")


def split_plain(text, url_marks: Sequence[str] = fixed.URL_MARKS,
                head_marks: Sequence[str] = fixed.HEADWORD_MARKS,
                pos_marks: tuple[str, str] = ("〘", "〙")) -> Column:
    """Lines of a plain gloss without links, headword line and bare class line."""
    lines = F.transform(F.split(_col(text), "\n"), strip)

    def wanted(s):
        keep = s != ""
        for mark in url_marks:
            keep = keep & ~s.contains(mark)
        return keep

    def without_first(arr, test):
        first = F.get(arr, F.lit(0))
        return F.when(F.coalesce(test(first), F.lit(False)), F.filter(arr, lambda s, i: i > 0)).otherwise(arr)

    def headword(s):
        hit = F.lit(False)
        for mark in head_marks:
            hit = hit | s.contains(mark)
        return hit

    lines = without_first(F.filter(lines, wanted), headword)
    return without_first(lines, lambda s: s.startswith(pos_marks[0]) & s.endswith(pos_marks[1]))


def is_tag_noise(sense) -> Column:
    return F.lower(strip(_col(sense))).isin(*fixed.TAG_NOISE)


def collapse_blank(text) -> Column:
    return F.regexp_replace(_col(text), "\n[ \\t\n]*\n", "\n")


def strip_edges(text) -> Column:
    """Drop punctuation at both ends."""
    return F.regexp_replace(F.regexp_replace(_col(text), "^\\p{P}+", ""), "\\p{P}+$", "")


def strip_invisible(text) -> Column:
    return F.translate(_col(text), "\u200b\ufeff\r\n\t", "")


def sentences(text, ends: str = fixed.SENTENCE_END, continues: str = fixed.SENTENCE_CONTINUE) -> Column:
    """Cut after an end mark unless the next character continues the sentence."""
    marked = F.regexp_replace(_col(text), f"([{ends}])(?![{continues}])", "$1\u0000")
    return F.filter(F.split(marked, "\u0000"), lambda s: s != "")


def ruby_units(segments) -> Column:
    """One unit per plain character; a ruby group stays one unit."""
    def units(seg):
        plain = F.transform(F.filter(F.split(seg["text"], ""), lambda c: c != ""),
                            lambda c: F.struct(c.alias("text"), F.lit(None).cast("string").alias("ruby")))
        whole = F.array(F.struct(seg["text"].alias("text"), seg["ruby"].alias("ruby")))
        return F.when(F.coalesce(seg["ruby"], F.lit("")) != "", whole).otherwise(plain)

    return F.flatten(F.transform(_col(segments), units))


def first_senses(senses, n: int = fixed.MAX_SENSES) -> Column:
    """The first ``n`` distinct non-blank senses in order."""
    trimmed = F.filter(F.transform(_col(senses), strip), lambda s: s != "")
    return F.slice(F.array_distinct(trimmed), 1, n)


def wrap_units(text, k: int) -> Column:
    """Lines of ``k`` cells for text without ruby."""
    text = _col(text)
    lines = F.transform(F.sequence(F.lit(0), F.floor((F.length(text) - 1) / k).cast("int")),
                        lambda i: text.substr(i * k + 1, F.lit(k)))
    return F.when(F.length(text) > 0, lines).otherwise(F.slice(lines, 1, 0))
