"""Dictionary lookup steps: visibility, joins, ranking and nesting of entries.

Tables: ``terms(key, reading, gloss_key, score, dict, pos)``, ``glosses(gloss_key,
gloss_json)``, ``freq(term, source, value)``, ``pitch(term, reading, position)``,
``kanji(char, on_yomi, kun_yomi, meanings, dict)`` and ``prefs(name, enabled, ord)``.
``prefs`` is left to Spark's size-based broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphlake.functions import fixed
from glyphlake.functions.gloss import dict_kind
from glyphlake.functions.text import nfkc, strip
from glyphlake.ordered import Ordered, first_n

LAST = 2147483647


def visible(df: DataFrame, prefs: DataFrame, label: str = "dict") -> DataFrame:
    """Hide rows of a dictionary that is known and switched off; unknown ones stay."""
    off = prefs.where(~F.col("enabled")).select(F.col("name").alias(label))
    return df.join(off, label, "left_anti")


def with_rank(df: DataFrame, prefs: DataFrame, label: str = "dict", name: str = "rank") -> DataFrame:
    """Preference order of each row's dictionary; unlisted ones come last."""
    on = prefs.where("enabled").select(F.col("name").alias(label), F.col("ord").alias(name))
    return df.join(on, label, "left").withColumn(name, F.coalesce(name, F.lit(LAST)))


def prefix_counts(queries: DataFrame, keys: Sequence[str], q: str, max_len: int = fixed.MAX_MATCH) -> DataFrame:
    """(keys, len, n, n_distinct, last): how many prefixes of each length the ``q`` of a key have, and the last of them.

    The queries of a key are sorted once in place of their prefixes: equal prefixes of sorted texts follow each
    other, so a text brings a new prefix of those lengths that it does not share with the one before.
    """
    w = Window.partitionBy(*keys).orderBy(q)
    rows = queries.select(*keys, F.col(q).alias("_q"), F.lag(q).over(w).alias("_p"), F.length(q).alias("_n"))
    lengths = range(1, max_len + 1)

    def new(n):
        here, before = F.left("_q", F.lit(n)), F.left("_p", F.lit(n))
        return (F.col("_n") >= n) & ~F.coalesce(here == before, F.lit(False))

    counted = rows.groupBy(*keys).agg(*[c for n in lengths for c in (
        F.count_if(F.col("_n") >= n).alias(f"_n{n}"), F.count_if(new(n)).alias(f"_d{n}"),
        F.max(F.when(F.col("_n") >= n, F.col("_q"))).alias(f"_m{n}"))])
    each = F.array(*[F.struct(F.lit(n).alias("len"), F.col(f"_n{n}").alias("n"), F.col(f"_d{n}").alias("n_distinct"),
                              F.left(f"_m{n}", F.lit(n)).alias("last")) for n in lengths])
    return counted.select(*keys, F.inline(each)).where("n > 0")


def drop_fragments(entries: DataFrame, glosses: str = "glosses", reading: str = "reading") -> DataFrame:
    """Drop entries whose whole gloss is one string of at most two characters equal to the reading."""
    first = F.get(F.col(glosses), F.lit(0))
    fragment = (F.size(glosses) == 1) & (F.length(first) <= 2) & (first == F.col(reading))
    return entries.where(~F.coalesce(fragment, F.lit(False)))


def probe_terms(cands: DataFrame, terms: DataFrame, form: str = "form") -> DataFrame:
    """Every term row of every candidate. No limit before ranking."""
    return cands.join(terms, cands[form] == terms["key"])


#: So many rows of a dictionary, of about a hundred bytes each, are sent to the spans of a text.
SENT_ROWS = 200_000


def probe_spans(spans: DataFrame, known: DataFrame, on: str) -> DataFrame:
    """Every row of ``known`` for every span. ``known`` is read twice, so it should be written.

    Spark takes spans spelled out from a small text for as small as the text and would send them out; here only
    the dictionary is, as long as it is small, and otherwise both are sorted.
    """
    few = known.limit(SENT_ROWS + 1).count() <= SENT_ROWS
    return spans.join(known.hint("broadcast" if few else "merge"), on)


def with_gloss(terms: DataFrame, glosses: DataFrame) -> DataFrame:
    return terms.join(glosses, "gloss_key")


def attach_pitch(groups: DataFrame, pitch: DataFrame, n: int = fixed.SHOWN_PITCH, key: str = "key") -> DataFrame:
    """At most ``n`` accents per term. The accent side is limited before the join."""
    few = first_n(pitch, ["term"], [F.col("reading"), F.col("position")], n, "pitch_no")
    return groups.join(few.select(F.col("term").alias(key), F.col("reading").alias("pitch_reading"),
                                  "position", "pitch_no"), key, "left")


def freq_summary(freq: DataFrame, prefs: DataFrame) -> DataFrame:
    """(term, min_freq, n_freq, freqs): all marks by preference, then value, and the first value.

    A term has one mark per frequency list, so the list is bounded by their number.
    """
    shown = with_rank(visible(freq, prefs, "source"), prefs, "source")
    every = F.sort_array(F.collect_list(F.struct("rank", "value", "source")))
    return shown.groupBy("term").agg(
        F.min_by("value", F.struct("rank", "value", "source")).alias("min_freq"), F.count("*").alias("n_freq"),
        F.transform(every, lambda f: F.struct(f["source"].alias("source"), f["value"].alias("value"))).alias("freqs"))


def attach_freq(groups: DataFrame, freq: DataFrame, prefs: DataFrame, key: str = "key") -> DataFrame:
    return groups.join(freq_summary(freq, prefs).withColumnRenamed("term", key), key, "left")


def top_freq(freq: DataFrame, prefs: DataFrame, n: int = fixed.SHOWN_FREQ) -> DataFrame:
    """The ``n`` frequency marks shown per term."""
    shown = with_rank(visible(freq, prefs, "source"), prefs, "source")
    return first_n(shown, ["term"], [F.col("rank"), F.col("value"), F.col("source")], n, "chip_no")


def char_fallback(queries: DataFrame, matched: DataFrame | None, kanji: DataFrame, prefs: DataFrame,
                  keys: Sequence[str], q: str = "q") -> DataFrame:
    """For queries without a match, the entry of their first character.

    ``matched`` has the keys of those with one; None if ``queries`` are only those without.
    """
    shown = with_rank(visible(kanji, prefs), prefs)
    best = shown.groupBy("char").agg(F.min_by(
        F.struct("on_yomi", "kun_yomi", "meanings", "dict"),
        F.struct("rank", "dict", "on_yomi", "kun_yomi", "meanings")).alias("k")).select("char", "k.*")
    if matched is not None:
        queries = queries.join(matched.select(*keys).distinct(), list(keys), "left_anti")
    first = queries.select(*keys, nfkc(F.substring(q, 1, 1)).alias("char"))
    parts = F.filter(F.array("on_yomi", "kun_yomi"), lambda s: F.coalesce(s, F.lit("")) != "")
    # One row a character, however many queries: Spark takes queries spelled out from a small text for the smaller side.
    return first.join(best.hint("broadcast"), "char").select(
        *keys, "char", F.array_join(parts, " / ").alias("reading"), "on_yomi", "kun_yomi", "dict",
        F.slice("meanings", 1, fixed.MAX_MEANINGS).alias("glosses"))


def known_words(words: DataFrame, terms: DataFrame, word: str = "word") -> DataFrame:
    return words.join(terms.select(F.col("key").alias(word)), word, "left_semi")


def unknown_words(words: DataFrame, terms: DataFrame, word: str = "word") -> DataFrame:
    return words.join(terms.select(F.col("key").alias(word)), word, "left_anti")


def enrich_rank(tokens: DataFrame, freq: DataFrame, on: Sequence[str]) -> DataFrame:
    """Frequency rank of each token. The table side has one row per key, so a hot
    token is split by adaptive skew handling without duplicating work."""
    return tokens.join(freq, list(on), "left")


def group_score(entries: DataFrame, keys: Sequence[str]) -> DataFrame:
    return entries.groupBy(*keys).agg(F.coalesce(F.max("score"), F.lit(0)).alias("score"))


def keep_longest(hits: DataFrame, keys: Sequence[str], form: str = "form") -> DataFrame:
    """Each form once per query, from its longest prefix; ties by candidate place.

    An aggregate, not a window: it combines before the shuffle.
    """
    rest = [c for c in hits.columns if c not in (*keys, form)]
    best = F.min_by(F.struct(*rest), F.struct((-F.col("len")).alias("a"), F.col("ci").alias("b"))).alias("_b")
    return hits.groupBy(*keys, form).agg(best).select(*keys, form, "_b.*")


_GROUP_ORDER = ("len desc", "ci", "min_freq nulls last", "score desc", "form")


def _group_rank():
    return F.struct((-F.col("len")).alias("a"), F.col("ci").alias("b"), F.col("min_freq").isNull().alias("c"),
                    F.col("min_freq").alias("d"), (-F.col("score")).alias("e"), F.col("form").alias("f"))


def rank_groups(groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Longest match, fewest steps, best frequency, best score.

    One query has at most twelve prefixes times the rule forms, so its group is small.
    """
    w = Window.partitionBy(*keys).orderBy(_group_rank())
    return groups.withColumn("group_no", F.row_number().over(w))


def best_match(groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    rest = [c for c in groups.columns if c not in keys]
    return groups.groupBy(*keys).agg(F.min_by(F.struct(*rest), _group_rank()).alias("_b")).select(*keys, "_b.*")


def rank_entries(entries: DataFrame, prefs: DataFrame, keys: Sequence[str], hint: str | None = None,
                 tie: Sequence[str] = ("pos", "gloss_key")) -> DataFrame:
    """Entry order: readings the hint contains, then dictionary preference, then score."""
    ranked = with_rank(entries, prefs)
    miss = ~F.coalesce(F.col(hint).contains(F.col("reading")), F.lit(False)) if hint else F.lit(False)
    ranked = ranked.withColumns({"_miss": miss, "_score": -F.col("score")})
    order = ["_miss", "rank", "_score", *tie]
    return Ordered(ranked, keys, order, bounded=True).scan(number="entry_no").df.drop("_miss", "_score")


def fair_order(entries: DataFrame, keys: Sequence[str], per_dict: int = fixed.FIRST_SCREEN_PER_DICT) -> DataFrame:
    """The first entries of every dictionary come before all the rest; else order is kept."""
    numbered = Ordered(entries, [*keys, "dict"], ["entry_no"], bounded=True).scan(number="_n").df
    late = numbered.withColumn("_late", F.col("_n") > per_dict)
    return Ordered(late, keys, ["_late", "entry_no"], bounded=True).scan(number="show_no").df.drop("_late", "_n")


def shown_pitch(groups: DataFrame, pitch: DataFrame, n: int = fixed.SHOWN_PITCH) -> DataFrame:
    """Accents of the reading that is shown. ``groups`` has (key, reading)."""
    rows = pitch.withColumnRenamed("term", "key").join(groups.select("key", "reading").distinct(), ["key", "reading"])
    return first_n(rows, ["key", "reading"], [F.col("position")], n, "accent_no")


def order_by_kind(entries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drop entries that would print the same, then order by kind of dictionary."""
    rest = [c for c in entries.columns if c not in (*keys, "dict", "gloss_json")]
    once = entries.groupBy(*keys, "dict", "gloss_json").agg(
        F.min_by(F.struct(*rest), "entry_no").alias("_b")).select(*keys, "dict", "gloss_json", "_b.*")
    kind = dict_kind(F.col("dict"), F.col("gloss_json"))
    place = F.create_map(*[x for i, k in enumerate(fixed.KIND_ORDER) for x in (F.lit(k), F.lit(i))])
    rows = once.withColumn("kind", kind).withColumn(
        "_k", F.coalesce(F.try_element_at(place, F.col("kind")), F.lit(9)))
    return Ordered(rows, keys, ["_k", "entry_no"], bounded=True).scan(number="kind_no").df.drop("_k")


def order_candidates(cands: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``ci``: the surface itself first, then fewest steps; bounded by the rule table."""
    w = Window.partitionBy(*keys).orderBy("steps", "form")
    return cands.withColumn("ci", F.row_number().over(w) - 1)


def nest_result(rows: DataFrame, keys: Sequence[str], order: Sequence[str], fields: Sequence[str],
                name: str) -> DataFrame:
    """One row per key: its rows, in order, as one JSON array. The rows of a key are what one card shows."""
    items = F.sort_array(F.collect_list(F.struct(F.struct(*order).alias("o"), F.struct(*fields).alias("v"))))
    return rows.groupBy(*keys).agg(F.to_json(F.transform(items, lambda s: s["v"])).alias(name))


def name_readings(entries: DataFrame, keys: Sequence[str], text: str, order: str,
                  n: int = fixed.MAX_NAME_READINGS, separators: str = "[、,]") -> DataFrame:
    """The first ``n`` distinct readings of each key in order of appearance."""
    parts = entries.select(*keys, F.col(order).alias("_o"), F.posexplode(F.split(text, separators)).alias("_i", "w"))
    parts = parts.withColumn("w", strip("w")).where(F.col("w") != "")
    first = parts.groupBy(*keys, "w").agg(F.min(F.struct("_o", "_i")).alias("at"))
    few = first_n(first, keys, [F.col("at")], n)
    return few.groupBy(*keys).agg(F.expr("listagg(w, '、') within group (order by at)").alias("readings"))


def group_by_reading(entries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Reading groups of each card in order of first entry, names apart.

    One row per reading with sizes; entries keep their place through ``entry_no``.
    """
    rows = entries.withColumn("is_name", dict_kind(F.col("dict"), F.col("gloss_json")) == "name")
    return rows.groupBy(*keys, "is_name", F.coalesce("reading", F.lit("")).alias("reading")).agg(
        F.min("entry_no").alias("first_no"), F.count("*").alias("n"), F.max("score").alias("top_score"))
