"""Structured glossaries: from nested JSON to node rows, text, senses and roles."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphlake.functions import fixed
from glyphlake.functions.text import is_tag_noise, split_plain, strip
from glyphlake.operators.setops import first_nonempty

_TEXT, _MAP = T.StringType(), T.MapType(T.StringType(), T.StringType())
_ABOVE = T.StructType([T.StructField(n, _TEXT) for n in ("tag", "content", "name", "cls", "mark")])
_NODES = T.ArrayType(T.StructType([
    T.StructField("path", T.ArrayType(T.IntegerType())),
    *[T.StructField(n, _TEXT) for n in ("tag", "text", "title", "alt", "src")],
    T.StructField("data", _MAP), T.StructField("style", _MAP), T.StructField("above", T.ArrayType(_ABOVE))]))


def _scalars(value) -> dict | None:
    if not isinstance(value, dict):
        return None
    return {str(k): str(v) for k, v in value.items()
            if isinstance(v, (str, int, float)) and not isinstance(v, bool)}


def _walk(tree):
    """One tuple per node in reading order. A stack, so depth is bounded by memory alone."""
    todo = [([], tree, [])]
    while todo:
        path, node, above = todo.pop()
        if node is None:
            continue
        if isinstance(node, list) or not path:
            blank = {"tag": "", "content": None, "name": None, "cls": None, "mark": None}
            items = node if isinstance(node, list) else [node]
            todo += [([*path, i], x, [*above, blank] if path else above) for i, x in reversed(list(enumerate(items)))]
            continue
        if not isinstance(node, dict):
            text = str(node).lower() if isinstance(node, bool) else str(node)
            yield path, None, text, None, None, None, None, None, above
            continue
        data, style = _scalars(node.get("data")) or {}, _scalars(node.get("style")) or {}
        tag = "img" if node.get("type") == "image" else str(node.get("tag") or "").lower()
        text = str(node.get("text", "")) if node.get("type") == "text" else None
        yield (path, "span" if tag == "a" else tag, text, node.get("title"), node.get("alt"),
               node.get("path"), data, style, above)
        if text is None and tag != "img" and node.get("content") is not None:
            up = {"tag": tag, "content": data.get("content"), "name": data.get("name"),
                  "cls": data.get("class"), "mark": style.get("listStyleType")}
            inner = node["content"] if isinstance(node["content"], list) else [node["content"]]
            todo += [([*path, i], x, [*above, up]) for i, x in reversed(list(enumerate(inner)))]


def _nodes(glosses: pd.Series) -> pd.Series:
    names = ("path", "tag", "text", "title", "alt", "src", "data", "style", "above")

    def one(text):
        try:
            tree = json.loads(text)
        except (ValueError, RecursionError):
            tree = text
        return [dict(zip(names, row)) for row in _walk(tree)]

    return glosses.map(one, na_action="ignore")


def with_nodes(glosses: DataFrame, gloss_json: str = "gloss_json") -> DataFrame:
    """Add ``nodes``: every node of the tree, in reading order, with its ancestors.

    Trees have no depth bound, which no builtin can walk; the small walker runs
    per Arrow batch and everything after it is column work.
    """
    return glosses.withColumn("nodes", F.pandas_udf(_nodes, _NODES)(F.col(gloss_json)))


def gloss_nodes(glosses: DataFrame, keys=("gloss_key",)) -> DataFrame:
    """One row per node. Unknown tags are kept as they are."""
    return (with_nodes(glosses).select(*keys, F.posexplode("nodes").alias("ord", "node"))
            .select(*keys, "ord", "node.*")
            .withColumn("depth", F.size("path"))
            .withColumn("role", node_role(F.col("data"))))


def image_name(path) -> Column:
    """A marker's name from its file name: at most two non-Latin characters."""
    base = F.element_at(F.split(path, "/"), -1)
    base = F.regexp_replace(base, "(?i)\\.[a-z0-9]+$", "")
    base = F.regexp_replace(base, "(?i)[-_][a-z0-9]+$", "")
    return F.when((F.length(base) <= 2) & ~base.rlike("(?i)[a-z0-9_-]"), base).otherwise("")


def image_label(title, alt, path) -> Column:
    return F.coalesce(F.when(title != "", title), F.when(alt != "", alt), image_name(path), F.lit(""))


def _in_reading(node) -> Column:
    return (F.exists(node["above"], lambda a: a["tag"].isin("rt", "rp"))
            | F.coalesce(node["tag"].isin("rt", "rp"), F.lit(False)))


def visible_text(nodes) -> Column:
    """Text a reader sees: readings are skipped, an image counts as its label."""
    def shown(n):
        label = F.coalesce(F.when(n["title"] != "", n["title"]), n["alt"], F.lit(""))
        return F.when(n["tag"] == "img", label).otherwise(F.coalesce(n["text"], F.lit("")))

    return F.array_join(F.transform(F.filter(nodes, lambda n: ~_in_reading(n)), shown), "")


def gloss_text(glosses: DataFrame) -> DataFrame:
    return with_nodes(glosses).withColumn("text", visible_text(F.col("nodes"))).drop("nodes")


def node_role(data) -> Column:
    """The first known name among content, name, meikyo, class; else by image source."""
    roles = F.create_map(*[F.lit(x) for pair in fixed.ROLES.items() for x in pair])
    role = F.coalesce(*[F.try_element_at(roles, F.try_element_at(data, F.lit(k)))
                        for k in ("content", "name", "meikyo", "class")])
    src = F.try_element_at(data, F.lit("src"))
    by_source = F.lit(None).cast("string")
    for needle, name in reversed(fixed.ROLES_BY_SOURCE):
        by_source = F.when(src.contains(needle), name).otherwise(by_source)
    return F.coalesce(role, by_source, F.lit(""))


def keep_styles(style) -> Column:
    return F.map_filter(style, lambda k, v: k.isin(*fixed.STYLES))


def safe_keys(data) -> Column:
    """Keys reduced to letters and digits and prefixed; keys left empty are dropped."""
    def clean(k):
        return F.regexp_replace(k, "[^a-zA-Z0-9]", "")

    kept = F.map_filter(data, lambda k, v: clean(k) != "")
    return F.transform_keys(kept, lambda k, v: F.concat(
        F.lit("sc"), F.upper(F.substring(clean(k), 1, 1)), clean(k).substr(F.lit(2), F.length(k))))


def dict_kind(label, gloss_text_col, has_readings=None) -> Column:
    """``kanji``, a kind by label prefix, else by the script of the gloss."""
    kind = F.when(F.coalesce(has_readings, F.lit(False)), "kanji") if has_readings is not None else None
    for prefix, name in fixed.DICT_KINDS:
        test = label.startswith(prefix)
        kind = F.when(test, name) if kind is None else kind.when(test, name)
    return (kind.when(gloss_text_col.rlike(f"[{fixed.KANA_BLOCKS}{fixed.KANJI}]"), "mono")
            .otherwise("bi"))


def _first(cond) -> Column:
    """1-based place of the first ancestor that fulfils ``cond``; 0 when none does."""
    return F.coalesce(F.array_position(F.transform("above", cond), True).cast("int"), F.lit(0))


def _leaves(glosses: DataFrame, keys) -> DataFrame:
    rows = with_nodes(glosses).select(*keys, F.posexplode("nodes").alias("ord", "node")).select(*keys, "ord", "node.*")
    return rows.where(F.col("text").isNotNull() & ~F.exists("above", lambda a: a["tag"].isin("rt", "rp")))


def _is(field, *values):
    return lambda a: F.coalesce(a[field].isin(*values), F.lit(False))


def sense_lines_jm(glosses: DataFrame, keys=("gloss_key",)) -> DataFrame:
    """(keys, sense_path, line): each ``sense`` node as marker and items joined by "; ".

    One glossary is one record, so these groups are bounded by it.
    """
    keys = list(keys)
    skip = lambda a: _is("content", *fixed.JM_SKIP)(a) | _is("cls", "tag")(a)
    rows = (_leaves(glosses, keys)
            .withColumns({"_s": _first(_is("content", "sense")), "_k": _first(skip)})
            .where((F.col("_s") > 0) & ((F.col("_k") == 0) | (F.col("_k") > F.col("_s"))))
            .withColumn("_g", F.array_position(F.transform(
                "above", lambda a, i: _is("content", "glossary")(a) & (i >= F.col("_s"))), True).cast("int"))
            .where(F.col("_g") > 0)
            .withColumns({
                "sense_path": F.expr("slice(path, 1, _s)"),
                "item_path": F.expr("slice(path, 1, _g + 1)"),
                "mark": F.trim(F.translate(F.coalesce(F.expr("above[_s - 1].mark"), F.lit("")), '"', ""))}))
    items = (rows.groupBy(*keys, "sense_path", "item_path", "mark")
             .agg(F.expr("listagg(text, '') within group (order by ord)").alias("item"))
             .withColumn("item", strip("item")).where(F.col("item") != ""))
    return (items.groupBy(*keys, "sense_path", "mark")
            .agg(F.expr("listagg(item, '; ') within group (order by item_path)").alias("items"))
            .select(*keys, "sense_path", F.concat(
                F.when(F.col("mark") != "", F.concat("mark", F.lit(" "))).otherwise(""), "items").alias("line")))


def sense_lines_mono(glosses: DataFrame, keys=("gloss_key",)) -> DataFrame:
    """(keys, sense_path, line): each 語義 node as number and definitions joined by a space."""
    keys = list(keys)
    rows = (_leaves(glosses, keys)
            .withColumns({"_s": _first(_is("name", "語義")), "_k": _first(_is("name", *fixed.MONO_SKIP))})
            .where(F.col("_s") > 0)
            .withColumn("_p", F.array_position(F.transform(
                "above", lambda a, i: _is("name", "語義番号", "語釈")(a) & (i >= F.col("_s"))), True).cast("int"))
            .where((F.col("_p") > 0) & ((F.col("_k") == 0) | (F.col("_k") > F.col("_p"))))
            .withColumns({
                "sense_path": F.expr("slice(path, 1, _s)"),
                "part_path": F.expr("slice(path, 1, _p)"),
                "numbered": F.expr("above[_p - 1].name = '語義番号'")}))
    parts = (rows.groupBy(*keys, "sense_path", "part_path", "numbered")
             .agg(F.expr("listagg(text, '') within group (order by ord)").alias("part"))
             .withColumn("part", strip("part")))
    lines = parts.groupBy(*keys, "sense_path").agg(
        F.expr("max_by(part, part_path) filter (where numbered)").alias("num"),
        F.expr("listagg(part, ' ') within group (order by part_path) filter (where not numbered and part <> '')")
        .alias("body"))
    return lines.where(F.coalesce("body", F.lit("")) != "").select(
        *keys, "sense_path", F.concat(
            F.when(F.coalesce("num", F.lit("")) != "", F.concat("num", F.lit(" "))).otherwise(""), "body").alias("line"))


def sense_lines(glosses: DataFrame, keys=("gloss_key",)) -> DataFrame:
    """(keys, line, at): the displayable senses of a glossary.

    Each top-level element is answered by the first source that yields a line:
    marked senses, monolingual senses, its visible text cut into lines. Only a
    glossary without any line falls back to every string that is no bare tag.
    """
    keys = list(keys)
    within = [*keys, "top"]
    cols = [*keys, F.col("sense_path")[0].alias("top"), F.col("sense_path").alias("at"), "line"]
    jm = sense_lines_jm(glosses, keys).select(*cols)
    mono = sense_lines_mono(glosses, keys).select(*cols)
    tops = with_nodes(glosses).select(
        *keys, "nodes", F.explode(F.array_distinct(F.transform("nodes", lambda n: n["path"][0]))).alias("top"))
    text = visible_text(F.filter("nodes", lambda n: n["path"][0] == F.col("top")))
    plain = (tops.withColumn("text", text)
             .select(*within, F.posexplode(split_plain("text")).alias("i", "line"))
             .select(*within, F.array("top", "i").alias("at"), "line"))
    loose = (_leaves(glosses, keys).where(~is_tag_noise("text") & (strip("text") != ""))
             .select(*keys, F.col("path").alias("at"), strip("text").alias("line")))
    chosen = first_nonempty(keys, first_nonempty(within, jm, mono, plain).drop("top"), loose)
    return (chosen.withColumn("line", strip("line")).where(F.col("line") != "")
            .groupBy(*keys, "line").agg(F.min("at").alias("at")))
