"""Settings as they come from outside, brought into the shape that everything else relies on."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a setting may be.
MODIFIERS = ("shift", "control", "option", "command")
MODES = ("hold", "hover")
ENGINES = ("auto", "vision", "livetext")
RANGES = {"hoverDelayMs": (50, 2000), "interval": (0.1, 10), "passes": (1, 9), "everyN": (1, 60)}
_NUMBER = "^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL|FLOAT|DOUBLE)"


def _at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _kind(v: Column) -> Column:
    """The type of a JSON value; null if it is not there, ``VOID`` for a JSON null."""
    return F.schema_of_variant(v)


def _text(v: Column, kind: Column) -> Column:
    return F.when(kind == "STRING", F.try_variant_get(v, "$", "string"))


def _number(v: Column, kind: Column) -> Column:
    return F.when(kind.rlike(_NUMBER), F.try_variant_get(v, "$", "double"))


def truthy(v: Column, kind: Column) -> Column:
    """False for what is missing, null, false, zero or an empty text; ``kind`` is the type of ``v``."""
    return F.coalesce(F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean")).when(kind.rlike(_NUMBER), _number(v, kind) != 0)
                      .when(kind == "STRING", _text(v, kind) != "").otherwise(kind != "VOID"), F.lit(False))


#: Where the values of a setting stand; a section stands before what is in it.
_PATHS = ("target", "trigger", "images", "engine", "interval", "voting", "dictionaries", "target.bundle", "target.windowId", "target.label",
          "trigger.modifier", "trigger.mode", "trigger.hoverDelayMs", "voting.passes", "voting.everyN")


def sanitize_settings(rows: DataFrame, text: str, current: Mapping[str, object]) -> DataFrame:
    """``rows`` with ``settings``, the accepted form of the JSON text, and ``rest``, its other keys as JSON texts.

    A section that is missing is null, so the current one goes on. Words outside their list and numbers outside their
    range (``RANGES``) or of another type fall back to ``current`` (modifier, mode, hoverDelayMs, engine, interval,
    passes, everyN). A bundle is a text or null, a window id a positive whole number or null, a label a text or
    the bundle or ``not set``. Dictionaries without a name are dropped. Sections of another shape stay in ``rest``.
    Text that is no JSON object gives nulls.
    """
    # The text is parsed once, and each value and its type are sought once; what stands below only refers to them.
    at, kind = ({p: F.col(f"_{what}{i}") for i, p in enumerate(_PATHS)} for what in ("at", "kind"))
    found = rows.withColumn("_v", F.try_parse_json(text))
    for depth in (0, 1):
        paths = {i: p for i, p in enumerate(_PATHS) if p.count(".") == depth}
        found = found.withColumns({f"_at{i}": _at(at[p.split(".")[0]] if depth else F.col("_v"), "$." + p.split(".")[-1]) for i, p in paths.items()})
        found = found.withColumns({f"_kind{i}": _kind(at[p]) for i, p in paths.items()})
    is_object = lambda path: F.coalesce(kind[path].startswith("OBJECT"), F.lit(False))
    there = lambda path: kind[path].isNotNull()
    words = {p: F.col(f"_text{i}") for i, p in enumerate(_PATHS)}
    found = found.withColumns({f"_text{i}": _text(at[p], kind[p]) for i, p in enumerate(_PATHS)})

    def number(path: str) -> Column:
        name = path.rpartition(".")[2]
        value, (low, high) = _number(at[path], kind[path]), RANGES[name]
        return F.when(value.between(low, high), value).otherwise(F.lit(float(current[name]))).alias(name)

    def word(path: str, allowed: tuple[str, ...]) -> Column:
        name = path.rpartition(".")[2]
        return F.when(words[path].isin(*allowed), words[path]).otherwise(F.lit(current[name])).alias(name)

    bundle = F.nullif(words["target.bundle"], F.lit(""))
    window = _number(at["target.windowId"], kind["target.windowId"])
    target = F.struct(bundle.alias("bundle"), F.when((window > 0) & (window == F.floor(window)), window.cast("bigint")).alias("windowId"),
                      F.coalesce(words["target.label"], bundle, F.lit("not set")).alias("label"))
    trigger = F.struct(word("trigger.modifier", MODIFIERS), word("trigger.mode", MODES), number("trigger.hoverDelayMs"))
    items = F.transform(F.try_variant_get(at["dictionaries"], "$", "array<variant>"), lambda d: F.struct(
        _at(d, "$.name").alias("name"), _at(d, "$.enabled").alias("enabled")))
    items = F.transform(items, lambda d: F.struct(F.when(_kind(d["name"]) == "STRING", F.try_variant_get(d["name"], "$", "string")).alias("name"),
                                                  d["enabled"].alias("enabled"), _kind(d["enabled"]).alias("kind")))
    listed = F.filter(items, lambda d: F.coalesce(d["name"] != "", F.lit(False)))
    dictionaries = F.transform(listed, lambda d: F.struct(d["name"].alias("name"), truthy(d["enabled"], d["kind"]).alias("enabled")))
    is_list = F.coalesce(kind["dictionaries"].startswith("ARRAY"), F.lit(False))
    settings = F.struct(
        F.when(is_object("target"), target).alias("target"), F.when(is_object("trigger"), trigger).alias("trigger"),
        F.when(there("images"), truthy(at["images"], kind["images"])).alias("images"), F.when(there("engine"), word("engine", ENGINES)).alias("engine"),
        F.when(there("interval"), number("interval")).alias("interval"),
        F.when(is_object("voting"), F.struct(number("voting.passes"), number("voting.everyN"))).alias("voting"),
        F.when(is_list, dictionaries).alias("dictionaries"))
    read = {"images": F.lit(True), "engine": F.lit(True), "interval": F.lit(True), "dictionaries": is_list,
            **{k: is_object(k) for k in ("target", "trigger", "voting")}}
    done = F.filter(F.array(*[F.when(ok, F.lit(k)) for k, ok in read.items()]), lambda k: k.isNotNull())
    rest = F.map_filter(F.from_json(F.col(text), "map<string,string>"), lambda k, _: ~F.array_contains(done, k))
    whole = F.coalesce(_kind(F.col("_v")).startswith("OBJECT"), F.lit(False))
    return found.select(*rows.columns, F.when(whole, settings).alias("settings"), F.when(whole, rest).alias("rest"))
