"""Suffix rules for inflected forms, undone one step at a time over distinct surfaces.

A rule (suffix_in, suffix_out, type_in, type_out, step) undoes one step: a word
that ends in ``suffix_in`` and is of ``type_in`` comes from one that ends in
``suffix_out`` and is of ``type_out``. The word on the page has no type yet, so
any rule may come first. Every step is one equi join of all forms found in the
step before with the rules, on suffix and type.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphlake.session import cut


class Rule(NamedTuple):
    suffix_in: str
    suffix_out: str
    type_in: str
    type_out: str
    step: str


# Godan endings with their a, i, e and o rows and their te and ta forms.
GODAN = (
    ("う", "わ", "い", "え", "お", "って", "った"), ("く", "か", "き", "け", "こ", "いて", "いた"),
    ("ぐ", "が", "ぎ", "げ", "ご", "いで", "いだ"), ("す", "さ", "し", "せ", "そ", "して", "した"),
    ("つ", "た", "ち", "て", "と", "って", "った"), ("ぬ", "な", "に", "ね", "の", "んで", "んだ"),
    ("ぶ", "ば", "び", "べ", "ぼ", "んで", "んだ"), ("む", "ま", "み", "め", "も", "んで", "んだ"),
    ("る", "ら", "り", "れ", "ろ", "って", "った"),
)


def japanese_rules() -> list[Rule]:
    """Rules from published grammar: stems by verb class, then what attaches to each stem."""
    rules: list[Rule] = []

    def add(i, o, ti, to, step):
        rules.append(Rule(i, o, ti, to, step))

    # What a stem plus ending is, as a word class of its own.
    for end, a, i, e, o, te, ta in GODAN:
        add(te, end, "te", "v5", "て・で Form")
        add(ta, end, "past", "v5", "Plain Past")
        add(a, end, "neg-stem", "v5", "")
        add(i, end, "masu-stem", "v5", "ます Stem")
        add(e + "ば", end, "", "v5", "ば Conditional")
        add(e, end, "imperative", "v5", "Imperative")
        add(o + "う", end, "", "v5", "Volitional")
        add(e + "る", end, "v1", "v5", "Potential Form")
        add(a + "れる", end, "v1", "v5", "Passive Form")
        add(a + "せる", end, "v1", "v5", "Causative Form")
    for i, o, ti, step in (("て", "る", "te", "て・で Form"), ("た", "る", "past", "Plain Past"),
                           ("", "る", "neg-stem", ""), ("", "る", "masu-stem", "ます Stem"),
                           ("れば", "る", "", "ば Conditional"), ("ろ", "る", "imperative", "Imperative"),
                           ("よう", "る", "", "Volitional"), ("られる", "る", "v1", "Potential Or Passive"),
                           ("させる", "る", "v1", "Causative Form")):
        add(i, o, ti, "v1", step)
    for base, kind in (("する", "vs"), ("くる", "vk"), ("来る", "vk")):
        stem = {"する": ("し", "し", "され", "させ"), "くる": ("き", "こ", "こられ", "こさせ"),
                "来る": ("来", "来", "来られ", "来させ")}[base]
        add(stem[0] + "て", base, "te", kind, "て・で Form")
        add(stem[0] + "た", base, "past", kind, "Plain Past")
        add(stem[1], base, "neg-stem", kind, "")
        add(stem[0], base, "masu-stem", kind, "ます Stem")
        add(stem[2] + "る", base, "v1", kind, "Passive Form")
        add(stem[3] + "る", base, "v1", kind, "Causative Form")
    for i, ti, step in (("かった", "", "Plain Past"), ("く", "adv", "Adverbial"), ("くて", "", "て・で Form"),
                        ("ければ", "", "ば Conditional"), ("くない", "adj-i", "ない Negative"), ("さ", "", "さ Noun"),
                        ("そう", "", "そう Appearance")):
        add(i, "い", ti, "adj-i", step)
    # What attaches to a stem class.
    for i, o, ti, to, step in (
            ("ない", "", "adj-i", "neg-stem", "ない Negative"), ("ず", "", "", "neg-stem", "ず Negative"),
            ("ぬ", "", "", "neg-stem", "ぬ Negative"),
            ("ます", "", "masu", "masu-stem", "ます Polite"), ("たい", "", "adj-i", "masu-stem", "たい Desire"),
            ("ながら", "", "", "masu-stem", "ながら While"), ("そう", "", "", "masu-stem", "そう Appearance"),
            ("すぎる", "", "v1", "masu-stem", "すぎる Excess"),
            ("ました", "ます", "", "masu", "Plain Past"), ("ません", "ます", "", "masu", "ない Negative"),
            ("ましょう", "ます", "", "masu", "Volitional"),
            ("いる", "", "v1", "te", "ている・でいる Continuing State/Result"),
            ("る", "", "v1", "te", "ている・でいる Continuing State/Result"),
            ("ある", "", "v5", "te", "てある Result"), ("おく", "", "v5", "te", "ておく Preparation"),
            ("しまう", "", "v5", "te", "てしまう Completion"), ("くる", "", "vk", "te", "てくる Approach"),
            ("いく", "", "v5", "te", "ていく Departure"), ("みる", "", "v1", "te", "てみる Attempt"),
            ("ら", "", "", "past", "たら Conditional"), ("り", "", "", "past", "たり Listing")):
        add(i, o, ti, to, step)
    # Irregular forms and contractions.
    for i, o, ti, to, step in (
            ("行って", "行く", "te", "v5", "て・で Form"), ("行った", "行く", "past", "v5", "Plain Past"),
            ("しろ", "する", "imperative", "vs", "Imperative"), ("せよ", "する", "imperative", "vs", "Imperative"),
            ("しよう", "する", "", "vs", "Volitional"), ("すれば", "する", "", "vs", "ば Conditional"),
            ("来い", "来る", "imperative", "vk", "Imperative"), ("こい", "くる", "imperative", "vk", "Imperative"),
            ("来よう", "来る", "", "vk", "Volitional"), ("こよう", "くる", "", "vk", "Volitional"),
            ("来れば", "来る", "", "vk", "ば Conditional"), ("くれば", "くる", "", "vk", "ば Conditional"),
            ("よかった", "いい", "", "adj-i", "Plain Past"), ("よく", "いい", "adv", "adj-i", "Adverbial"),
            ("よくない", "いい", "adj-i", "adj-i", "ない Negative"), ("よければ", "いい", "", "adj-i", "ば Conditional"),
            ("なさい", "", "", "masu-stem", "なさい Command"),
            ("ちゃう", "て", "v5", "te", "てしまう Completion"), ("じゃう", "で", "v5", "te", "てしまう Completion")):
        add(i, o, ti, to, step)
    return rules


# A stem class is a part of a word, never a word on its own.
PARTS = frozenset({"te", "past", "neg-stem", "masu-stem", "imperative", "adv", "masu"})


def base_forms(surfaces: DataFrame, rules: Iterable[Rule], parts: Iterable[str] = PARTS,
               rounds: int = 12, surface: str = "surface") -> DataFrame:
    """(surface, form, type, steps, route): every base form of each distinct surface, and the surface itself.

    Fails if rules still apply after ``rounds`` of them were undone one after another;
    no Japanese word stacks that many. Rules without a name are not counted as steps. Per
    form and type the shortest route is kept, ties by its names. Null and empty
    surfaces have no forms.
    """
    rules = list(dict.fromkeys(rules))
    table = surfaces.sparkSession.createDataFrame(
        rules, "suffix_in string, suffix_out string, type_in string, type_out string, step string")
    longest = max((len(r.suffix_in) for r in rules), default=0)
    start = surfaces.select(F.col(surface).alias("surface")).where(F.length("surface") > 0).distinct().select(
        "surface", F.col("surface").alias("form"), F.lit("").alias("type"), F.lit(0).alias("steps"),
        F.array().cast("array<string>").alias("route"))
    def shortest(rows):
        return rows.groupBy("surface", "form", "type").agg(F.min(F.struct("steps", "route")).alias("b")).select(
            "surface", "form", "type", "b.*")

    edge = found = cut(start)
    for _ in range(rounds):
        ends = F.sequence(F.lit(0), F.least(F.lit(longest), F.length("form")))
        open_ = edge.select("*", F.explode(F.transform(ends, lambda n: F.right("form", n))).alias("suffix_in"))
        starts = F.col("type") == ""
        # The rules are a parameter, so their table may be broadcast.
        met = open_.join(F.broadcast(table), "suffix_in").where(starts | (F.col("type") == F.col("type_in")))
        named = F.col("step") != ""
        new = met.select(
            "surface", F.concat(F.left("form", F.length("form") - F.length("suffix_in")), "suffix_out").alias("form"),
            F.col("type_out").alias("type"), (F.col("steps") + named.cast("int")).alias("steps"),
            F.when(named, F.concat("route", F.array("step"))).otherwise(F.col("route")).alias("route"))
        best = shortest(new.where("form <> ''"))
        known = shortest(found).select("surface", "form", "type", F.struct("steps", "route").alias("old"))
        edge = cut(best.join(known, ["surface", "form", "type"], "left").where(
            F.col("old").isNull() | (F.struct("steps", "route") < F.col("old"))).drop("old"))
        if edge.isEmpty():
            break
        found = found.unionByName(edge)  # both are written, so the plan stays a union of scans
    else:
        raise ValueError(f"rules still apply after {rounds} rounds")
    found = shortest(found)
    return found.where(~F.col("type").isin(*parts)) if parts else found


def inflected(forms: DataFrame, rules: Iterable[Rule], longest: int, parts: Iterable[str] = PARTS, rounds: int = 12,
              form: str = "form") -> DataFrame:
    """(surface, form, steps): every surface of at most ``longest`` characters whose base forms hold one of ``forms``.

    The rows of ``base_forms`` for these forms, found from their side: rules are applied to the forms, once for a
    whole dictionary, in place of being undone at every place of a text. ``steps`` is that of the shortest route.
    Fails if longer surfaces that may become short again are left after ``rounds`` rules.
    """
    rules = list(dict.fromkeys(rules))
    table = forms.sparkSession.createDataFrame(
        rules, "suffix_in string, suffix_out string, type_in string, type_out string, step string")
    ending = max((len(r.suffix_out) for r in rules), default=0)
    shrink = max((len(r.suffix_out) - len(r.suffix_in) for r in rules), default=0)
    most = longest + max(0, shrink) * rounds

    def shortest(rows):
        return rows.groupBy("form", "surface", "type").agg(F.min("steps").alias("steps"))

    # A word as it stands in the dictionary may be of any type but a part of a word.
    any_type = "\u0000"
    start = forms.select(F.col(form).alias("form")).where((F.length("form") > 0) & (F.length("form") <= most)).distinct().select(
        "form", F.col("form").alias("surface"), F.lit(any_type).alias("type"), F.lit(0).alias("steps"))
    edge = found = cut(start)
    for _ in range(rounds):
        ends = F.sequence(F.lit(0), F.least(F.lit(ending), F.length("surface")))
        open_ = edge.select("*", F.explode(F.transform(ends, lambda n: F.right("surface", n))).alias("suffix_out"))
        fits = F.when(F.col("type") == any_type, ~F.col("type_out").isin(*parts) if parts else F.lit(True)).otherwise(F.col("type") == F.col("type_out"))
        new = open_.join(F.broadcast(table), "suffix_out").where(fits).select(
            "form", F.concat(F.left("surface", F.length("surface") - F.length("suffix_out")), "suffix_in").alias("surface"),
            F.col("type_in").alias("type"), (F.col("steps") + (F.col("step") != "").cast("int")).alias("steps"))
        best = shortest(new.where((F.col("surface") != "") & (F.length("surface") <= most)))
        known = shortest(found).withColumnRenamed("steps", "old")
        edge = cut(best.join(known, ["form", "surface", "type"], "left").where(
            F.col("old").isNull() | (F.col("steps") < F.col("old"))).drop("old"))
        if edge.isEmpty():
            break
        found = found.unionByName(edge)
    else:
        raise ValueError(f"rules still apply after {rounds} rounds")
    return found.where(F.length("surface") <= longest).groupBy("surface", "form").agg(F.min("steps").alias("steps"))
