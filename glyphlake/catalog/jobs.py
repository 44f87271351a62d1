"""C*: whole jobs."""

from pyspark.sql import functions as F

from glyphlake.catalog.registry import query
from glyphlake.functions import fixed
from glyphlake.functions.inflection import Rule, base_forms, inflected
from glyphlake.functions.text import prefixes
from glyphlake.operators import lookup
from glyphlake.session import cut

# The given tables hold invented European prose, so European endings stand in.
ENDINGS = (
    Rule("ing", "", "", "v", "ing"), Rule("ed", "", "", "v", "ed"), Rule("ly", "", "", "adj", "ly"),
    Rule("s", "", "", "n", ""), Rule("tion", "t", "n", "v", "tion"), Rule("er", "", "v", "v0", "er"),
    Rule("ment", "", "", "v", "ment"), Rule("en", "", "v", "v0", "en"), Rule("th", "", "adj", "adj0", "th"),
)
_RULES = ", ".join(f"('{a}', '{b}', '{c}', '{d}', '{e}')" for a, b, c, d, e in ENDINGS)
_FORMS = f"""
r(i, o, ti, t_out, step) as (values {_RULES}),
f as (select distinct surface, surface as form, '' as type, 0 as steps from s
  union select surface, left(form, length(form) - length(i)) || o, t_out, steps + (step <> '')::int
  from f join r on ends_with(form, i) and (type = '' or type = ti) where length(form) > length(i) or o <> ''),
forms as (select surface, form, type, min(steps)::int as steps from f group by all)"""


@query("c01_base_forms", f"with recursive s as (select distinct word as surface from v_tokens), {_FORMS} select * from forms", recursive=True)
def _(t):
    return base_forms(t.v_tokens.select(F.col("word").alias("surface")), ENDINGS, ()).drop("route")


@query("c02_annotate", f"""
with recursive s as (select distinct surface from v_prefix), {_FORMS},
hits as (select p.conv_id, p.turn, p.pos, p.len, f.form, f.steps, max(d.score) as score from v_prefix p
  join forms f on f.surface = p.surface join v_dict d on d.key = f.form and d.dict <> 'd1' group by all),
one as (select *, row_number() over (partition by conv_id, turn, pos, form order by len desc, steps) as n from hits)
select conv_id, turn, pos, len, form, steps, score from (select *, row_number() over (partition by conv_id, turn, pos
  order by len desc, steps, score desc, form) as g from one where n = 1) where g = 1""", recursive=True)
def annotate(t):
    """The best dictionary entry at every position of every turn: longest, fewest steps, best score."""
    keys = ["conv_id", "turn", "pos"]
    spans = t.v_query.select(*keys, F.inline(prefixes("q")))
    shown = lookup.group_score(lookup.visible(t.v_dict, t.v_prefs), ["key"]).withColumnRenamed("key", "form")
    # The dictionary is inflected once.
    known = cut(inflected(shown.select("form"), ENDINGS, fixed.MAX_MATCH, ()).join(shown, "form"))
    hits = lookup.probe_spans(spans, known, "surface").withColumn("ci", F.col("steps")).withColumn("min_freq", F.lit(None).cast("bigint"))
    groups = lookup.keep_longest(hits.drop("surface"), keys)
    return lookup.best_match(groups, keys).select(*keys, "len", "form", "steps", "score")
