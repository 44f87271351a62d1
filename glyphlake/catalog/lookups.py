"""P*, J*, A*, W*, K*: lookup, ranking and grouping of dictionary entries."""

from pyspark.sql import functions as F

from glyphlake.catalog.registry import query
from glyphlake.operators import lookup

_RANKED = ("(select e.*, case when p.enabled then p.ord else 2147483647 end as rank from v_entries e "
           "left join v_prefs p on p.name = e.dict)")


@query("p01_visible", "select key, gloss_key, dict from v_dict where dict not in (select name from v_prefs where not enabled)")
def _(t):
    return lookup.visible(t.v_dict, t.v_prefs).select("key", "gloss_key", "dict")


@query("p02_no_fragments", """
select key, gloss_key from (select key, gloss_key, substring(gloss_key, 1, 2) as g, substring(reading, 1, 2 + (length(gloss_key) % 2)::int) as r
  from v_dict) where not (length(g) <= 2 and g = r)""")
def _(t):
    rows = t.v_dict.select("key", "gloss_key", F.array(F.substring("gloss_key", 1, 2)).alias("glosses"),
                           F.left("reading", 2 + F.length("gloss_key") % 2).alias("reading"))
    return lookup.drop_fragments(rows).select("key", "gloss_key")


@query("j01_probe_terms", "select doc_id, t.pos, word as form, gloss_key, dict from v_tokens t join v_dict d on word = key")
def _(t):
    cands = t.v_tokens.select("doc_id", "pos", F.col("word").alias("form"))
    return lookup.probe_terms(cands, t.v_dict.drop("pos")).select("doc_id", "pos", "form", "gloss_key", "dict")


@query("j02_with_gloss", "select key, d.gloss_key, gloss_json from v_dict d join v_gloss g on d.gloss_key = g.gloss_key")
def _(t):
    return lookup.with_gloss(t.v_dict, t.v_gloss).select("key", "gloss_key", "gloss_json")


@query("j03_attach_pitch", """
select k.key, reading as pitch_reading, position, n::int as pitch_no from (select distinct key from v_dict) k left join
  (select *, row_number() over (partition by term order by reading, position) as n from v_pitch) p on k.key = p.term and n <= 4""")
def _(t):
    return lookup.attach_pitch(t.v_dict.select("key").distinct(), t.v_pitch)


@query("j04_freq_summary", """
select term, min_by(value, (value, source)) as min_freq, count(*) as n_freq,
  string_agg(source || '=' || value, ' ' order by value, source) as freqs from v_freq group by term""")
def _(t):
    return lookup.freq_summary(t.v_freq, t.v_prefs).withColumn("freqs", F.array_join(
        F.transform("freqs", lambda f: F.concat(f["source"], F.lit("="), f["value"].cast("string"))), " "))


@query("k04_top_freq", """
select term, source, value, n::int as chip_no from (select *, row_number() over (partition by term order by value, source) as n
  from v_freq) where n <= 2""")
def _(t):
    return lookup.top_freq(t.v_freq, t.v_prefs).select("term", "source", "value", "chip_no")


@query("j05_char_fallback", """
with q as (select conv_id, turn, pos, substring(q, 1, 1) as char from v_query where substring(q, 1, 3) not in (select key from v_dict)),
k as (select char, min_by(struct_pack(on_yomi, dict, meanings), (case when dict = 'd0' then 0 else 2147483647 end, dict, on_yomi, meanings)) as k
  from v_char where dict <> 'd1' group by char)
select conv_id, turn, pos, q.char, k.on_yomi as reading, k.dict as dict, k.meanings[1] as gloss from q join k on q.char = k.char""")
def _(t):
    keys = ["conv_id", "turn", "pos"]
    three = t.v_query.withColumn("key", F.substring("q", 1, 3))
    # The table of words decides, not a join of the positions with themselves.
    unmatched = lookup.unknown_words(three, t.v_dict, "key")
    return lookup.char_fallback(unmatched, None, t.v_char, t.v_prefs, keys).select(
        *keys, "char", "reading", "dict", F.col("glosses")[0].alias("gloss"))


@query("j06_known_words", "select distinct word, word in (select key from v_dict) as known from v_tokens")
def _(t):
    words = t.v_tokens.select("word").distinct()
    return (lookup.known_words(words, t.v_dict).withColumn("known", F.lit(True))
            .unionByName(lookup.unknown_words(words, t.v_dict).withColumn("known", F.lit(False))))


@query("j23_enrich_rank", """
select doc_id, pos, word, value from v_tokens t left join v_freq f on t.word = f.term and t.lang = f.source""")
def _(t):
    freq = t.v_freq.select(F.col("term").alias("word"), F.col("source").alias("lang"), "value")
    return lookup.enrich_rank(t.v_tokens, freq, ["word", "lang"]).select("doc_id", "pos", "word", "value")


@query("a05_group_score", "select key, coalesce(max(score), 0) as score from v_dict group by key")
def _(t):
    return lookup.group_score(t.v_dict, ["key"])


@query("a21_name_readings", """
with w as (select key, pos, gloss_key, unnest([1, 2]) as i, unnest([reading, gloss_key]) as w from v_dict),
f as (select key, w, min((gloss_key, i)) as place from w group by key, w),
n as (select *, row_number() over (partition by key order by place) as n from f)
select key, string_agg(w, '、' order by place) as readings from n where n <= 24 group by key""")
def _(t):
    rows = t.v_dict.select("key", F.concat("reading", F.lit("、 "), "gloss_key", F.lit("、")).alias("text"), "gloss_key")
    return lookup.name_readings(rows, ["key"], "text", "gloss_key")


@query("a22_group_by_reading", """
select key, false as is_name, reading, min(no) as first_no, count(*) as n, max(score) as top_score from (select *,
  row_number() over (partition by key order by gloss_key) as no from v_entries) group by key, reading""")
def _(t):
    from glyphlake.ordered import Ordered
    rows = Ordered(t.v_entries, ["key"], ["gloss_key"], bounded=True).scan(number="entry_no").df
    return lookup.group_by_reading(rows, ["key"])


@query("k01_rank_entries", f"""
select key, gloss_key, row_number() over (partition by key order by rank, score desc, pos, gloss_key) as entry_no from {_RANKED}""")
def _(t):
    return lookup.rank_entries(t.v_entries, t.v_prefs, ["key"]).select("key", "gloss_key", "entry_no")


@query("w02_fair_order", f"""
with e as (select key, gloss_key, dict, row_number() over (partition by key order by rank, score desc, pos, gloss_key) as entry_no from {_RANKED}),
n as (select *, row_number() over (partition by key, dict order by entry_no) > 2 as late from e)
select key, gloss_key, row_number() over (partition by key order by late, entry_no) as show_no from n""")
def _(t):
    ranked = lookup.rank_entries(t.v_entries, t.v_prefs, ["key"])
    return lookup.fair_order(ranked, ["key"]).select("key", "gloss_key", "show_no")


@query("k05_shown_pitch", """
select key, reading, position, n::int as accent_no from (select term as key, reading, position,
  row_number() over (partition by term, reading order by position) as n from v_pitch) where n <= 4""")
def _(t):
    return lookup.shown_pitch(t.v_dict.select("key", "reading"), t.v_pitch).select("key", "reading", "position", "accent_no")


@query("k06_order_by_kind", f"""
with e as (select key, dict, gloss_key, row_number() over (partition by key order by rank, score desc, pos, gloss_key) as no from {_RANKED})
select key, gloss_key, 'bi' as kind, row_number() over (partition by key order by no) as kind_no from e""")
def _(t):
    ranked = lookup.rank_entries(t.v_entries, t.v_prefs, ["key"])
    return lookup.order_by_kind(ranked, ["key"]).select("key", "gloss_key", "kind", "kind_no")


_HITS = """select conv_id, turn, p.pos, len, d.reading as form, min(score) as score, max(length(gloss_key)) as long
  from v_prefix p join v_dict d on surface = d.key group by all"""


def _hits(t):
    from glyphlake.functions.text import prefixes
    keys = ["conv_id", "turn", "pos"]
    rows = t.v_query.select(*keys, F.inline(prefixes("q")))
    return rows.join(t.v_dict.select(F.col("key").alias("surface"), "reading", "score", "gloss_key"), "surface").groupBy(
        *keys, "len", F.col("reading").alias("form")).agg(
        F.min("score").alias("score"), F.max(F.length("gloss_key")).alias("long"))


@query("w01_keep_longest", f"""
select conv_id, turn, pos, form, max(len) as len from ({_HITS}) group by all""")
def _(t):
    rows = _hits(t).withColumn("ci", F.lit(0))
    return lookup.keep_longest(rows, ["conv_id", "turn", "pos"]).select("conv_id", "turn", "pos", "form", "len")


_GROUPS = f"select h.*, (len + long) % 3 as ci, f.value as min_freq from ({_HITS}) h left join v_freq f on f.term = form and f.source = 'en'"


def _groups(t):
    freq = t.v_freq.where("source = 'en'").select(F.col("term").alias("form"), F.col("value").alias("min_freq"))
    return _hits(t).join(freq, "form", "left").withColumn("ci", (F.col("len") + F.col("long")) % 3)


@query("k02_rank_groups", f"""
select conv_id, turn, pos, len, form, (row_number() over (partition by conv_id, turn, pos
  order by len desc, ci, min_freq nulls last, score desc, form))::int as group_no from ({_GROUPS})""")
def _(t):
    return lookup.rank_groups(_groups(t), ["conv_id", "turn", "pos"]).select("conv_id", "turn", "pos", "len", "form", "group_no")


@query("k03_best_match", f"""
select conv_id, turn, pos, len, form, score from (select *, row_number() over (partition by conv_id, turn, pos
  order by len desc, ci, min_freq nulls last, score desc, form) as n from ({_GROUPS})) where n = 1""")
def _(t):
    return lookup.best_match(_groups(t), ["conv_id", "turn", "pos"]).select("conv_id", "turn", "pos", "len", "form", "score")


@query("k07_order_candidates", """
select doc_id, pos, form, (row_number() over (partition by doc_id, pos order by steps, form) - 1)::int as ci from (select doc_id, pos,
  word as form, 0 as steps from v_tokens union all select doc_id, pos, word || 'e', 1 from v_tokens)""", paged=True)
def _(t):
    # Texts are dealt before they are spelled out; a word's candidates are made where it lies.
    forms = [F.struct(F.col("word").alias("form"), F.lit(0).alias("steps")),
             F.struct(F.concat("word", F.lit("e")).alias("form"), F.lit(1).alias("steps"))]
    cands = t.v_tokens.select("doc_id", "pos", F.inline(F.array(*forms)))
    return lookup.order_candidates(cands, ["doc_id", "pos"]).select("doc_id", "pos", "form", "ci")


@query("k11_first_senses", """
with l as (select doc_id, line_no, regexp_replace(line, '^\\s+|\\s+$', '', 'g') as line from v_lines),
f as (select doc_id, line, min(line_no) as place from l where line <> '' group by doc_id, line),
n as (select *, row_number() over (partition by doc_id order by place) as n from f)
select doc_id, string_agg(line, '|' order by place) as senses from n where n <= 8 group by doc_id""".replace("\\\\", "\\"))
def _(t):
    from glyphlake.functions.text import first_senses
    return t.documents.select("doc_id", F.array_join(first_senses(F.split("text", "\n")), "|").alias("senses")).where("senses <> ''")
