"""C*, M*: passages, segmentation, evaluation and dictionary tables of whole corpora."""

from pyspark.sql import functions as F

from glyphlake.catalog.records import _ITEMS, _PARAS, _bank
from glyphlake.catalog.registry import query
from glyphlake.functions.text import prefixes
from glyphlake.operators import corpus, sequence
from glyphlake.session import scratch_path


@query("m03_cells_from_runs", """
with recursive n as (select *, pos - lag(pos) over (partition by page order by pos) as step from v_profile where n > 0),
i as (select *, sum(coalesce(step > 1, true)::int) over (partition by page order by pos) as run from n),
r as (select page, run, min(pos) as a, max(pos) as b from i group by page, run),
m as (select page, run, a as top, b as low, 1 as grp from r where run = 1 union all
  select page, run, case when keep then m_top else a end, b, grp + (not keep)::int from (
    select r.page, r.run, r.a, r.b, m.top as m_top, m.grp, r.b - m.top + 1 <= 12 * 1.15 and r.a - m.low - 1 < 12 * 0.45 as keep
    from m join r on r.page = m.page and r.run = m.run + 1)),
g as (select page, grp, min(top) as top, max(low) - min(top) + 1 as h from m group by page, grp),
s as (select page, grp, top, h, greatest(1, floor(h / 12 + 0.5))::int as parts from g),
c as (select page, row_number() over (partition by page order by grp, i) - 1 as cell, top + i * (h / parts) as top, h / parts as h
  from (select *, unnest(range(parts)) as i from s)),
w as (select *, (12 * 0.9 - h) / 2 as grow, coalesce((top - lag(top + h) over o) / 2, 1e18) as above, coalesce((lead(top) over o - top - h) / 2, 1e18) as below
  from c window o as (partition by page order by cell))
select page, cell::int as cell, (case when h < 12 * 0.85 then top - least(grow, above) else top end)::double as top,
  (case when h < 12 * 0.85 then h + least(grow, above) + least(grow, below) else h end)::double as height from w""", recursive=True)
def _(t):
    runs = sequence.runs(t.v_profile, ["page"], "pos", "n", 0, 1)
    return corpus.cells_from_runs(runs, ["page"], 12.0)


@query("m05_wrap_groups", """
with l as (select doc_id, line_no, length(line) - length(regexp_extract(line, '^[^ ]*')) as r, length(regexp_extract(line, '^[^ ]*')) as n from v_lines where line <> '')
select doc_id, line_no, case when n > 12 or n = 0 then ceil((r + n) / 12) else ceil(r / 12) + (n > ceil(r / 12) * 12 - r)::int end::int as n_lines from l""")
def _(t):
    # The first word of each line comes last and carries the reading.
    word = F.regexp_extract("line", "^[^ ]*", 0)
    rest = F.expr("substring(line, length(regexp_extract(line, '^[^ ]*', 0)) + 1)")
    segments = F.array(F.struct(rest.alias("text"), F.lit(None).cast("string").alias("ruby")),
                       F.struct(word.alias("text"), F.lit("x").alias("ruby")))
    units = corpus.wrap_groups(F.col("segments"), 12)
    rows = t.v_lines.where("line <> ''").select("doc_id", "line_no", segments.alias("segments"))
    return rows.select("doc_id", "line_no", (F.try_element_at(units, F.lit(-1))["line"] + 1).alias("n_lines"))


@query("m06_pack_passages", """
with recursive l as (select doc_id, line_no, length(line) as n, line from v_lines),
p as (select doc_id, line_no, line, n as cur, 0 as passage, n >= 60 as done from l where line_no = 0
  union all select l.doc_id, l.line_no, l.line, case when done then 0 else cur end + n, passage + done::int,
    case when done then 0 else cur end + n >= [60, 90, 120, 160, 200][(passage + done::int) % 5 + 1]
  from p join l on l.doc_id = p.doc_id and l.line_no = p.line_no + 1)
select doc_id, passage, count(*) as n, md5(string_agg(line, '' order by line_no)) as text from p group by doc_id, passage
having bool_or(done) or sum(length(line)) >= 40""", recursive=True)
def _(t):
    rows = corpus.pack_passages(t.documents.select("doc_id", "text"), "doc_id", F.split("text", "\n"))
    return rows.withColumn("text", F.md5("text"))


@query("c04_evaluate", r"""
with n as (select category, regexp_replace(regexp_replace(truth, '[.]{3,}', '…', 'g'), '\s+', '', 'g') as truth,
  regexp_replace(regexp_replace(hyp, '[.]{3,}', '…', 'g'), '\s+', '', 'g') as hyp from v_cer where not starts_with(truth, '#')),
s as (select category, levenshtein(truth, hyp) as d, length(truth) as n from n where truth <> '')
select coalesce(category, 'ALL') as category, count(*) as n, sum(d)::bigint as dist, sum(d) / sum(n) as micro,
  case when category is not null then avg(d / n) end as mean from s group by rollup (category)""")
def _(t):
    return corpus.evaluate(t.v_cer, 60)


_SAMPLED = r"""
c as (select category, name, row_number() over (partition by category order by md5('7' || name), name) as i from v_cer),
n as (select name, length(truth) as size, case when starts_with(truth, '#') then '' else regexp_replace(regexp_replace(truth, '[.]{3,}', '…', 'g'), '\s+', '', 'g') end as truth,
  regexp_replace(regexp_replace(hyp, '[.]{3,}', '…', 'g'), '\s+', '', 'g') as hyp from v_cer),
d as (select category, name, case when size % 7 = 3 then 'no truth' when truth = '' then 'empty truth' when size % 11 = 5 then 'no hypothesis' end as reason, truth, hyp
  from c join n using (name) where i <= 60)"""


def _sampled(t):
    size = F.length("truth")
    return corpus.evaluate_sample(t.v_cer, t.v_cer.where(size % 7 != 3), t.v_cer.where(size % 11 != 5), 60, "7", 30)


@query("c04_evaluate_sample", rf"""
with {_SAMPLED}, s as (select category, levenshtein(truth, hyp) as d, length(truth) as n from d where reason is null)
select coalesce(category, 'ALL') as category, count(*) as n, sum(d)::bigint as dist, sum(d) / sum(n) as micro,
  case when category is not null then avg(d / n) end as mean from s group by rollup (category)""")
def _(t):
    return _sampled(t)[0]


@query("c04_missing", rf"with {_SAMPLED} select name, reason from d where reason is not null")
def _(t):
    return _sampled(t)[1]


@query("c05_build_tables", f"""
with {_ITEMS}, r as (select *, substring(word, 1, 3) as reading from i where length(word) >= 3),
k as (select *, word as key from r union all select *, reading from r where reading <> word)
select dict, count(*) as n, count(distinct key) as n_keys, count(distinct upper(word)) as n_glosses
from (select *, case when item_id % 2 = 0 then 'A' else 'B' end as dict from k) group by rollup (dict)""")
def _(t):
    label = F.when(F.col("item_id") % 2 == 0, "A").otherwise("B")
    return corpus.build_tables(_bank(t), "payload", label, "pos")[2]


@query("c06_truth_corpus", f"""
with recursive {_PARAS}, x as (select page_id, para_no, translate(replace(replace(replace(replace(replace(replace(
  regexp_replace(part, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', chr(160)), '&amp;', '&'),
  chr(8203) || chr(65279) || chr(13) || chr(10) || chr(9), '') as text from n where not regexp_matches(part, '(?i)<img\\b')),
y as (select page_id, para_no, list_filter(string_split(regexp_replace(regexp_replace(text, '([.!?])', '\\1' || chr(1), 'g'),
  chr(1) || '([")!?.])', '\\1', 'g'), chr(1)), lambda s: s <> '') as s from x where len(regexp_extract_all(text, '[a-zà-ÿ]')) >= 10),
s as (select page_id, row_number() over (partition by page_id order by para_no, i) - 1 as i, s from (select page_id, para_no, unnest(range(len(s))) as i, unnest(s) as s from y)),
q as (select page_id, i, s, length(s) as cur, 0 as passage, length(s) >= 60 as done from s where i = 0
  union all select s.page_id, s.i, s.s, case when done then 0 else cur end + length(s.s), passage + done::int,
    case when done then 0 else cur end + length(s.s) >= [60, 90, 120, 160, 200][(passage + done::int) % 5 + 1]
  from q join s on s.page_id = q.page_id and s.i = q.i + 1),
t as (select page_id, passage, string_agg(s, '' order by i) as text from q group by all having bool_or(done) or sum(length(s)) >= 40)
select page_id, passage, r::int as repeat, ((passage + r * 3) % 8)::int as variant, md5(array_to_string(list_transform(
  range((length(text) - 1) // 20 + 1), lambda i: substring(text, i * 20 + 1, 20)), chr(10))) as body, 0 as n_ruby from t, range(2) v(r)""", recursive=True)
def _(t):
    path = scratch_path(t.spark, "truth")
    corpus.write_truth(corpus.truth_corpus(t.pages, "page_id", "html", "a-zà-ÿ", ".!?", '")!?.', 8, 2, 20), "page_id", path)
    rows = corpus.read_truth(t.spark, "page_id", "bigint", path)
    return rows.select("page_id", "passage", "repeat", "variant", F.md5("body").alias("body"), F.size("ruby").alias("n_ruby"))


@query("c07_segment", """
with recursive h as (select conv_id, turn, pos, max(len) as len from v_prefix p join (select distinct key from v_dict) d on d.key = p.surface group by all),
g as (select conv_id, turn, min(pos) as pos, min_by(len, pos) as len from h group by 1, 2 union all
  select h.conv_id, h.turn, min(h.pos), min_by(h.len, h.pos) from g join h on h.conv_id = g.conv_id and h.turn = g.turn and h.pos >= g.pos + g.len group by 1, 2)
select * from g""", recursive=True)
def _(t):
    spans = t.v_query.select("conv_id", "turn", "pos", F.inline(prefixes("q")))
    hits = spans.join(t.v_dict.select(F.col("key").alias("surface")).distinct(), "surface", "left_semi")
    return corpus.segment(hits, ["conv_id", "turn"], "pos", "len")


_OPINIONS = r"""
p as (select name, case when length(truth) < 40 then 'short' else 'long' end as bucket, truth, hyp, length(truth) % 5 as asked, length(hyp) % 7 as told,
  length(name) % 4 <> 0 as ok, regexp_replace(regexp_replace(truth, '^\pP+', ''), '\pP+$', '') as a, regexp_replace(regexp_replace(hyp, '^\pP+', ''), '\pP+$', '') as b from v_cer),
m as (select * from p where told >= asked and ok)"""


def _opinions(t):
    short = F.when(F.length("truth") < 40, "short").otherwise("long")
    asked = t.v_cer.select("name", "truth", (F.length("truth") % 5).alias("asked"))
    told = t.v_cer.select("name", "hyp", (F.length("hyp") % 7).alias("told"), (F.length("name") % 4 != 0).alias("ok"))
    return corpus.second_opinion(asked, told, "name", short)


@query("c08_second_opinion", rf"""
with {_OPINIONS}
select bucket, count(*) as n, avg((truth = hyp)::int::double) as equal, avg((a = b)::int::double) as equal_bare from m group by bucket""")
def _(t):
    return _opinions(t)[0]


@query("c08_second_histogram", rf"""
with {_OPINIONS}, d as (select bucket, levenshtein(truth, hyp) as distance, 1 as n, 0 as bare from m union all select bucket, levenshtein(a, b), 0, 1 from m)
select bucket, distance::int as distance, sum(n)::bigint as n, sum(bare)::bigint as n_bare from d group by bucket, distance""")
def _(t):
    return _opinions(t)[1]


@query("c09_alignment", """
with t as (select doc_id as page_id, line_no as li, line as text from v_lines),
p as (select page_id, li as probe, substring(text, 3) as text, substring(text, 3, 6) as needle, 20 + (li % 4) * 9 as x, li * 24 + (li % 3) * 9 as y, 20 as h from t where length(text) >= 5),
a as (select * from p where (select count(*) from p o where o.page_id = p.page_id and contains(o.text, p.needle)) <= 1),
m as (select a.page_id, a.probe, h, l.li, 10 * (strpos(l.text, needle) - 1) + a.page_id % 3 - a.x as dx,
  l.li * 24 + case when l.li % 2 = 0 then 12 else 0 end - a.y as dy from a join t l on l.page_id = a.page_id and contains(l.text, needle)),
b as (select page_id, probe, h, min_by(dx, (abs(dx) + abs(dy), li)) as dx, min_by(dy, (abs(dx) + abs(dy), li)) as dy from m group by all)
select page_id, probe, dx, dy::int as dy, abs(dx) <= 12 and abs(dy) <= greatest(10, h * 0.45) as aligned,
  not (abs(dx) <= 12 and abs(dy) <= greatest(10, h * 0.45)) and (abs(dx) > 30 or abs(dy) > 30) as gross from b""", paged=True)
def _(t):
    lines = t.v_lines.select(F.col("doc_id").alias("page_id"), F.col("line_no").alias("li"), F.col("line").alias("text"))
    li = F.col("li")
    probes = lines.select("page_id", li.alias("probe"), F.expr("substring(text, 3)").alias("text"),
                          (li % 4 * 9 + 20).alias("x"), (li * 24 + li % 3 * 9).alias("y"), F.lit(20).alias("h"))
    return corpus.alignment(probes, lines, t.v_glyph, ["page_id"])


@query("c10_lossless", """
with o as (select p_partkey, replace(p_name, ' ', '') as s, replace(p_name, ' ', '') || p_type as t, p_size from part),
k as (select p_partkey, s, case when p_size % 3 = 0 then reverse(t) else regexp_replace(t, '[xyz]', '_', 'g') end as t from o)
select p_partkey, regexp_matches(t, array_to_string(string_split(s, ''), '.*')) as kept from k where length(s) >= 2""")
def _(t):
    joined = F.concat("p_name", "p_type")
    new = t.part.select("p_partkey", F.when(F.col("p_size") % 3 == 0, F.reverse(joined)).otherwise(
        F.regexp_replace(joined, "[xyz]", "_")).alias("text"))
    old = t.part.select("p_partkey", F.col("p_name").alias("sense"))
    return corpus.lossless(old, new, "p_partkey").drop("sense")
