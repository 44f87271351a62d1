"""W*, T*: operators along the order of events and lines."""

from pyspark.sql import functions as F

from glyphlake.catalog.registry import query
from glyphlake.operators import sequence

KEY, ORDER = ["user_id"], ["us", "event_id"]
_OVER = "over (partition by user_id order by us, event_id)"


@query("w03_latest_import", """
select max_by(page_id, page_id) as page_id, title from (select page_id, regexp_extract(html, '<title>([^<]*)', 1) as title from pages)
where title <> '' group by title union all
select page_id, '' from (select page_id, regexp_extract(html, '<title>([^<]*)', 1) as title from pages) where title = ''""")
def _(t):
    rows = t.pages.select("page_id", F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"))
    return sequence.latest_import(rows, "title", ["page_id"])


@query("w04_runs", """
with i as (select page, pos, coalesce(pos - lag(pos) over (partition by page order by pos) > 2, true)::int as new from v_profile where n > 1),
r as (select *, sum(new) over (partition by page order by pos) as run from i)
select page, min(pos) as start, max(pos) as end from r group by page, run""")
def _(t):
    return sequence.runs(t.v_profile, ["page"], "pos", "n", 1, 2)


@query("w07_press_edges", f"""
select event_id from (select event_id, event_type = 'click' as on_, lag(event_type = 'click') {_OVER} as was from v_events)
where on_ and not coalesce(was, false)""")
def _(t):
    return sequence.press_edges(t.v_events, KEY, ORDER, F.col("event_type") == "click").select("event_id")


@query("w08_changes_only", f"""
select event_id from (select event_id, event_type, lag(event_type) {_OVER} as was, row_number() {_OVER} as n from v_events)
where n = 1 or event_type is distinct from was""")
def _(t):
    return sequence.changes_only(t.v_events, KEY, ORDER, "event_type").select("event_id")


@query("w09_dwell", f"""
select event_id from (select event_id, us, lead(us) {_OVER} as next from v_events) where next is null or next - us >= 60000000""")
def _(t):
    return sequence.dwell(t.v_events, KEY, ORDER, "us", 60_000_000).select("event_id")


@query("w10_silence_gaps", f"""
select user_id, us as start, next as end, next - us as gap from (select user_id, us, lead(us) {_OVER} as next from v_events)
where next - us >= 120000000""")
def _(t):
    return sequence.silence_gaps(t.v_events, KEY, ORDER, "us", 120_000_000)


@query("w11_sample_failures", f"""
with o as (select *, sum((event_type in ('click', 'purchase'))::int) {_OVER} as run from v_events),
f as (select event_id, row_number() over (partition by user_id, run order by us, event_id) as nth from o where event_type not in ('click', 'purchase'))
select event_id, nth from f where nth = 1 or nth % 10 = 0""")
def _(t):
    failed = ~F.col("event_type").isin("click", "purchase")
    return sequence.sample_failures(t.v_events, KEY, ORDER, failed).select("event_id", "nth")


@query("w12_carry_section", """
with m as (select doc_id, line_no, case when length(line) <= 30 then line_no end as h, line from v_lines),
c as (select doc_id, line_no, max(h) over (partition by doc_id order by line_no) as h from m)
select c.doc_id, c.line_no, case when l.line like '%a%' then substring(l.line, 1, 1) end as section
from c left join v_lines l on l.doc_id = c.doc_id and l.line_no = c.h""")
def _(t):
    heading = F.length("line") <= 30
    section = F.when(F.col("line").contains("a"), F.substring("line", 1, 1))
    return sequence.carry_section(t.v_lines, ["doc_id"], ["line_no"], heading, section).select("doc_id", "line_no", "section")


@query("w15_assign_variants", "select doc_id, r::int as repeat, ((doc_id + r * 3) % 8)::int as variant from documents cross join range(2) t(r)")
def _(t):
    return sequence.assign_variants(t.documents.select("doc_id"), "doc_id", 8, 2)


@query("w16_skip_unchanged", """
select conv_id, turn from (select conv_id, turn, text, lag(text) over (partition by conv_id order by turn) as was,
  row_number() over (partition by conv_id order by turn) as n from conversations) where n = 1 or text is distinct from was""")
def _(t):
    return sequence.skip_unchanged(t.conversations, ["conv_id"], ["turn"], "text").select("conv_id", "turn")


@query("t05_latest_only", """
select event_id from (select event_id, value, max(value) over (partition by user_id order by us, event_id) as top from v_events) where value >= top""")
def _(t):
    return sequence.latest_only(t.v_events, KEY, ORDER, "value").select("event_id")


@query("t11_sessions", f"""
with n as (select *, coalesce(us - lag(us) {_OVER} >= 3600000000, true)::int as new from v_events),
r as (select *, sum(new) {_OVER} as run from n)
select user_id, min(us) as start, max(us) as end, count(*) as n from r group by user_id, run""")
def _(t):
    return sequence.sessions(t.v_events, KEY, ORDER, "us", 3_600_000_000)


@query("j14_as_of", """
select event_id, user_id, us, (select max_by(p.value, (p.us, p.event_id)) from v_events p where p.user_id = e.user_id
  and p.event_type = 'purchase' and p.us <= e.us) as value from v_events e where event_type = 'click'""")
def _(t):
    clicks = t.v_events.where("event_type = 'click'").select("event_id", "user_id", "us")
    layers = t.v_events.where("event_type = 'purchase'").select("user_id", "us", "value")
    return sequence.as_of(clicks, layers, KEY, "us", "value")


@query("j15_correlate", """
with a as (select distinct o_orderkey as k, (o_orderkey * 7) % 5 as asked from orders),
b as (select distinct l_orderkey as k, l_linenumber::bigint as told, (l_orderkey + l_linenumber) % 4 <> 0 as ok from lineitem),
m as (select k, asked, min(told) filter (told >= asked) as told, min_by(ok, told) filter (told >= asked) as ok from a left join b using (k) group by k, asked)
select k, asked, told, told - asked as latency from m where told is null or ok""")
def _(t):
    key = F.col("l_orderkey")
    asked = t.orders.select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") * 7 % 5).alias("asked")).distinct()
    told = t.lineitem.select(key.alias("k"), F.col("l_linenumber").cast("bigint").alias("told"), ((key + F.col("l_linenumber")) % 4 != 0).alias("ok")).distinct()
    return sequence.correlate(asked, told, ["k"])
