"""T*: streams over the event table, run through once."""

from pyspark.sql import functions as F

from glyphlake.catalog.registry import query
from glyphlake.session import scratch_path
from glyphlake.streaming import events as stream
from glyphlake.streaming import pages as reads
from glyphlake.streaming import state


def _events(t):
    kinds = t.events.schema
    rows = t.spark.readStream.schema(kinds).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


@query("t11_stream_sessions", """
with n as (select *, coalesce(us - lag(us) over (partition by user_id order by us, event_id) >= 3600000000, true)::int as new from v_events),
r as (select *, sum(new) over (partition by user_id order by us, event_id) as run from n)
select user_id, min(us) as start, max(us) as end, count(*) as n from r group by user_id, run
having max(us) + 3600000000 <= (select (max(us) // 1000) * 1000 - 60000000 from v_events)""")
def _(t):
    rows = stream.stream_sessions(_events(t), "user_id", "ts", "1 hour", "1 minute")
    done = stream.run_through(rows, scratch_path(t.spark, "sessions"), scratch_path(t.spark, "sessions-state"))
    return done.select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n")


def _slices(t, rows, order, name, n=4):
    """``rows`` as a stream of ``n`` micro-batches or more, one after the other in the order of ``order``."""
    path = scratch_path(t.spark, name)
    edges = rows.stat.approxQuantile(order, [i / n for i in range(1, n)], 0.01)
    bounds = [None, *sorted(set(edges)), None]
    for low, high in zip(bounds, bounds[1:]):
        part = rows
        if low is not None:
            part = part.where(F.col(order) > low)
        if high is not None:
            part = part.where(F.col(order) <= high)
        # One file is one micro-batch; files are taken in the order in which they were written. One task writes a slice, but what
        # it is made of is worked out by many before; a slice too long for one file goes on in the next in order.
        part.repartition(1).sortWithinPartitions(order).write.mode("append").option("maxRecordsPerFile", 5_000_000).parquet(path)
    return t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query("t10_stream_correlate", """
with q as (select event_id as id, us as asked from v_events where event_id % 3 = 0),
r as (select event_id - event_id % 3 as id, us, event_type <> 'error' as ok from v_events where event_id % 3 <> 0),
m as (select id, asked, min(us) as told, min_by(ok, (us, not ok)) as ok from q left join r using (id) where us is null or us >= asked group by all),
f as (select q.id, q.asked, told, ok from q left join m using (id))
select id, asked, case when told - asked <= 7200000000 then told end as told, case when told - asked <= 7200000000 then told - asked end as latency,
  told is null or told - asked > 7200000000 as expired from f
where (told - asked <= 7200000000 and ok) or told - asked > 7200000000 or (told is null and asked + 7200000000 < (select max(us) from v_events))""")
def _(t):
    e = F.col("event_id")
    messages = t.v_events.select((e - e % 3).alias("id"), "us", F.when(e % 3 == 0, "request").otherwise("reply").alias("kind"),
                                 (F.col("event_type") != "error").alias("ok"))
    return _done(t, stream.correlate(_slices(t, messages, "us", "messages"), "id", 7_200_000_000), "replies")


def _timed(t):
    """All events as a stream of several micro-batches."""
    rows = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    return _slices(t, rows.withColumn("us", F.unix_micros("ts")), "us", "events")


def _texts(t, name):
    """Documents as a stream in slices; what a page is spelled out into is a hundred times as long and made behind it."""
    return _slices(t, t.documents.select("source", "doc_id", "text"), "doc_id", name)


def _done(t, rows, name):
    return stream.run_through(rows, scratch_path(t.spark, name), scratch_path(t.spark, f"{name}-state"))


@query("t04_stream_throttle", """
with recursive k as (select user_id, min(us) as us from v_events group by 1 union all
  select e.user_id, min(e.us) from k join v_events e on e.user_id = k.user_id and e.us >= k.us + 7200000000 group by 1)
select user_id, event_id, us from (select e.user_id, e.event_id, e.us, row_number() over (partition by e.user_id, e.us order by event_id) as n
  from k join v_events e on e.user_id = k.user_id and e.us = k.us) where n = 1""", recursive=True)
def _(t):
    return _done(t, state.throttle(_timed(t), "user_id", 7_200_000_000), "throttled")


@query("t01_classify_passes", """
with p as (select event_id, user_id, us, case when event_type <> 'error' then event_type end as content from v_events),
l as (select *, last_value(content ignore nulls) over (partition by user_id order by us, event_id rows between unbounded preceding and 1 preceding) as sent from p)
select user_id, event_id, case when content is null then 'idle' when content = sent then 'heartbeat' else 'payload' end as kind from l""")
def _(t):
    passes = _timed(t).withColumn("content", F.when(F.col("event_type") != "error", F.col("event_type")))
    return _done(t, state.classify_passes(passes, "user_id"), "passes")


@query("t06_stall_alerts", """
with n as (select user_id, us, lead(us) over (partition by user_id order by us, event_id) as next from v_events)
select user_id, us from n where next - us >= 14400000000
  or (next is null and us + 14400000000 <= (select (max(us) // 1000) * 1000 - 60000000 from v_events))""")
def _(t):
    return _done(t, state.stall_alerts(_timed(t), "user_id", "ts", 14_400_000_000, 60_000_000), "stalls")


_TURNS = """p as (select conv_id // 8 as reader, (conv_id * 1000 + turn) * 10 + p as us, p, string_split_regex(text, '[ \\n]+') as l
  from conversations, range(4) t(p)),
pages as (select reader, us as event_id, row_number() over (partition by reader order by us) as n,
  case when p = 1 then list_concat(list_slice(l, 1, len(l) - 1), ['#']) when p = 3 then list_slice(l, 1, len(l) // 3) else l end as lines from p)"""


def _turns(t, name):
    """Turns of eight conversations at a time as the pages that one reader sees: whole, with another last line, whole, its first third.

    One task writes a slice, so it gets the texts only, once; what they are spelled out to is made behind it, by many tasks.
    """
    first = ((F.col("conv_id") * 1000 + F.col("turn")) * 10).cast("bigint")
    texts = _slices(t, t.conversations.select("conv_id", "turn", "text", first.alias("first")), "first", name)
    parts = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    rows = texts.repartition(parts, "conv_id", "turn").withColumn("p", F.explode(F.array(*map(F.lit, range(4)))))
    at = F.col("first") + F.col("p")
    words = F.split("text", "[ \\n]+")
    lines = F.when(F.col("p") == 1, F.concat(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.array(F.lit("#")))).when(
        F.col("p") == 3, F.slice(words, F.lit(1), F.floor(F.size(words) / 3).cast("int"))).otherwise(words)
    return rows.select(F.floor(F.col("conv_id") / 8).alias("reader"), at.alias("us"), at.alias("event_id"), "p", lines.alias("lines"))


@query("t02_rebuild_gate", f"""
with recursive {_TURNS},
g as (select *, 600 + (event_id // 10 % 7 = 0)::int as frame, (event_id // 10 % 3) as dy, list_transform(lines, lambda v, i: {{'v': v, 'i': i}}) as at from pages),
r as (select reader, n, event_id, 'rebuilt' as verdict, lines, frame, dy, 0 as kept from g where n = 1
  union all select reader, n, event_id, verdict, case when verdict in ('patched', 'rebuilt') then now else lines end,
    case when verdict in ('patched', 'rebuilt') then f else frame end, case when verdict in ('patched', 'rebuilt') then d else dy end,
    case when verdict = 'kept' then kept + 1 else 0 end
  from (select g.reader, g.n, g.event_id, r.lines, r.frame, r.dy, r.kept, g.lines as now, g.frame as f, g.dy as d,
    case when len(r.lines) = 0 or r.frame <> g.frame then 'rebuilt'
      when coalesce(list_max(list_transform(g.at, lambda e: abs((e.i - len(r.lines) - 1 + list_position(list_reverse(r.lines), e.v)) * 20 + g.dy - r.dy))), 0) > 3 then 'rebuilt'
      when g.lines = r.lines then 'identical'
      when g.event_id % 10 >= 2 and len(g.lines) > 0 and list_transform(g.lines, lambda v: length(v)) = list_transform(r.lines, lambda v: length(v)) then 'patched'
      when len(list_filter(g.lines, lambda v: list_contains(r.lines, v))) / greatest(len(g.lines), len(list_distinct(r.lines))) > 0.85 and r.kept < 2 then 'kept'
      else 'rebuilt' end as verdict from r join g on g.reader = r.reader and g.n = r.n + 1))
select reader, event_id, verdict from r""", recursive=True)
def _(t):
    turn = F.floor(F.col("us") / 10)
    passes = _turns(t, "passes").withColumns({
        "xs": F.transform("lines", lambda s: F.lit(0.0)), "ys": F.transform("lines", lambda s, i: i * F.lit(20.0) + turn % 3),
        "frame": F.when(turn % 7 == 0, "601").otherwise("600"), "vote": F.col("p").cast("int")}).drop("p")
    return _done(t, state.rebuild_gate(passes, "reader"), "gate")


@query("t03_page_turns", f"""
with recursive {_TURNS}, d as (select reader, event_id, n, list_distinct(lines) as lines from pages),
r as (select reader, n, event_id, false as turned, lines as adopted, null::varchar[] as waiting from d where n = 1
  union all select reader, n, event_id, not old and new, case when old or new then lines else adopted end, case when old or new then null else lines end
  from (select d.reader, d.n, d.event_id, d.lines, r.adopted,
    len(list_intersect(d.lines, r.adopted)) / greatest(len(d.lines), len(r.adopted), 1) >= 0.5 as old,
    coalesce(len(list_intersect(d.lines, r.waiting)) / greatest(len(d.lines), len(r.waiting), 1) >= 0.5, false) as new
    from r join d on d.reader = r.reader and d.n = r.n + 1))
select reader, event_id from r where turned""", recursive=True)
def _(t):
    return _done(t, state.page_turns(_turns(t, "passes").drop("p"), "reader"), "turns")


_IN = "px between x and x + w and py between y and y + h"


@query("t09_enrich_triggers", f"""
with c as (select event_id, user_id, us, (event_id * 37) % 1400 as px, (event_id * 53) % 800 as py, (select max_by(p.event_id % 150, (p.us, p.event_id))
  from v_events p where p.user_id = e.user_id and p.event_type = 'purchase' and p.us <= e.us) as layer from v_events e where event_type = 'click'),
h as (select event_id, user_id, us, min_by(rect_id, (pow(2 * px - 2 * x - w, 2) + pow(2 * py - 2 * y - h, 2), rect_id)) as box from c
  join v_rect r on r.snap = c.layer and r.layer = 0 and {_IN}
  where not exists (select 1 from v_rect k where k.snap = c.layer and k.layer = 1 and px between k.x and k.x + k.w and py between k.y and k.y + k.h) group by all),
n as (select *, lag(box) over (partition by user_id order by us, event_id) as was from h)
select event_id, box from n where was is null or box <> was""")
def _(t):
    click = F.col("event_type") == "click"
    events = t.v_events.where("event_type in ('click', 'purchase')").select(
        "user_id", "us", "event_id", F.when(click, F.col("event_id") * 37 % 1400).alias("px"), F.when(click, F.col("event_id") * 53 % 800).alias("py"),
        F.when(~click, F.col("event_id") % 150).alias("page"))
    boxes = t.v_rect.select(F.col("snap").alias("page"), F.col("rect_id").alias("box"), "layer", "x", "y", "w", "h")
    steps = stream.trigger_stream(_slices(t, events, "us", "pointed"), boxes.where("layer = 0"), boxes.where("layer = 1"), "user_id")
    return _done(t, steps, "targets").select("event_id", "box")


@query("t07_vote_stream", """
with q as (select page_id, pass * 2 as k, li, ci, ch, x, y, w, h from v_read
  union all select page_id, 3, li, ci, ch, x + 2, y, w, h from v_read where pass = 0 and ci % 3 = 0 and page_id % 3 = 0),
n as (select page_id, k, count(*) as n, first_value(count(*)) over (partition by page_id order by k) as base from q group by page_id, k),
a as (select page_id, k, row_number() over (partition by page_id order by k) as r from n where k = 0 or n * 2 >= base qualify r <= 3),
p as (select q.*, r, x + w / 2 as cx, y + h / 2 as cy, floor((x + w / 2) / 32) as gx, floor((y + h / 2) / 32) as gy from q join a using (page_id, k)),
b as (select page_id, li, ci, ch, cx as bx, cy as "by", gx + i as gx, gy + j as gy, greatest(6, greatest(w, h) * 0.5) as tol from p, range(-1, 2) s(i), range(-1, 2) t(j) where r = 1),
m as (select b.page_id, b.li, b.ci, b.ch, p.r, min_by(p.ch, (greatest(abs(cx - bx), abs(cy - "by")), p.gx, p.gy, p.li, p.ci)) as got
  from b join p using (page_id, gx, gy) where greatest(abs(cx - bx), abs(cy - "by")) < tol group by all),
v as (select m.page_id, a.k, a.r as vote, li, ci, ch, got, count(*) as n from m join a on a.page_id = m.page_id and m.r <= a.r group by all),
w as (select page_id, k, vote, li, ci, ch, coalesce(max(n) filter (got = ch), 1) as own, min_by(got, (-n, got)) as best, max(n) as top from v group by all)
select source, page_id * 10 + k as event_id, vote::int as vote, li, string_agg(case when top > own then best else ch end, '' order by ci) as text,
  sum(greatest(top, own))::bigint as votes, sum(greatest(top, own)) / (count(*) * vote) as conf
from w join documents on doc_id = page_id group by source, page_id, k, vote, li""", paged=True)
def _(t):
    def passes(t):
        box = ["li", "ci", "ch", "x", "y", "w", "h"]
        half = t.v_read.where((F.col("pass") == 0) & (F.col("ci") % 3 == 0) & (F.col("page_id") % 3 == 0))
        rows = t.v_read.withColumn("k", F.col("pass") * 2).unionByName(half.withColumns({"k": F.lit(3), "x": F.col("x") + 2}))
        nested = rows.groupBy("page_id", "k").agg(F.collect_list(F.struct(*box)).alias("glyphs"))
        at = F.col("page_id") * 10 + F.col("k")
        return nested.join(t.documents.select(F.col("doc_id").alias("page_id"), "source"), "page_id").select(
            "source", at.alias("us"), at.alias("event_id"), F.col("page_id").cast("string").alias("page"), "glyphs")

    texts = _texts(t, "reads")
    return _done(t, reads.vote_stream(passes(t), "source").fed(texts, lambda some: passes(t.over(some))), "voted")


@query("t08_orientation_state", """
with recursive k as (select page_id, page_id // 5 % 5 as kind, li, n, x1 - x0 as w, regexp_matches(l.line, '[à-ÿ]') as cjk,
    (y1 - y0) * case when page_id // 5 % 5 = 1 or (page_id // 5 % 5 = 2 and li % 3 <> 0) then 1000 else 1 end as h
  from v_line_geom g join v_lines l on l.doc_id = g.page_id and l.line_no = g.li),
e as (select page_id, coalesce(sum(n) filter (h <= w), 0)::bigint as across, coalesce(sum(n) filter (h > w), 0)::bigint as down,
  count(*) >= 8 and count(*) filter (n = 1 and cjk) > count(*) * 0.7 as rejected,
  count(*) filter (n >= 2 and cjk) >= 2 and count(*) filter (n >= 2 and cjk and h > w * 2) * 2 >= count(*) filter (n >= 2 and cjk) as native
  from k where kind <> 4 or n < 5 group by page_id),
g as (select page_id, li, h, case when page_id // 5 % 5 = 3 then lead(x) over (partition by page_id, li order by ci) * 2 - x * 2 - w
  else lead(x) over (partition by page_id, li order by ci) - x - w end as gap from v_glyph),
l as (select page_id, list_sort(list(h))[count(*) // 2 + 1] as em, list_sort(list(gap) filter (gap is not null))[count(gap) // 2 + 1] as gap from g group by page_id, li having count(*) >= 3),
f as (select page_id, count(*) filter (em > 0 and gap > em * 0.6) >= 3 and count(*) filter (em > 0 and gap > em * 0.6) * 5 > count(*) * 3 as fence from l group by page_id),
x as (select source, doc_id, row_number() over (partition by source order by doc_id) as n, coalesce(across + down, 0) as across, coalesce(down > across * 2, false) as mostly,
  coalesce(native and not rejected, false) and coalesce(across + down, 0) >= 5 as nat, coalesce(fence, false) as fence,
  case when doc_id // 5 % 5 in (1, 2) then length(text) when doc_id // 5 % 5 = 3 then length(text) % 300 else length(text) % 7 end as turned
  from documents left join e on e.page_id = doc_id left join f on f.page_id = doc_id),
y as (select *, case when fence then 0 else across end as a from x),
r as (select source, 0::bigint as n, null::bigint as doc_id, 'unknown' as state, false as upright, false as probed from (select distinct source from x)
  union all select source, n, doc_id, case when stay then state when nat then 'vertical_native' when a >= 5 or turned >= 5 then
      case when up then 'vertical' else 'horizontal' end else 'unknown' end,
    case when stay then state <> 'horizontal' else nat or up end, not stay and not (state = 'horizontal' and nat)
  from (select y.*, r.state, turned > a * 2 and turned >= 5 as up, case r.state when 'horizontal' then not nat and across >= 5 and not fence and not mostly
    when 'vertical_native' then nat when 'vertical' then turned >= 5 else false end as stay from r join y on y.source = r.source and y.n = r.n + 1))
select source, doc_id as event_id, state, upright, probed from r where n > 0""", recursive=True, paged=True)
def _(t):
    kind, page = F.floor(F.col("page_id") / 5) % 5, F.col("page_id")
    down = (kind == 1) | ((kind == 2) & (F.col("li") % 3 != 0))
    h = (F.col("y1") - F.col("y0")) * F.when(down, 1000).otherwise(1)
    w = F.col("x1") - F.col("x0")

    def passes(t):
        text = t.v_lines.select(F.col("doc_id").alias("page_id"), F.col("line_no").alias("li"), F.col("line").rlike("[à-ÿ]").alias("cjk"))
        lines = t.v_line_geom.join(text, ["page_id", "li"]).where((kind != 4) | (F.col("n") < 5)).groupBy("page_id").agg(
            F.collect_list(F.struct("n", w.alias("w"), h.alias("h"), (h > w).alias("down"), "cjk")).alias("lines"))
        glyphs = t.v_glyph.withColumn("x", F.when(kind == 3, F.col("x") * 2).otherwise(F.col("x"))).groupBy("page_id").agg(
            F.collect_list(F.struct("li", "ci", "x", "w", "h")).alias("glyphs"))
        size = F.length("text")
        docs = t.documents.select("source", F.col("doc_id").alias("page_id"), F.when(kind.isin(1, 2), size).when(
            kind == 3, size % 300).otherwise(size % 7).alias("turned"))
        return docs.join(lines, "page_id", "left").join(glyphs, "page_id", "left").select(
            "source", page.alias("us"), page.alias("event_id"), "turned", "lines", "glyphs")

    texts = _texts(t, "reads")
    return _done(t, reads.orientation(passes(t), "source").fed(texts, lambda some: passes(t.over(some))), "directions")
