"""J*, A*, W*, K*, P08: joins and reports over pages, windows and settings."""

from pyspark.sql import functions as F

from glyphlake.catalog.registry import query
from glyphlake.functions.text import class_fraction
from glyphlake.operators import pages, settings

_VOWELS = "aeiouéèêàäöü"
PARTS = """o as (select a.snap, a.rect_id, b.rect_id as "by", a.x as ax, a.y as ay, greatest(a.x, b.x) as x0, least(a.x + a.w, b.x + b.w) as x1,
  greatest(a.y, b.y) as y0, least(a.y + a.h, b.y + b.h) as y1 from v_rect a join v_rect b on a.snap = b.snap and b.z < a.z
  where b.layer = 0 and b.alpha > 0.05 and least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x) > 1 and least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y) > 1)"""

DISPLAYS = [(0, 0, 800, 700), (900, 100, 800, 800)]


@query("j09_occluders", f"with {PARTS} select snap, rect_id, \"by\", (x0 - ax)::int as x, (y0 - ay)::int as y, (x1 - x0)::int as w, (y1 - y0)::int as h from o")
def _(t):
    return pages.occluders(t.v_rect, ["snap"], "rect_id", "z")


@query("a12_visible_fraction", f"""
with {PARTS}, s as (select snap, rect_id, x + (i + 0.5::double) * w / 20 as px, y + (j + 0.5::double) * h / 20 as py from v_rect, range(20) a(i), range(20) b(j))
select snap, rect_id, count(*) filter (((px >= 0 and px < 800 and py >= 0 and py < 700) or (px >= 900 and px < 1700 and py >= 100 and py < 900))
  and not exists (select 1 from o where o.snap = s.snap and o.rect_id = s.rect_id and px >= x0 and px < x1 and py >= y0 and py < y1)) / 400 as visible from s group by 1, 2""")
def _(t):
    return pages.visible_fraction(t.v_rect, ["snap"], "rect_id", "z", DISPLAYS)


def _lines(t):
    """Line boxes with their text."""
    text = t.v_lines.select(F.col("doc_id").alias("page_id"), F.col("line_no").alias("li"), F.col("line").alias("text"))
    return t.v_line_geom.join(text, ["page_id", "li"])


_LINES = "t as (select g.*, l.line as text from v_line_geom g join v_lines l on l.doc_id = g.page_id and l.line_no = g.li)"
_SHARE = f"coalesce(len(regexp_extract_all(text, '[{_VOWELS}]')) / nullif(len(regexp_extract_all(text, '\\S')), 0), 0)"


@query("j10_mark_ruby", f"""
with {_LINES}, m as (select page_id, max(hh) as top from t group by page_id having min(hh) < max(hh) * 0.65)
select s.page_id, s.li, min(b.li) as base from t s join m on m.page_id = s.page_id join t b on b.page_id = s.page_id and b.li <> s.li
where {_SHARE.replace('text', 's.text')} >= 0.45 and s.hh >= b.hh * 0.35 and s.hh <= b.hh * 0.65 and b.y0 - s.y1 > -0.5 * s.hh and b.y0 - s.y1 < 1.2 * s.hh
  and (least(s.x1, b.x1) - greatest(s.x0, b.x0)) / greatest(1, s.x1 - s.x0) >= 0.4 group by 1, 2""")
def _(t):
    lines = _lines(t).withColumn("kana", class_fraction("text", f"[{_VOWELS}]", "\\S")).withColumnRenamed("hh", "h")
    return pages.mark_ruby(lines, ["page_id"], "kana", 0.45)


@query("j11_attach_hints", f"""
with {_LINES}, b as (select page_id, li as band, y1, y1 - y0 as h, text from t where li % 2 = 0),
d as (select b.page_id, band, b.text, min_by(l.li, (l.y0 - b.y1, l.li)) as li from b join t l on l.page_id = b.page_id and l.y0 - b.y1 > -b.h
  and l.y0 - b.y1 < 2.5 * b.h group by all)
select page_id, li, md5(string_agg(text, '' order by band)) as hint from d group by page_id, li""")
def _(t):
    bands = _lines(t).where("li % 2 = 0").select("page_id", F.col("li").alias("band"), "y0", "y1", "text")
    lines = t.v_line_geom.select("page_id", "li", F.col("y0").alias("top"))
    return pages.attach_hints(bands, lines, ["page_id"]).withColumn("hint", F.md5("hint"))


@query("j12_merge_remainder", """
select snap, rect_id from v_rect where rect_id % 2 = 0 union all
select snap, rect_id from v_rect a where rect_id % 2 = 1 and h > w and not exists (select 1 from v_rect b where b.rect_id % 2 = 0 and a.snap = b.snap
  and a.x <= b.x + b.w and b.x <= a.x + a.w and a.y <= b.y + b.h and b.y <= a.y + a.h
  and (least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * (least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) > 0.3 * a.w * a.h)""")
def _(t):
    first, second = t.v_rect.where("rect_id % 2 = 0"), t.v_rect.where("rect_id % 2 = 1")
    return pages.merge_remainder(first, second, ["snap"], "rect_id").select("snap", "rect_id")


@query("j13_unexplained_cells", """
select snap, count(*) as n, count(*) >= 24 as flagged from v_points p where not exists (select 1 from v_rect r where p.snap = r.snap
  and px between x - 8 and x + w + 8 and py between y - 8 and y + h + 8) group by snap""", paged=True)
def _(t):
    # The marks and boxes of one screen are bounded by it.
    points, boxes = (t.deal(df, "snap") for df in (t.v_points, t.v_rect.select("snap", "x", "y", "w", "h")))
    return pages.unexplained_cells(points, boxes, ["snap"], "pt_id", 8)


@query("j16_assign_columns", """
select p.snap, pt_id, min(rect_id) as rect_id from v_points p join v_rect r on p.snap = r.snap and px between x - 2 and x + w + 2 group by 1, 2""")
def _(t):
    columns = t.v_rect.select("snap", "rect_id", F.col("x").alias("x0"), (F.col("x") + F.col("w")).alias("x1"))
    return pages.assign_columns(t.v_points, columns, ["snap"], "pt_id", "px", "rect_id")


@query("j17_map_strip", """
with n as (select page_id, max(li) as top, max(li) // 2 + 1 as rows from v_glyph group by page_id),
g as (select g.*, least(greatest(floor((y + h / 2) / 24), 0), rows - 1)::int as row, floor((x + 5.0 - 3) / 10 + 0.5)::int as cell from v_glyph g join n using (page_id))
select g.page_id, row, count(*) as n, sum(cell)::bigint as cells, md5(string_agg(c.ch, '' order by g.li, g.ci)) as source
from g join v_glyph c on c.page_id = g.page_id and c.li = row and c.ci = cell group by g.page_id, row""", paged=True)
def _(t):
    rows = t.v_glyph.groupBy("page_id").agg((F.floor(F.max("li") / 2) + 1).alias("rows"))
    cells = t.v_glyph.select("page_id", F.col("li").alias("row"), F.col("ci").alias("cell"), F.col("ch").alias("source"))
    found = pages.map_strip(t.v_glyph.join(rows, "page_id"), cells, ["page_id"], "rows", 24.0, 3.0, 10.0)
    return found.groupBy("page_id", "row").agg(F.count("*").alias("n"), F.sum("cell").alias("cells"), F.md5(F.expr(
        "listagg(source, '') within group (order by struct(li, ci))")).alias("source"))


@query("j18_catalogue_status", "select n_nationkey, n_nationkey in (select s_nationkey from supplier) as installed from nation")
def _(t):
    have = t.supplier.select(F.col("s_nationkey").alias("n_nationkey"))
    return settings.catalogue_status(t.nation.select("n_nationkey"), have, "n_nationkey")


_PREFS = """s as (select user_id, event_type as name, max(value) > 40 as enabled, min(us) as ord from v_events where event_id % 3 = 0 group by 1, 2),
m as (select user_id, event_type as name, min(event_id) as ord from v_events where event_id % 3 = 1 and user_id % 4 <> 0 group by 1, 2)"""


def _prefs(t):
    keys = ["user_id", F.col("event_type").alias("name")]
    saved = t.v_events.where("event_id % 3 = 0").groupBy(*keys).agg((F.max("value") > 40).alias("enabled"), F.min("us").alias("ord"))
    listed = t.v_events.where("event_id % 3 = 1 and user_id % 4 <> 0").groupBy(*keys).agg(F.min("event_id").alias("ord"))
    return saved, listed


@query("j19_merge_prefs", f"""
with {_PREFS}, b as (select coalesce(s.user_id, m.user_id) as user_id, coalesce(s.name, m.name) as name, coalesce(enabled, true) as enabled,
  s.name is null as late, coalesce(s.ord, m.ord) as pos, m.name is not null as listed from s full join m on s.user_id = m.user_id and s.name = m.name)
select user_id, name, enabled, row_number() over (partition by user_id order by late, pos, name) as place from b where listed or user_id not in (select user_id from m)""")
def _(t):
    return settings.merge_prefs(*_prefs(t), ["user_id"])


@query("k13_swap_priority", f"""
with {_PREFS}, v as (select *, row_number() over (partition by user_id order by ord) as n from s where enabled),
p as (select a.user_id, a.name as a, a.ord as ao, b.name as b, b.ord as bo from v a join v b on a.user_id = b.user_id and b.n = a.n + 1 and a.name = 'click')
select s.user_id, s.name, s.enabled as shown, case s.name when a then bo when b then ao else ord end as ord from s left join p on s.user_id = p.user_id""")
def _(t):
    prefs = _prefs(t)[0].withColumnRenamed("enabled", "shown")
    moves = prefs.where("name = 'click'").select("user_id", "name", F.lit(1).alias("delta"))
    return settings.swap_priority(prefs, moves, ["user_id"])


@query("a07_assert_min", "select count(*) as passages, sum(length(text))::bigint as characters from documents")
def _(t):
    totals = t.documents.agg(F.count(F.lit(1)).alias("passages"), F.sum(F.length("text")).alias("characters"))
    return settings.assert_min(totals, passages=60, characters=4500)


_INSIDE = "p.snap = r.snap and px between x and x + w and py between y and y + h"
_CELLS = f"""c as (select p.snap, pt_id, count(r.rect_id) as n, case when count(r.rect_id) = 1
  then max(greatest(abs(x + w / 2 - px), abs(y + h / 2 - py))) end as error from v_points p left join v_rect r on {_INSIDE} group by 1, 2)"""


@query("j21_cells_containing", f"with {_CELLS} select * from c")
def _(t):
    return pages.cells_containing(t.v_points, t.v_rect, ["snap"], "pt_id")


@query("a17_cell_metrics", f"""
with {_CELLS}, k as (select snap, count(*) as cells from v_rect group by snap)
select c.snap, avg((n = 1)::int::double) as recall, avg((n > 1)::int::double) as dup, coalesce(quantile_cont(error, 0.5), -1.0::double) as error,
  coalesce(max(cells), 0) / count(*) as ratio from c left join k on k.snap = c.snap group by c.snap""")
def _(t):
    return pages.cell_metrics(t.v_points, t.v_rect, ["snap"], "pt_id")


_MATCHED = """a as (select page_id, ch, li, ci, x, y, greatest(12, w * 0.7, h * 0.7) as tol from v_pass where pass = 0),
b as (select page_id, ch, x, y from v_pass where pass = 2),
m as (select a.page_id, li, ci, abs(b.x - a.x) + abs(b.y - a.y) as away, abs(b.x - a.x) <= tol and abs(b.y - a.y) <= tol as ok
  from a join b using (page_id, ch) where abs(b.x - a.x) <= tol * 2 and abs(b.y - a.y) <= tol * 2),
p as (select page_id, li, ci, min_by(ok, (away, not ok)) as placed from m group by all),
g as (select a.page_id, a.li, a.ci, r.ch is not null as matched, coalesce(placed, false) as placed from a
  left join (select distinct page_id, ch from b) r on r.page_id = a.page_id and r.ch = a.ch left join p on p.page_id = a.page_id and p.li = a.li and p.ci = a.ci)"""


@query("j20_match_glyphs", f"""
with {_MATCHED} select page_id, li, count(*) as n, count(*) filter (matched) as matched, count(*) filter (placed) as placed from g group by page_id, li""", paged=True)
def _(t):
    found = pages.match_glyphs(*_two_reads(t), ["page_id"], "ch", ["li", "ci"])
    return found.groupBy("page_id", "li").agg(F.count("*").alias("n"), F.count_if("matched").alias("matched"), F.count_if("placed").alias("placed"))


def _two_reads(t):
    return t.passes(F.lit(0)), t.passes(F.lit(2))


@query("a18_placement_report", f"""
with {_MATCHED} select page_id, count(*) as n, avg(matched::int::double) as coverage, avg(placed::int::double) as placement,
  count(*) filter (matched) >= 8 and count(*) filter (placed) >= count(*) filter (matched) * 0.7 as ok from g group by page_id""", paged=True)
def _(t):
    return pages.placement_report(pages.match_glyphs(*_two_reads(t), ["page_id"], "ch", ["li", "ci"]), ["page_id"])


@query("a09_word_boxes", """
select page_id * 100000 + li as line, min(x) - 2 as x0, min(y) - 2 as y0, max(x + w) + 2 as x1, max(y + h) + 2 as y1,
  min(case when ci % 3 = 0 then 1.0 else ci / 10.0 end)::double as conf from v_glyph where ci between page_id % 5 and page_id % 5 + 3 group by 1""", paged=True)
def _(t):
    groups = t.v_line_geom.select("page_id", "li", (F.col("page_id") * 100_000 + F.col("li")).alias("line"),
                                  (F.col("page_id") % 5).cast("int").alias("start"), F.lit(4).alias("len"))
    glyphs = t.v_glyph.withColumn("conf", F.when(F.col("ci") % 3 != 0, F.col("ci") / 10.0))
    return pages.word_boxes(groups, glyphs, ["page_id", "li"], "line", "start", "len")


@query("a10_page_evidence", f"""
with {_LINES}, k as (select page_id, n, x1 - x0 as w, (y1 - y0) * 10 as h, (y1 - y0) * 10 > x1 - x0 as down, regexp_matches(text, '[à-ÿ]') as cjk from t)
select page_id, coalesce(sum(n) filter (not down), 0)::bigint as n_across, coalesce(sum(n) filter (down), 0)::bigint as n_down,
  count(*) >= 8 and count(*) filter (n = 1 and cjk) > count(*) * 0.7 as rejected,
  count(*) filter (n >= 2 and cjk) >= 2 and count(*) filter (n >= 2 and cjk and h > w * 2) * 2 >= count(*) filter (n >= 2 and cjk) as native_down,
  coalesce(sum(n) filter (down), 0) > coalesce(sum(n) filter (not down), 0) * 2 as mostly_down from k group by page_id""")
def _(t):
    w, h = F.col("x1") - F.col("x0"), (F.col("y1") - F.col("y0")) * 10
    lines = _lines(t).select("page_id", "n", w.alias("w"), h.alias("h"), (h > w).alias("down"), F.col("text").rlike("[à-ÿ]").alias("cjk"))
    return pages.page_evidence(lines, ["page_id"])


@query("a11_picket_fence", """
with g as (select page_id, li, h, case when page_id % 2 = 0 then lead(x) over (partition by page_id, li order by ci) * 2 - x * 2 - w
  else lead(x) over (partition by page_id, li order by ci) - x - w end as gap from v_glyph),
l as (select page_id, list_sort(list(h))[count(*) // 2 + 1] as em, list_sort(list(gap) filter (gap is not null))[count(gap) // 2 + 1] as gap from g group by page_id, li having count(*) >= 3)
select page_id, count(*) as n, count(*) filter (em > 0 and gap > em * 0.6) as n_fence,
  count(*) filter (em > 0 and gap > em * 0.6) >= 3 and count(*) filter (em > 0 and gap > em * 0.6) * 5 > count(*) * 3 as fence from l group by page_id""", paged=True)
def _(t):
    wide = t.v_glyph.withColumn("x", F.when(F.col("page_id") % 2 == 0, F.col("x") * 2).otherwise(F.col("x")))
    return pages.picket_fence(wide, ["page_id"], "li")


@query("a15_profile", """
with e as (select event_type, (us // 60000000) % 1440 as pos from v_events), b as (select event_type, min(pos) as lo, max(pos) as hi from e group by 1)
select b.event_type, r.pos, count(e.pos) as n from b join range(1440) r(pos) on r.pos between lo and hi left join e on e.event_type = b.event_type and e.pos = r.pos group by 1, 2""")
def _(t):
    minute = (F.floor(F.col("us") / 60_000_000) % 1440).cast("bigint")
    return pages.profile(t.v_events.select("event_type", minute.alias("pos")), ["event_type"], "pos")


@query("a16_standout", """
with m as (select event_type, us // 14400000000 as tile, list_sort(list(value))[count(*) // 2 + 1] as bg, count(*) as n from v_events group by 1, 2)
select event_id from v_events e join m on m.event_type = e.event_type and m.tile = e.us // 14400000000 and n > 4 where abs(value - bg) > 30""")
def _(t):
    cells = t.v_events.withColumn("tile", F.floor(F.col("us") / 14_400_000_000))
    return pages.standout(cells, ["event_type", "tile"], "value", 30).select("event_id")


@query("w05_ruby_bands", """
with b as (select page_id, y0 as s, y1 - 1 as e, lead(y0) over (partition by page_id order by y0) as s2, lead(y1 - 1) over (partition by page_id order by y0) as e2 from v_line_geom)
select page_id, s - 4 as start, s2 - 2 as "end" from b where e - s + 1 >= 6 and e - s + 1 >= (e2 - s2 + 1) * 0.30 and e - s + 1 <= (e2 - s2 + 1) * 0.65 and s2 - e < (e2 - s2 + 1) * 0.8""")
def _(t):
    bands = t.v_line_geom.select("page_id", F.col("y0").alias("start"), (F.col("y1") - 1).alias("end"))
    return pages.ruby_bands(bands, ["page_id"])


@query("w06_group_bands", """
with recursive o as (select snap, min({'y': y, 'id': rect_id, 'z': y + h}) as b from v_rect group by snap
  union all select o.snap, min({'y': r.y, 'id': r.rect_id, 'z': r.y + r.h}) from o join v_rect r on r.snap = o.snap and r.y >= o.b.z group by o.snap),
f as (select snap, b.y as y, b.id as id, lead(b.y) over (partition by snap order by b.y) as below, row_number() over (partition by snap order by b.y) as grp from o),
x as (select f.snap, grp, count(*) as n, string_agg(rect_id::varchar, '' order by rect_id) as text from v_rect r join f on f.snap = r.snap
  and (r.y > f.y or (r.y = f.y and rect_id >= id)) and (below is null or r.y < below or (r.y = below and rect_id < (select min(g.id) from f g where g.snap = f.snap and g.y = f.below))) group by 1, 2)
select snap, grp, n, text, len(regexp_extract_all(text, '[02468]')) / length(text) >= 0.5 as keep from x""", recursive=True)
def _(t):
    bands = t.v_rect.withColumn("text", F.col("rect_id").cast("string"))
    return pages.group_bands(bands, ["snap"], "rect_id", "text", class_fraction("text", "[02468]", "."), 0.5)


@query("w13_attach_labels", """
with k as (select doc_id, line_no, line, length(line) <= 40 as label, length(line) > 40 and ascii(line) % 3 = 0 as quote from v_lines where line <> ''),
n as (select *, sum((not label)::int) over (partition by doc_id order by line_no) as nth from k),
f as (select *, (not label and (not quote or nth = 1))::int as kept from n),
g as (select *, sum(kept) over (partition by doc_id order by line_no) as sense from f),
p as (select doc_id, sense + 1 as sense, max_by(line, line_no) as label from g where label group by 1, 2)
select g.doc_id, g.sense::bigint as sense, md5(string_agg(case when kept = 1 and p.label is not null then p.label || ' ' else '' end || line, ' ' order by line_no)) as text
from g left join p on p.doc_id = g.doc_id and p.sense = g.sense where not g.label group by 1, 2""", paged=True)
def _(t):
    label, quote = F.length("line") <= 40, (F.length("line") > 40) & (F.ascii("line") % 3 == 0)
    lines = t.v_lines.where("line <> ''")
    return pages.attach_labels(lines, ["doc_id"], "line_no", "line", label, quote, bounded=True).withColumn("text", F.md5("text"))


@query("w17_layout_shift", """
with l as (select page_id, pass, li, x + pass * pass as x, y, line as text from v_pass join v_lines on doc_id = page_id and line_no = li where ci = 0),
b as (select page_id, pass + 1 as pass, text, max_by(x, li) as px, max_by(y, li) as py from l group by all),
s as (select l.page_id, l.pass, max(greatest(abs(x - px), abs(y - py))) as shift from l join b on l.page_id = b.page_id and l.pass = b.pass and l.text = b.text group by 1, 2)
select page_id, pass, shift, shift > 3 or page_id % 3 = 0 as moved from s where pass > 0""", paged=True)
def _(t):
    text = t.v_lines.select(F.col("doc_id").alias("page_id"), F.col("line_no").alias("li"), F.col("line").alias("text"))
    lines = t.v_pass.where("ci = 0").join(text, ["page_id", "li"]).withColumns({
        "x": F.col("x") + F.col("pass") * F.col("pass"), "frame": F.when(F.col("page_id") % 3 == 0, F.col("pass")).otherwise(0)})
    return pages.layout_shift(lines, ["page_id"], "pass")


@query("k08_reading_order", """
with c as (select page_id, li, x1, (y0 + y1) / 2 as cy from v_line_geom),
n as (select *, coalesce(cy - lag(cy) over (partition by page_id order by cy, li) > 20, true)::int as new from c),
b as (select *, sum(new) over (partition by page_id order by cy, li) as band from n)
select page_id, li, row_number() over (partition by page_id order by band, x1, li) as line_order from b""")
def _(t):
    lines = t.v_line_geom.select("page_id", "li", "x1", ((F.col("y0") + F.col("y1")) / 2).alias("cy"))
    return pages.reading_order(lines, ["page_id"], "cy", "x1", "li", 20).select("page_id", "li", "line_order")


@query("p08_admit_passes", """
with n as (select *, row_number() over (partition by user_id order by us, event_id) as i from v_events),
b as (select user_id, value as base from n where i = 1),
a as (select event_id, row_number() over (partition by n.user_id order by us, event_id) as vote from n join b on b.user_id = n.user_id where i = 1 or ((i - 1) % 2 = 0 and value * 2 >= base))
select * from a where vote <= 5""")
def _(t):
    return pages.admit_passes(t.v_events, ["user_id"], ["us", "event_id"], "value", 5, 2).select("event_id", "vote")
