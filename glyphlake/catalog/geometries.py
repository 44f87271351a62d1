"""J*, A*, K*, C03, M04: boxes, lines and repeated reads of pages."""

from pyspark.sql import functions as F

from glyphlake.catalog.registry import query
from glyphlake.operators import anchors, geometry, votes

_IN = "px between x and x + w and py between y and y + h"


@query("j07_hit_test", f"""
select p.snap, pt_id, min_by(rect_id, (pow(2 * px - 2 * x - w, 2) + pow(2 * py - 2 * y - h, 2), rect_id)) as rect_id
from v_points p join v_rect r on p.snap = r.snap and {_IN} group by p.snap, pt_id""")
def _(t):
    return geometry.hit_test(t.v_points, t.v_rect, ["snap"], "pt_id", "rect_id")


@query("j08_drop_covered", f"""
select snap, pt_id from v_points p where not exists (select 1 from v_rect r where p.snap = r.snap and layer = 1 and {_IN})""")
def _(t):
    return geometry.drop_covered(t.v_points, t.v_rect.where("layer = 1"), ["snap"], "pt_id").select("snap", "pt_id")


@query("a08_line_geometry", """
select page_id, li, min(x) as x0, max(x + w) as x1, min(y) as y0, max(y + h) as y1, avg(x) as mean_x, max(h) as median_h
from v_glyph group by page_id, li""", paged=True)
def _(t):
    return geometry.line_geometry(t.v_glyph, ["page_id", "li"])


@query("p09_line_orientation", "select page_id, li, case when count(*) >= 2 then false end as columnar from v_glyph group by page_id, li")
def _(t):
    return geometry.line_orientation(t.v_glyph, ["page_id", "li"])


@query("c03_vote", """
with n as (select page_id, min(pass) as pass, count(distinct pass) as passes from v_read group by page_id),
p as (select *, x + w / 2 as cx, y + h / 2 as cy, floor((x + w / 2) / 32) as gx, floor((y + h / 2) / 32) as gy from v_read),
b as (select p.page_id, li, ci, ch, cx as bx, cy as "by", gx + i as gx, gy + j as gy, passes, greatest(6, greatest(w, h) * 0.5) as tol
  from p join n using (page_id, pass), range(-1, 2) r(i), range(-1, 2) s(j)),
m as (select b.page_id, b.li, b.ci, b.ch, passes, p.pass, min_by(p.ch, (greatest(abs(cx - bx), abs(cy - "by")), p.gx, p.gy, p.li, p.ci)) as got
  from b join p using (page_id, gx, gy) where greatest(abs(cx - bx), abs(cy - "by")) < tol group by all),
v as (select page_id, li, ci, ch, passes, got, count(*) as n from m group by all),
w as (select page_id, li, ci, ch, passes, coalesce(max(n) filter (got = ch), 1) as own, min_by(got, (-n, got)) as best, max(n) as top from v group by all)
select page_id, li, string_agg(case when top > own then best else ch end, '' order by ci) as text, sum(greatest(top, own))::bigint as votes,
  sum(greatest(top, own)) / sum(passes) as conf from w group by page_id, li""", paged=True)
def _(t):
    return votes.voted_lines(votes.vote(t.v_read, ["page_id"]), ["page_id"])


@query("k09_columns_rtl", """
select page_id, li, row_number() over (partition by page_id order by x1 desc, li) as line_order from v_line_geom""")
def _(t):
    return geometry.columns_rtl(t.v_line_geom, ["page_id"], "x1", "li").select("page_id", "li", "line_order")


@query("w14_reading_order_check", """
select page_id, avg(case when next is not null then (next < x1)::int::double end) as moves_left, 1.0::double as goes_down
from (select page_id, li, x1, lead(x1) over (partition by page_id order by li) as next from v_line_geom) group by page_id""")
def _(t):
    lines = t.v_line_geom.select("page_id", "li", F.col("x1").alias("x0"), "y0", "y1")
    return geometry.reading_order_check(lines, ["page_id"], "li")


# Two lines a column, one below the other; ink cells of which some are cut in two, run together or missing.
_COLUMNS = """g as (select doc_id as page_id, line_no as li, line_no // 2 as col, unnest(range(length(line)))::int as ci, doc_id from v_lines),
glyphs as (select page_id, li, ci, 5000 - col * 40 + ci % 3 + case when li % 11 = 0 then 30 else 0 end as x, li % 2 * 1000000 + ci * 24 + ci % 5 as y,
  10 as w, 20 as h from g),
k as (select *, (page_id + col) % 6 as kind, li % 2 = 0 and ci = (page_id * 7 + col * 3) % 30 as here, li % 2 = 0 and ci = (page_id * 7 + col * 3) % 30 + 1 as next,
  li % 2 = 0 and ci = (page_id * 7 + col * 3) % 30 + 2 as over, li % 2 * 1000000 + ci * 24 as top from g),
cells as (select page_id, col, 5000 - col * 40 as x, top + s * 10 as y, 20 as w,
  case when kind = 3 and here then 44 when (kind = 2 and here) or (kind = 5 and (here or over)) then 10 else 20 end as h
  from k, range(2) r(s) where (s = 0 or (kind = 2 and here) or (kind = 5 and (here or over))) and not (kind = 4 and here) and not (kind = 3 and next))"""


@query("m04_reanchor", f"""
with recursive {_COLUMNS},
c as (select page_id, col, min(x) as x0, max(x + w) as x1, count(*) as n from cells group by all),
l as (select page_id, li, avg(x + w / 2) as mid, min_by(y, ci) as first, count(*) as n from glyphs group by all),
a as (select l.page_id, li, first, l.n, min(col) as col from l join c on c.page_id = l.page_id and mid between x0 - 2 and x1 + 2 group by all),
t as (select page_id, col, sum(a.n)::bigint as total, any_value(c.n) as n, any_value(x1 - x0) as em from a join c using (page_id, col) group by all),
r as (select page_id, col, total, em, list(struct_pack(a := y::double, z := (y + h)::double) order by y) as b, 0 as step from cells join t using (page_id, col) where abs(total - n) <= 3 group by all
  union all select page_id, col, total, em, case when len(b) > total
    then list_concat(list_slice(b, 1, spot - 1), [struct_pack(a := b[spot].a, z := b[spot + 1].z)], list_slice(b, spot + 2, len(b)))
    else list_concat(list_slice(b, 1, spot - 1), [struct_pack(a := b[spot].a, z := (b[spot].a + b[spot].z) / 2),
      struct_pack(a := (b[spot].a + b[spot].z) / 2, z := b[spot].z)], list_slice(b, spot + 1, len(b))) end, step + 1
  from (select *, list_transform(b, lambda v, i: case when len(b) > total then coalesce(b[i + 1].z - v.a, 1e9) else v.a - v.z end) as s,
    list_position(s, list_min(s)) as spot from r where len(b) <> total and step < 3)
  where case when len(b) > total then s[spot] <= em * 1.15 else -s[spot] >= em * 1.4 end),
f as (select page_id, col, step, unnest(range(1, len(b) + 1)) as k, unnest(b) as b from r where len(b) = total),
p as (select a.page_id, g.li, g.ci, col, row_number() over (partition by a.page_id, col order by first, g.li, g.ci) as k from a join glyphs g using (page_id, li)),
o as (select g.page_id, g.li, case when f.k is null then 'kept' when step = 0 then 'index' else 'repair' end as anchored,
  (case when f.k is null then g.x else x0 end)::double as x, coalesce(f.b.a, g.y)::double as y, (case when f.k is null then g.w else x1 - x0 end)::double as w, coalesce(f.b.z - f.b.a, g.h)::double as h
  from glyphs g left join p using (page_id, li, ci) left join c using (page_id, col) left join f on f.page_id = p.page_id and f.col = p.col and f.k = p.k)
select page_id, li, anchored, count(*) as n, sum(x) as x, sum(y) as y, sum(w) as w, sum(h) as h from o group by all""", recursive=True, paged=True)
def _(t):
    li, ci, page = F.col("li"), F.col("ci"), F.col("page_id")
    g = t.v_lines.select(F.col("doc_id").alias("page_id"), F.col("line_no").alias("li"), F.floor(F.col("line_no") / 2).alias("col"),
                         F.length("line").alias("n")).where("n > 0").withColumn("ci", F.explode(F.expr("sequence(0, n - 1)"))).drop("n")
    top, at = li % 2 * 1_000_000 + ci * 24, (page * 7 + F.col("col") * 3) % 30
    glyphs = g.select("page_id", "li", "ci", (5000 - F.col("col") * 40 + ci % 3 + F.when(li % 11 == 0, 30).otherwise(0)).alias("x"),
                      (top + ci % 5).alias("y"), F.lit(10).alias("w"), F.lit(20).alias("h"))
    kind, first = (page + F.col("col")) % 6, li % 2 == 0
    here, behind, over = (first & (ci == at + k) for k in range(3))
    cut = ((kind == 2) & here) | ((kind == 5) & (here | over))
    height = F.when((kind == 3) & here, 44).when(cut, 10).otherwise(20)
    kept = g.where(~(((kind == 4) & here) | ((kind == 3) & behind))).select(
        "page_id", "col", (5000 - F.col("col") * 40).alias("x"), top.alias("top"), F.lit(20).alias("w"), height.alias("h"), cut.alias("cut"))
    cells = kept.select("page_id", "col", "x", F.explode(F.when(F.col("cut"), F.array(F.col("top"), F.col("top") + 10)).otherwise(
        F.array("top"))).alias("y"), "w", "h")
    found = anchors.reanchor(glyphs, cells, ["page_id"])
    return found.groupBy("page_id", "li", "anchored").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in "xywh"])
