"""S*, K12, M*: records, messages, payloads and paragraphs.

The given tables hold no archives, so their words are written as the JSON of one and read back.
"""

from pyspark.sql import functions as F

from glyphlake.catalog.registry import query
from glyphlake.catalog.views import WORD_BREAK, words_of
from glyphlake.functions import fixed
from glyphlake.operators import boxes
from glyphlake.session import scratch_path
from glyphlake.sources import html, messages, records

_ITEMS = ("i as (select item_id, unnest(range(len(l)))::int as pos, unnest(l) as word from (select item_id, list_filter("
          f"string_split_regex(lower(text), '{WORD_BREAK}'), lambda w: w <> '') l from benchmark))")


def _bank(t):
    """Per item one bank of [word, reading, "", "", score, gloss]; short words give short records."""
    def rec(w, i):
        full = F.array(w, F.left(w, F.lit(3)), F.lit(""), F.lit(""), F.when(i % 2 == 0, F.length(w).cast("string")), F.upper(w))
        return F.when(F.length(w) < 3, F.array(w)).otherwise(full)

    return t.benchmark.select("item_id", F.to_json(F.transform(words_of("text"), rec)).alias("payload"))


def _metas(t, tag, body):
    """One bank per dictionary row with a single meta record."""
    return records.bank_records(t.v_dict.select("pos", F.concat(
        F.lit('[["'), "key", F.lit('","'), tag, F.lit('",'), body, F.lit('],["short"],7]')).alias("payload")).drop("pos"), "payload", 3)


@query("s02_bank_records", f"with {_ITEMS} select item_id, pos, word, 6 as n from i where length(word) >= 3")
def _(t):
    rows = records.bank_records(_bank(t), "payload", 6)
    return rows.select("item_id", "pos", F.col("rec")[0].alias("word"), F.size("rec").alias("n"))


@query("s03_load_terms", f"""
with {_ITEMS}, r as (select *, substring(word, 1, 3) as reading from i where length(word) >= 3),
k as (select *, word as key from r union all select *, reading from r where reading <> word)
select item_id, pos, key, reading, case when pos % 2 = 0 then length(word) else 0 end::bigint as score, upper(word) as gloss_json, 'A' as dict from k""")
def _(t):
    return records.load_terms(records.bank_records(_bank(t), "payload", 6), F.lit("A"))


@query("s04_load_kanji", """
select char, on_yomi, kun_yomi, meanings[1] || '|x' as meanings, dict from v_char""")
def _(t):
    text = F.concat(F.lit('[["'), "char", F.lit('","'), "on_yomi", F.lit('",null,"",["'), F.col("meanings")[0],
                    F.lit('","x"]],["'), "char", F.lit('"],["","a","b","",[]]]'))
    rows = records.bank_records(t.v_char.select("dict", text.alias("payload")), "payload", 1)
    return records.load_kanji(rows, F.col("dict")).withColumn("meanings", F.array_join("meanings", "|"))


@query("s05_load_pitch", """
select key as term, reading, (length(key) % 4)::int as position from v_dict where score % 2 = 0""")
def _(t):
    tag = F.when(F.col("score") % 2 == 0, "pitch").otherwise("freq")
    body = F.concat(F.lit('{"reading":"'), "reading", F.lit('","pitches":[{"position":'), (F.length("key") % 4).cast("string"),
                    F.lit('},{"position":"H"},{"position":"2"},{"position":1.5}]}'))
    return records.load_pitch(_metas(t, tag, body))


@query("s06_load_freq", """
select key as term, 'f' as source, min(pos)::bigint as value from v_dict where pos % 5 < 4 group by key""")
def _(t):
    pos = F.col("pos").cast("string")
    shapes = [pos, F.concat(F.lit('{"value":'), pos, F.lit("}")), F.concat(F.lit('{"frequency":'), pos, F.lit("}")),
              F.concat(F.lit('{"reading":"r","frequency":{"value":'), pos, F.lit('}}')), F.concat(F.lit('"'), pos, F.lit('x"'))]
    body = F.lit(None).cast("string")
    for i, shape in enumerate(shapes):
        body = F.when(F.col("pos") % 5 == i, shape).otherwise(body)
    return records.load_freq(_metas(t, F.lit("freq"), body), F.lit("f"))


@query("s07_read_ndjson", """
select event_id as id, regexp_extract(props, '[0-9]+')::int as k from events where event_id % 7 > 1""")
def _(t):
    line = (F.when(F.col("event_id") % 7 == 0, F.lit('{"id": 1, "k"')).when(F.col("event_id") % 7 == 1, F.lit("  "))
            .otherwise(F.concat(F.lit('{"id": '), "event_id", F.lit(", "), F.substr("props", F.lit(2)))))
    path = scratch_path(t.spark, "messages")
    t.events.select(line.alias("value")).write.text(path)
    return messages.read_ndjson(t.spark, path, "id bigint, k int")


@query("s08_route_messages", """
select event_id, case when event_type = 'error' and value < 10 then 'crop' when event_type = 'signup' then 'idle'
  when event_type = 'purchase' then 'other' when value < 30 then 'heartbeat' else 'payload' end as kind from events""")
def _(t):
    kind, value = F.col("event_type"), F.col("value")
    frame = F.when(kind != "purchase", value)
    return t.events.select("event_id", messages.route(
        (kind == "error") & (value < 10), kind == "signup", frame, value < 30).alias("kind"))


def _reads(t):
    """Glyphs with broken positions and sizes, and confidences outside 0..1."""
    conf = F.when(F.col("ci") % 4 != 3, F.col("ci") % 5 / 3.0 - 0.1)
    return t.v_glyph.select("page_id", "li", "ci", "ch", (F.col("x") + 0.7).alias("x"), (F.col("y") - 0.25).alias("y"),
                            (F.col("w") - 0.5).alias("w"), (F.col("h") + 0.2).alias("h"), conf.alias("conf"))


_READ = """select page_id, li, ci, ch, x::int as x, trunc(y - 0.25)::int as y, w::int as w, h + 1 as h,
  case when ci % 4 <> 3 then case ci % 5 when 0 then 0.0 when 1 then 0.23 when 2 then 0.57 when 3 then 0.9 else 1.0 end end::double as conf from v_glyph"""


@query("s09_flatten_payload", f"""
with r as ({_READ}) select page_id, li, count(*) as n, md5(string_agg(ch, '' order by ci)) as text, sum(x)::bigint as x, sum(y)::bigint as y, sum(w)::bigint as w,
  sum(h)::bigint as h, sum(round(conf * 100)::bigint)::bigint as conf from r group by page_id, li""", paged=True)
def _(t):
    """Pages written as messages and read back, told line by line."""
    path = scratch_path(t.spark, "pages")
    messages.assemble_payload(_reads(t), ["page_id"]).write.option("compression", "zstd").parquet(path)
    # A message is far larger than its page's text but packs well, so it is dealt before it is spelled out.
    rows = messages.flatten_payload(t.deal(t.spark.read.parquet(path), "page_id"), ["page_id"])
    return rows.groupBy("page_id", "li").agg(
        F.count("*").alias("n"), F.md5(F.expr("listagg(ch, '') within group (order by ci)")).alias("text"),
        *[F.sum(c).alias(c) for c in "xywh"], F.sum(F.round(F.col("conf") * 100).cast("bigint")).alias("conf"))


@query("s10_assemble_payload", f"""
with r as ({_READ}), l as (select page_id, li, '{{"li":' || li || ',"chars":[' || string_agg('{{"c":' || to_json(ch)::varchar || ',"x":' || x || ',"y":' || y
  || ',"w":' || w || ',"h":' || h || coalesce(',"conf":' || conf, '') || '}}', ',' order by ci) || ']}}' as line from r group by page_id, li)
select page_id, md5('{{"lines":[' || string_agg(line, ',' order by li) || ']}}') as payload_md5 from l group by page_id""", paged=True)
def _(t):
    return messages.assemble_payload(_reads(t), ["page_id"]).select("page_id", F.md5("payload").alias("payload_md5"))


_PARAS = r"""b as (select page_id, unnest(list_transform(string_split_regex(regexp_replace(html,
    '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>', '', 'g'), '(?i)<p(?:\s[^>]*)?>')[2:],
    lambda b: string_split_regex(regexp_replace(b, '(?is)</p\s*>.*$', ''), '(?i)<br\s*/?>'))) as parts, unnest(range(1000000)[:len(
    string_split_regex(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>', '', 'g'), '(?i)<p(?:\s[^>]*)?>')) - 1]) as b from pages),
p as (select page_id, b, unnest(parts) as part, unnest(range(len(parts))) as k from b),
n as (select page_id, (row_number() over (partition by page_id order by b, k) - 1)::int as para_no, part from p)
"""


@query("s12_html_paragraphs", f"""
with {_PARAS}, x as (select page_id, para_no, translate(replace(replace(replace(replace(replace(replace(
  regexp_replace(part, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', chr(160)), '&amp;', '&'),
  chr(8203) || chr(65279) || chr(13) || chr(10) || chr(9), '') as text from n where not regexp_matches(part, '(?i)<img\\b'))
select page_id, para_no, text, 1 as n from x where text <> ''""")
def _(t):
    rows = html.html_paragraphs(t.pages, "page_id", "html")
    return rows.select("page_id", "para_no", html.plain_text("segments").alias("text"), F.size("segments").alias("n"))


@query("s15_read_terms", """
select p_name as key, case when p_size % 2 = 0 then p_brand else '' end as reading,
  case when p_size % 2 = 0 then 'P' when p_size % 3 = 0 then 'KANJIDIC' else '' end as dict,
  case when p_size % 2 = 0 then p_partkey else 0 end as score, p_type as gloss_json from part""")
def _(t):
    new, old = t.part.where("p_size % 2 = 0"), t.part.where("p_size % 2 <> 0")
    return records.read_terms(
        new.select(F.col("p_name").alias("key"), F.col("p_brand").alias("reading"), F.lit("P").alias("dict"),
                   F.col("p_partkey").alias("score"), F.col("p_type").alias("gloss_json")),
        old.select(F.col("p_name").alias("key"), F.col("p_type").alias("sense"), (F.col("p_size") % 3 == 0).alias("is_kanji")))


@query("s16_media_assets", """
with m as (select page_id, regexp_replace(url, '[?#].*$', '') || case page_id % 4 when 0 then '.PNG' when 1 then '.svg' when 2 then '' else '.bin7' end as path from pages),
e as (select *, lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) as ext from m)
select page_id, ext, case ext when 'png' then 'image/png' when 'svg' then 'image/svg+xml' else 'application/octet-stream' end as content_type from e where ext <> ''""".replace("\\\\", "\\"))
def _(t):
    k = F.col("page_id") % 4
    suffix = F.when(k == 0, ".PNG").when(k == 1, ".svg").when(k == 2, "").otherwise(".bin7")
    rows = t.pages.select("page_id", F.concat(F.regexp_replace("url", "[?#].*$", ""), suffix).alias("path"))
    return records.media_assets(rows, "path", fixed.IMAGE_TYPES, fixed.OTHER_TYPE).drop("path")


@query("k12_register", """
with k(stem, label, ord) as (values ('Brand#7', 'Seven', 0), ('Brand#3', 'Three', 1)), a as (select p_partkey, p_brand || '-' || p_partkey as stem,
  case when p_size % 2 = 0 then p_name else '' end as title, p_brand from part)
select a.p_partkey, coalesce(k.label, nullif(title, ''), a.p_brand) as label, row_number() over (order by k.ord is null, coalesce(k.ord, 0), a.p_brand, a.p_partkey) as place
from a left join k on a.p_brand = k.stem""")
def _(t):
    known = t.spark.createDataFrame([("Brand#7", "Seven", 0), ("Brand#3", "Three", 1)], "stem string, label string, ord int")
    rows = t.part.select("p_partkey", "p_brand", F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise("").alias("title"))
    return records.register(rows, known, "p_brand", "title", ["p_partkey"]).select("p_partkey", "label", "place")


@query("m01_transforms", """
select rect_id, 800 - y - h as flipped, 1400 - y - h as ux, x as uy, h as uw, w as uh, x + 30 - 12 as wx, y + 40 - 16 as wy from v_rect""")
def _(t):
    x, y, w, h = (F.col(c) for c in "xywh")
    back = boxes.unrotate_ccw(x, y, w, h, F.lit(1400))
    local = boxes.to_window(x, y, F.lit(30), F.lit(40), F.lit(12), F.lit(16))
    return t.v_rect.select("rect_id", boxes.flip_y(y, h, F.lit(800)).alias("flipped"), *[v.alias(f"u{k}") for k, v in back.items()],
                           *[v.alias(f"w{k}") for k, v in local.items()])


@query("m02_subdivide", r"""
with c as (select p_partkey, p_size, length(p_name) as n, unnest(range(length(p_name)))::int as ci, unnest(string_split(p_name, '')) as ch from part)
select p_partkey, ci, ch, p_size + 90.0::double * ci / n as x, 90.0::double / n as w from c where not regexp_matches(ch, '^\s$')""")
def _(t):
    return boxes.subdivide(t.part.select("p_partkey", "p_name", F.col("p_size").alias("x"), F.lit(90.0).alias("w")), "p_name")


@query("m07_job_progress", """
with l as (select user_id, max_by(value, (us, event_id)) as v, max_by(event_type, (us, event_id)) as phase, max_by(event_id, (us, event_id)) as e from v_events group by user_id)
select user_id, phase, floor(v * 100 / nullif(case when e % 3 = 0 then 0 else 200 end, 0) + 0.5)::int as percent from l""")
def _(t):
    rows = t.v_events.withColumn("total", F.when(F.col("event_id") % 3 == 0, 0).otherwise(200))
    return messages.job_progress(rows, "user_id", ["us", "event_id"], "value", "total", "event_type")
