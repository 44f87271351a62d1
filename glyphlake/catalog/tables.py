"""P*, A*, K*: filters, reports and samples over whole tables."""

from pyspark.sql import functions as F

from glyphlake.catalog.pages import DISPLAYS, PARTS
from glyphlake.catalog.registry import query
from glyphlake.operators import filters, pages, preferences, reports


@query("p03_sanitize", "select event_id, case when value between 10 and 50 then value else 25.0::double end as value from events")
def _(t):
    return t.events.select("event_id", filters.in_range_or(F.col("value"), 10, 50, 25.0).alias("value"))


_SETTINGS = """e as (select event_id as e, '{"target":{"bundle":' || case event_id % 4 when 0 then '"app' || event_id || '"' when 1 then '12' when 2 then '""' else 'null' end
  || ',"windowId":' || case event_id % 3 when 0 then (event_id - 6)::varchar when 1 then '"x"' else event_id || '.5' end
  || case event_id % 6 when 0 then ',"label":"L"' else '' end || '},"trigger":' || case event_id % 7 when 0 then '5' else
    '{"modifier":"' || case event_id % 5 when 0 then 'shift' when 1 then 'command' else 'evil' end || '","mode":' || case event_id % 2 when 0 then '"hover"' else '7' end
    || ',"hoverDelayMs":' || event_id * 7 % 3000 || '}' end || ',"images":' || case event_id % 5 when 0 then '0' when 1 then '"y"' when 2 then 'null' when 3 then 'false' else '[]' end
  || case event_id % 3 when 0 then '' else ',"engine":"' || case event_id % 4 when 0 then 'auto' else 'rm' end || '","interval":' || event_id % 130 / 10 end
  || ',"voting":{"passes":' || event_id % 12 || ',"everyN":"a"},"dictionaries":[{"name":"d' || event_id || '","enabled":"yes"},{"name":"","enabled":true},null,{"enabled":true},{"name":"z","enabled":0}],"more":'
  || event_id || '}' as j from events)"""


@query("p03_sanitize_settings", f"""
with {_SETTINGS}, t as (select *, e % 7 <> 0 as is_object, case when e % 4 = 0 then 'app' || e end as bundle, j->'$.interval' as i from e)
select e as event_id, bundle, case when e % 3 = 0 and e > 6 then e - 6 end as window_id, case when e % 6 = 0 then 'L' else coalesce(bundle, 'not set') end as label,
  case when is_object then case e % 5 when 0 then 'shift' when 1 then 'command' else 'option' end end as modifier,
  case when is_object then case when e % 2 = 0 then 'hover' else 'hold' end end as mode,
  case when is_object then case when e * 7 % 3000 between 50 and 2000 then e * 7 % 3000 else 300 end end::double as hover,
  e % 5 in (1, 4) as images, case when e % 3 <> 0 then case when e % 4 = 0 then 'auto' else 'vision' end end as engine,
  case when e % 3 <> 0 then case when e % 130 / 10 between 0.1 and 10 then e % 130 / 10 else 2 end end::double as "interval",
  (case when e % 12 between 1 and 9 then e % 12 else 3 end)::double as passes, 5::double as every_n, 'd' || e || ':true,z:false' as dictionaries,
  case when is_object then 'more=' || e else 'more=' || e || ',trigger=5' end as rest from t""")
def _(t):
    e = F.col("event_id")
    # A setting takes far longer than its row is wide, and a file may be one task: the rows are dealt first.
    ids = t.events.select("event_id").repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")), "event_id")
    rows = ids.select("event_id", F.expr("""concat('{"target":{"bundle":', case event_id % 4 when 0 then concat('"app', event_id, '"') when 1 then '12' when 2 then '""' else 'null' end,
      ',"windowId":', case event_id % 3 when 0 then string(event_id - 6) when 1 then '"x"' else concat(event_id, '.5') end, if(event_id % 6 = 0, ',"label":"L"', ''), '},"trigger":',
      if(event_id % 7 = 0, '5', concat('{"modifier":"', case event_id % 5 when 0 then 'shift' when 1 then 'command' else 'evil' end, '","mode":', if(event_id % 2 = 0, '"hover"', '7'),
      ',"hoverDelayMs":', event_id * 7 % 3000, '}')), ',"images":', case event_id % 5 when 0 then '0' when 1 then '"y"' when 2 then 'null' when 3 then 'false' else '[]' end,
      if(event_id % 3 = 0, '', concat(',"engine":"', if(event_id % 4 = 0, 'auto', 'rm'), '","interval":', event_id % 130 / 10)), ',"voting":{"passes":', event_id % 12,
      ',"everyN":"a"},"dictionaries":[{"name":"d', event_id, '","enabled":"yes"},{"name":"","enabled":true},null,{"enabled":true},{"name":"z","enabled":0}],"more":', event_id, '}')""").alias("j"))
    current = {"modifier": "option", "mode": "hold", "hoverDelayMs": 300, "engine": "vision", "interval": 2, "passes": 3, "everyN": 5}
    s = preferences.sanitize_settings(rows, "j", current)
    named = F.transform("settings.dictionaries", lambda d: F.concat(d["name"], F.lit(":"), d["enabled"].cast("string")))
    rest = F.array_sort(F.transform(F.map_entries("rest"), lambda x: F.concat(x["key"], F.lit("="), x["value"])))
    return s.select(e, "settings.target.bundle", F.col("settings.target.windowId").alias("window_id"), "settings.target.label", "settings.trigger.modifier",
                    "settings.trigger.mode", F.col("settings.trigger.hoverDelayMs").alias("hover"), "settings.images", "settings.engine", "settings.interval",
                    "settings.voting.passes", F.col("settings.voting.everyN").alias("every_n"), F.array_join(named, ",").alias("dictionaries"), F.array_join(rest, ",").alias("rest"))


@query("p04_validate_requests", """
select role, count(*) as n_rejects, min_by(conv_id, (conv_id, turn)) as conv_id, min_by(turn, (conv_id, turn)) as turn
from conversations where not coalesce(length(text) <= 512, false) group by role""")
def _(t):
    _, rejects = filters.validate_requests(t.conversations, "text", "role", ["conv_id", "turn"])
    return rejects.select("role", "n_rejects", "first.conv_id", "first.turn")


@query("p04_valid_requests", "select conv_id, turn from conversations where length(text) <= 512")
def _(t):
    return filters.validate_requests(t.conversations, "text", "role", ["conv_id", "turn"])[0].select("conv_id", "turn")


@query("p05_valid_regions", "select rect_id from v_rect where w > 0 and w < 300 and h > 0 and h < 300")
def _(t):
    return t.v_rect.where(filters.valid_region(F.col("x"), F.col("y"), F.col("w"), F.col("h"), 300)).select("rect_id")


@query("p06_script_filter", "select doc_id from documents where len(regexp_extract_all(text, '[à-öø-ÿ]')) >= 10")
def _(t):
    return t.documents.where(filters.has_script(F.col("text"), "à-öø-ÿ")).select("doc_id")


@query("p07_every_nth", "select doc_id from (select doc_id, row_number() over (order by doc_id) as n from documents) where (n - 1) % 10 = 0")
def _(t):
    return filters.every_nth(t.documents.select("doc_id"), [], ["doc_id"], 10)


@query("p10_drop_blank_lines", r"""
select doc_id, line_no, regexp_replace(line, '^\s+|\s+$', '', 'g') as line from v_lines where regexp_replace(line, '^\s+|\s+$', '', 'g') <> ''""")
def _(t):
    return filters.drop_blank_lines(t.v_lines)


@query("p11_latest_asset", """
select b as repo, asset, case when asset is null then 'no matching asset' end as error from (values ('Brand#11'), ('Brand#22'), ('none')) r(b)
left join (select p_brand, max(p_name) as asset from part where regexp_matches(p_name, '[aeiou]') group by p_brand) on b = p_brand""")
def _(t):
    rules = t.spark.createDataFrame([(b, "[aeiou]") for b in ("Brand#11", "Brand#22", "none")], "repo string, pattern string")
    return filters.latest_asset(t.part, rules, "p_brand", "p_name")


@query("a01_classify_archives", """
with m as (select user_id, us, event_id, case event_type when 'purchase' then 'term' when 'error' then 'kanji' when 'view' then 'pitch' else 'freq' end as tag from v_events)
select user_id, case when bool_or(tag = 'kanji') then 'kanji' when bool_or(tag = 'term') then 'term'
  else min_by(tag, event_id) filter (tag in ('pitch', 'freq')) end as kind from m group by user_id""")
def _(t):
    kind = F.col("event_type")
    tag = F.when(kind == "purchase", "term").when(kind == "error", "kanji").when(kind == "view", "pitch").otherwise("freq")
    return reports.classify_archives(t.v_events.withColumn("tag", tag), "user_id", "tag", "event_id")


@query("a02_index_stats", """
select dict, count(*) as n, count(distinct key) as n_keys, count(distinct gloss_key) as n_glosses from v_dict group by rollup (dict)""")
def _(t):
    return reports.index_stats(t.v_dict)


@query("a03_manifest", """
with r as (select dict, 0 as source, min(pos) as first from v_dict group by dict
  union all select source, 1, min(value) from v_freq group by source)
select dict, min((source, first))[1] as source, min((source, first))[2] as first from r group by dict""")
def _(t):
    freq = t.v_freq.select(F.col("source").alias("dict"), F.col("value").alias("pos"))
    return reports.manifest(t.v_dict, freq)


@query("a04_dedup_glosses", "select sha1(text) as gloss_key, min(doc_id) as first, count(*) as n from documents group by text")
def _(t):
    return reports.dedup_glosses(t.documents.select("doc_id", "text"), "text", "doc_id")[0].drop("text")


@query("a06_cer_report", """
with s as (select category, levenshtein(truth, hyp) as d, length(truth) as n from v_cer where truth <> '')
select coalesce(category, 'ALL') as category, count(*) as n, sum(d)::bigint as dist, sum(d) / sum(n) as micro,
  case when category is not null then avg(d / n) end as mean from s group by rollup (category)""")
def _(t):
    return reports.cer_report(t.v_cer)


@query("a13_choose_front", f"""
with {PARTS}, s as (select snap, rect_id, z, x + (i + 0.5::double) * w / 20 as px, y + (j + 0.5::double) * h / 20 as py from v_rect, range(20) a(i), range(20) b(j) where w > 200 and h > 200),
v as (select snap, rect_id, z, count(*) filter (((px >= 0 and px < 800 and py >= 0 and py < 700) or (px >= 900 and px < 1700 and py >= 100 and py < 900))
  and not exists (select 1 from o where o.snap = s.snap and o.rect_id = s.rect_id and px >= x0 and px < x1 and py >= y0 and py < y1)) as n from s group by 1, 2, 3)
select snap, min_by(rect_id, z) as rect_id from v where n >= 200 group by snap""")
def _(t):
    visible = pages.visible_fraction(t.v_rect, ["snap"], "rect_id", "z", DISPLAYS)
    return reports.choose_front(t.v_rect, visible, "snap")


@query("a14_by_owner", """
select snap, count(*) as n, bool_or(layer = 0) as on_screen, max_by(rect_id, (w * h, -rect_id)) as largest
from v_rect where w >= 300 and h >= 200 group by snap""")
def _(t):
    return reports.by_owner(t.v_rect, "snap")


@query("a19_agreement_report", r"""
with p as (select case when length(truth) < 40 then 'short' else 'long' end as bucket, truth, hyp,
  regexp_replace(regexp_replace(truth, '^\pP+', ''), '\pP+$', '') as a, regexp_replace(regexp_replace(hyp, '^\pP+', ''), '\pP+$', '') as b from v_cer)
select bucket, count(*) as n, avg((truth = hyp)::int::double) as equal, avg((a = b)::int::double) as equal_bare from p group by bucket""")
def _(t):
    return reports.agreement_report(t.v_cer, F.when(F.length("truth") < 40, "short").otherwise("long"))


@query("a19_agreement_histogram", r"""
with p as (select case when length(truth) < 40 then 'short' else 'long' end as bucket, truth, hyp,
  regexp_replace(regexp_replace(truth, '^\pP+', ''), '\pP+$', '') as a, regexp_replace(regexp_replace(hyp, '^\pP+', ''), '\pP+$', '') as b from v_cer),
d as (select bucket, levenshtein(truth, hyp) as distance, 1 as n, 0 as bare from p union all select bucket, levenshtein(a, b), 0, 1 from p)
select bucket, distance::int as distance, sum(n)::bigint as n, sum(bare)::bigint as n_bare from d group by bucket, distance""")
def _(t):
    return reports.agreement_histogram(t.v_cer, F.when(F.length("truth") < 40, "short").otherwise("long"))


@query("a20_latency", """
with d as (select event_type, us - lag(us) over (partition by user_id order by us, event_id) as d from v_events)
select event_type, quantile_cont(d, 0.5)::double as p50, quantile_cont(d, 0.95)::double as p95 from d where d is not null group by event_type""")
def _(t):
    from glyphlake.ordered import Ordered
    rows = Ordered(t.v_events, ["user_id"], ["us", "event_id"]).scan(lag={"was": "us"}).df.where("was is not null")
    return reports.latency(rows.withColumn("d", F.col("us") - F.col("was")), ["event_type"], "d")


@query("a23_unique_probes", """
with p as (select p_partkey, p_name, substring(p_name, 1, 10) as needle from part), n as (select distinct needle from p),
c as (select n.needle, count(*) as n from n join p on contains(p_name, n.needle) group by n.needle)
select p_partkey, p.needle from (select p_partkey, substring(p_name, 1, 10) as needle from part) p join c on c.needle = p.needle where c.n <= 1""")
def _(t):
    return reports.unique_probes(t.part, "p_partkey", "p_name", 10)


@query("a24_corpus_totals", """
select count(*) as passages, sum(len(string_split(text, chr(10))))::bigint as paragraphs, sum(length(text))::bigint as characters from documents""")
def _(t):
    return reports.corpus_totals(t.documents)


@query("j22_missing_reports", """
with l as (select doc_id, coalesce(quality, 0) = 0 as empty from labels)
select doc_id, case when empty is null then 'no truth' when empty then 'empty truth' else 'no hypothesis' end as reason
from documents left join l using (doc_id) where empty is null or empty or length(text) <= 1500""")
def _(t):
    return reports.missing_reports(t.documents, t.labels, t.documents.where(F.length("text") > 1500), "doc_id", F.coalesce("quality", F.lit(0)) == 0)


@query("k10_sample_per_category", """
select doc_id, source from (select *, row_number() over (partition by source order by md5('7' || doc_id), doc_id) as n from documents) where n <= 5""")
def _(t):
    return reports.sample_per_category(t.documents.select("doc_id", "source"), "source", "doc_id", 5, "7")
