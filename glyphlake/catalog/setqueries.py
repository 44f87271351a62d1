"""U*: set operations over dictionary tables."""

from pyspark.sql import functions as F

from glyphlake.catalog.registry import query
from glyphlake.operators import setops


@query("u01_prune", "select key, gloss_key, dict from v_dict where dict is distinct from 'd1'")
def _(t):
    return setops.prune({"terms": t.v_dict}, "d1")["terms"].select("key", "gloss_key", "dict")


@query("u02_sweep_orphans", "select gloss_key, gloss_key in (select gloss_key from v_dict where dict <> 'd1') as kept from v_gloss")
def _(t):
    kept, dropped = setops.sweep_orphans(t.v_gloss, setops.prune({"terms": t.v_dict}, "d1")["terms"])
    return (kept.select("gloss_key", F.lit(True).alias("kept"))
            .unionByName(dropped.select("gloss_key", F.lit(False).alias("kept"))))


@query("u03_tables_differ", """
select key, gloss_key, count(*) as extra, 'left' as side from v_dict where length(key) <= 3 group by key, gloss_key""")
def _(t):
    rows = t.v_dict.select("key", "gloss_key")
    return setops.tables_differ(rows, rows.where(F.length("key") > 3))


@query("u04_golden_diff", """
select p_partkey, case when p_size % 4 = 0 then 'missing' when p_size % 4 = 1 then 'changed' when p_size % 4 = 2 then 'added'
  else 'identical' end as status from part""")
def _(t):
    k = F.col("p_size") % 4
    base = t.part.where(k != 2).select("p_partkey", "p_name")
    now = t.part.where(k != 0).select("p_partkey", F.when(k == 1, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name")).alias("p_name"))
    return setops.golden_diff(base, now, ["p_partkey"], "p_name")


@query("u05_shared_ratio", """
with l as (select doc_id, doc_id - 1 as prev, line as text from v_lines),
o as (select distinct doc_id, text from l), s as (select doc_id, count(*) as n from o group by doc_id),
h as (select l.doc_id, l.prev, count(*) as n, count(o.text) as shared from l left join o on o.doc_id = l.prev and o.text = l.text group by 1, 2)
select h.doc_id, h.n, coalesce(s.n, 0) as n_prev, shared,
  case when s.n is null then 0.0::double else shared / greatest(h.n, s.n) end as ratio from h left join s on s.doc_id = h.prev""")
def _(t):
    lines = t.v_lines.select("doc_id", (F.col("doc_id") - 1).alias("prev"), F.col("line").alias("text"))
    return setops.shared_ratio(lines, ["doc_id"], ["prev"])


@query("u06_split_import", """
select p_partkey, p_size % 3 <> 0 as added, case when p_size % 3 = 0 then 'no recognisable banks' end as error from part""")
def _(t):
    rows = t.part.select("p_partkey", F.when(F.col("p_size") % 3 != 0, F.col("p_type")).alias("kind"))
    added, failed = setops.split_import(rows)
    return (added.select("p_partkey", F.lit(True).alias("added"), F.lit(None).cast("string").alias("error"))
            .unionByName(failed.select("p_partkey", F.lit(False).alias("added"), "error")))


@query("u07_first_nonempty", """
select key, gloss_key from v_dict where dict = 'd1' union all select key, gloss_key from v_dict where dict <> 'd1'
  and key not in (select key from v_dict where dict = 'd1')""")
def _(t):
    rows = t.v_dict.select("key", "gloss_key", "dict")
    return setops.first_nonempty(["key"], rows.where("dict = 'd1'").drop("dict"), rows.where("dict <> 'd1'").drop("dict"))
