"""DuckDB SQL that gives the same rows as the queries of the same number."""

from __future__ import annotations

import math

from glyphlake.llm.common import WORD

_LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOW + f", '{WORD}')"

OP1 = rf"""
with cut as (select page_id, url, regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) as rest from pages),
parts as (select page_id, url, {_LOW.format("regexp_extract(rest, '^[^/?#]*')")} as host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path,
  list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*[?]([^#]*)', 1), '&'),
    lambda p: p <> '' and not regexp_matches(p, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))) as kept from cut),
canon as (select *, case when host <> '' then regexp_replace(host, '^(www|m)[.]', '') || regexp_replace(path, '/+$', '')
  || case when len(kept) > 0 then '?' || array_to_string(kept, '&') else '' end end as canonical from parts),
listed as (select distinct canonical as hit from canon where contains(url, 'utm_source=') and canonical is not null),
ruled as (select *, case
  when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
  when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
  when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
  when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/') then 'net/' end as rule from canon)
select page_id, host, path, rule, case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow'
  when hit is not null then 'block' else 'allow' end as verdict, canonical, hit is not null as listed
from ruled left join listed on canonical = hit"""

OP2 = r"""
with rows as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
steps as (select *, lag(role) over (partition by conv_id order by turn, role, text) as before,
  row_number() over (partition by conv_id order by turn desc, role desc, text desc) as back from rows)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length('<|im_start|>') + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n')) + 1
    + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + length('<|im_end|>') + 1)::bigint as formatted_chars,
  bool_and(case when before is null then role in ('system', 'user') when before = 'system' then role = 'user'
    when before = 'user' then role = 'assistant' when before = 'assistant' then role = 'user' else false end)
    and max(role) filter (back = 1) = 'assistant' as valid
from steps group by conv_id"""

OP5 = rf"""
with d as (select doc_id, row_number() over () as r, {_WORDS.format("coalesce(text, '')")} as w from documents),
i as (select coalesce(item_id::varchar, 'null') as item, {_WORDS.format("coalesce(text, '')")} as w from benchmark),
i2 as (select item, w, least(len(w), 10) as size from i where len(w) > 0),
i3 as (select item, size, w, unnest(range(len(w) - size + 1)) as pos from i2),
iw as (select distinct item, size, array_to_string(w[pos + 1 : pos + size], ' ') as words from i3),
sizes as (select distinct size from iw),
p as (select r, w, size, unnest(range(len(w) - size + 1)) as pos from d join sizes on len(w) >= size),
hit as (select distinct r, pos, p.size, item from p join iw on p.size = iw.size
  and array_to_string(p.w[pos + 1 : pos + p.size], ' ') = iw.words),
covered as (select r, count(distinct k) as n_hit from (select r, unnest(range(pos, pos + size)) as k from hit) group by r),
items as (select r, count(distinct item) as n_items, sha256(string_agg(distinct item, ',' order by item)) as h from hit group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  coalesce(h, sha256('')) as items_sha256, n_hit is not null as contaminated
from d left join covered using (r) left join items using (r)"""


_DIGITS = "list_transform(range(8), lambda i: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((n >> (35 - 5 * i)) & 31)::int, 1))"
OP6 = f"""
with p as (select page_id, coalesce(html, '') as body from pages),
h as (select page_id, strlen(body)::bigint as payload_bytes, sha1(body) as h, row_number() over () as r from p),
c as (select r, k, ('0x' || substring(h, k * 10 + 1, 10))::bigint as n from h, range(4) t(k)),
b as (select r, string_agg(array_to_string({_DIGITS}, ''), '' order by k) as payload_digest from c group by r),
f as (select h, max(page_id) as keep from h group by h)
select page_id, payload_bytes, payload_digest, case when page_id is distinct from keep then 'revisit' else 'response' end
  as record_type, case when page_id is distinct from keep then keep end as refers_to
from h join b using (r) join f using (h)"""


def op10(phrases, templates, threshold) -> str:
    def words(text):
        return "[" + ", ".join(f"'{w}'" for w in text.split()) + "]"

    places, labels = [], []
    for phrase, label in phrases.items():
        n = len(phrase.split())
        p = f"list_filter(range(len(w) - {n - 1}), lambda i: w[i + 1 : i + {n}] = {words(phrase)})"
        places.append(p)
        labels.append(f"case when len({p}) > 0 then '{label}' end")
    rows = ", ".join(f"({no}, '{label}', {words(t)}, {len(set(t.split()))}, {math.ceil(threshold * len(set(t.split())) - 1e-9)}, "
                     f"{math.ceil(len(t.split()) / threshold - 1e-9)})" for no, (label, t) in enumerate(templates))
    return rf"""
with d as (select doc_id, row_number() over () as r, {_WORDS.format("coalesce(text, '')")} as w from documents),
base as (select doc_id, r, w, list_concat({", ".join(places)}) as places,
  list_sort(list_distinct(list_filter([{", ".join(labels)}], lambda x: x is not null))) as base from d),
t(no, label, own, n, need, size) as (values {rows}),
m as (select r, no, any_value(label) as label, max(len(list_intersect(w[i + 1 : i + size], own)) / n) as c
  from (select r, w, no, label, own, n, need, size, unnest(list_filter(range(len(w)), lambda i: list_contains(own, w[i + 1]))) as i
    from d join t on len(list_intersect(w, own)) >= need) where len(list_intersect(w[i + 1 : i + size], own)) >= need group by r, no),
found as (select r, list(label) as labels, max(c) as c from m group by r)
select doc_id, len(w)::bigint as n_words, len(places)::bigint as n_base, list_min(places)::bigint as first_word,
  list_max(places)::bigint as last_word, array_to_string(base, ',') as base_labels,
  array_to_string(list_sort(list_distinct(list_concat(base, coalesce(labels, [])))), ',') as labels,
  case when len(places) > 0 then 1.0::double else coalesce(c, 0)::double end as score
from base left join found using (r)"""


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    bit = "lambda a, z: xor(a >> 1, case when a & 1 = 1 then 3988292384::bigint else 0::bigint end)"
    step = f"lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::bigint[], {bit})"
    codes = f"list_transform(string_split({text}, ''), lambda ch: ascii(ch)::bigint)"
    return f"xor(list_reduce(list_concat([4294967295::bigint], {codes}), {step}), 4294967295::bigint)"


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::varchar) || ':' || {value}::varchar, '-')"


OP13 = f"""
with recursive f as (select doc_id, source, text, {" || ".join(map(_field, ("doc_id", "source", "lang", "n_chars")))} as head from documents),
leaf as (select doc_id, coalesce('s' || source, '-') as tree, sha256(head || {_field("text")}) as h, sha256(head ||
  case when doc_id is not null and {_crc32("doc_id::varchar")} % 2 = 0 then {_field("replace(text, chr(10), '')")} else {_field("text")} end) as bad from f),
l as materialized (select *, row_number() over () as r, row_number() over (partition by tree order by doc_id nulls first, h) - 1 as pos,
  count(*) over (partition by tree) as n from leaf),
nodes as (select tree, 0 as level, pos, n, h from l union all
  select tree, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' order by pos)) from nodes where n > 1 group by tree, level, pos // 3, n),
subs as materialized (select tree, h as subroot, row_number() over (order by tree) - 1 as pos, count(*) over () as n from nodes where n = 1),
tops as (select 0 as level, pos, n, subroot as h from subs union all
  select level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' order by pos)) from tops where n > 1 group by level, pos // 3, n),
near as (select r, k.level, k.pos - l.pos // (3 ** k.level)::bigint as d, k.h from l join nodes k on k.tree = l.tree and k.n > 1
    and k.pos // 3 = l.pos // (3 ** (k.level + 1))::bigint
  union all select r, 1000 + k.level, k.pos - s.pos // (3 ** k.level)::bigint, k.h from l join subs s on s.tree = l.tree join tops k on k.n > 1
    and k.pos // 3 = s.pos // (3 ** (k.level + 1))::bigint),
steps as materialized (select r, row_number() over (partition by r order by level) as step, coalesce(string_agg(h, '' order by d) filter (d < 0), '') as a,
  coalesce(string_agg(h, '' order by d) filter (d > 0), '') as b from near group by r, level),
proofs as (select r, count(*) as top, sha256(string_agg(a || b, '' order by step)) as proof from steps group by r),
folds as (select r, 0 as step, bad as h from l union all
  select f.r, f.step + 1, sha256(s.a || f.h || s.b) from folds f join steps s on s.r = f.r and s.step = f.step + 1)
select doc_id, l.h as leaf, subroot, t.h as root, coalesce(proof, sha256('')) as proof_sha256, f.h as folded_root, f.h = t.h as verified
from l join subs using (tree) join tops t on t.n = 1 left join proofs p on p.r = l.r join folds f on f.r = l.r and f.step = coalesce(p.top, 0)"""

OP11 = f"""
with d as (select doc_id, row_number() over () as r, {_WORDS.format("coalesce(text, '')")} as w from documents),
i as (select item_id, row_number() over () as i, {_WORDS.format("coalesce(text, '')")} as w from benchmark),
q as (select i, item_id, term, count(*) as times from (select i, item_id, unnest(w) as term from i) group by all),
o as (select r, term, count(*) as tf from (select r, unnest(w) as term from d) group by all),
s as (select count(*) as n_docs, sum(len(w))::bigint as n_terms from d where len(w) > 0),
g as (select term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::bigint as weight from o, s group by term, n_docs),
m as (select r, doc_id, 25 + (75 * len(w) * n_docs) // n_terms as m from d, s),
f as (select i, item_id, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score
  from q join o using (term) join g using (term) join m using (r) group by i, item_id, r, doc_id)
select item_id, rank::int as rank, doc_id, score from (select *, row_number() over (partition by i order by score desc, doc_id nulls last) as rank
  from f where score > 0) where rank <= 10"""

OP12 = """
with d as (select doc_id, row_number() over () as r, coalesce(doc_id, 9223372036854775807) as k, encode(coalesce(text, '')) as b from documents),
w as (select r, k, pos, array_slice(b, pos + 1, pos + 50) as s from (select r, k, b, unnest(range(octet_length(b) - 49)) as pos from d)),
m as (select s, min(k) as least from w group by s having min(k) < max(k)),
hit as (select r, pos from w join m using (s) where k > least),
n as (select r, pos, coalesce(pos > lag(pos) over (partition by r order by pos) + 50, true)::int as fresh from hit),
i as (select r, pos, sum(fresh) over (partition by r order by pos) as run from n),
s as (select r, min(pos) as a, max(pos) + 50 as z from i group by r, run),
e as (select r, z as a from s union all select r, 0 from d),
g as (select r, a, coalesce((select min(s.a) from s where s.r = e.r and s.a >= e.a), octet_length(d.b)) as z from e join d using (r)),
k as (select r, sha256(unhex(string_agg(hex(array_slice(b, a + 1, z)), '' order by a))) as kept_sha256, sum(z - a) as kept from g join d using (r) group by r),
c as (select r, count(*) as n_spans from s group by r)
select doc_id, octet_length(b)::bigint as n_bytes, (octet_length(b) - kept)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, kept_sha256
from d join k using (r) left join c using (r)"""
