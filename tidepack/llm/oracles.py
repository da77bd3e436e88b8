"""DuckDB SQL for the queries that SQL can express."""

from .licences import KNOWN, sql_canonical, sql_joined

#: Sainte-Lague of `total` seats among rows (g, k, share), as a CTE body that adds quota. Highest quotients are
#: found here by generating more of them than any party can win.
_SEATS = """
  {name}_b as (select *, sum(share) over (partition by g) as s, max(total) over (partition by g) as t from {name}),
  {name}_q as (select g, k, share / (2 * j.i + 1) as q, t, j.i from {name}_b, lateral (select unnest(generate_series(0, cast(ceil(case when s > 0 and t > 0 then share * t / s + 2 else 0 end * 1.2) as bigint) + 8)) as i) j where share > 0),
  {name}_w as (select g, k, count(*) as quota from (select *, row_number() over (partition by g order by q desc, k, i) as r from {name}_q) where r <= t group by g, k),
  {name}_s as (select b.*, coalesce(w.quota, 0) as quota from {name}_b b left join {name}_w w on b.g = w.g and b.k = w.k),
"""

OP7 = """
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as size, md5('mix-1:' || coalesce(cast(doc_id as varchar), md5(coalesce(text, '')))) as draw from documents),
  src as (select source, sum(size)::bigint as source_size, row_number() over (order by source collate "binary" nulls last) as place from sized group by source),
  w as (select *, case (place - 1) % 3 when 0 then 3 when 1 then 1 else 2 end as weight, 1.5::double * sum(source_size) over () as total from src),
  r as (select *, 2 * source_size / weight as ratio from w),
  l as (select *, (total - coalesce(sum(2 * source_size) over (order by ratio, place rows between unbounded preceding and 1 preceding), 0)) / sum(weight) over (order by ratio, place rows between current row and unbounded following) as level from r),
  lv as (select min(level) as level from (select level, row_number() over (order by ratio, place) as o from l where level <= ratio) where o = 1),
  tg as (select source, source_size, place, least((2 * source_size)::double, coalesce(weight * (select level from lv), 0.0))::double as target, total from l),
  a as (select 0 as g, place as k, target as share, round(total / 64)::bigint as total, source, source_size, target from tg),
""" + _SEATS.format(name="a") + """
  so as (select *, greatest(1, ceil(source_size / 2097152))::bigint as shards from a_s),
  pl as (select z.*, so.k as place, so.source_size, so.target, so.quota as source_quota, ('0x' || substr(draw, 1, 8))::bigint % so.shards as shard from sized z join so on z.source is not distinct from so.source),
  c as (select place as g, shard as k, sum(size)::double as share, max(source_quota) as total from pl group by place, shard),
""" + _SEATS.format(name="c") + """
  sh as (select g, k, share::bigint as shard_size, least(quota * 64, 2 * share::bigint) as words, ('0x' || substr(md5('mix-1:' || g || ':' || k), 1, 8))::bigint % greatest(1, ceil(share / 64))::bigint * 64 as arc_from from c_s),
  ar as (select *, case when shard_size > 0 then words // shard_size else 0 end as passes from sh),
  lain as (select pl.*, coalesce(sum(size) over (partition by place, shard order by draw, doc_id, size rows between unbounded preceding and 1 preceding), 0) as pos from pl),
  f as (select lain.*, ar.*, arc_from + words - passes * shard_size as arc_to from lain join ar on lain.place = ar.g and lain.shard = ar.k)
select doc_id, size::bigint as size, source_size, target,
  (passes * size + greatest(0, least(size, arc_to - pos)) - greatest(0, least(size, arc_from - pos)) + greatest(0, least(size, arc_to - shard_size - pos)))::bigint as taken
from f
"""

#: All pairs that share a shingle, counted in full, and the closure of the links.
OP2 = """
with recursive
  w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as a from documents),
  sh as (select distinct doc_id, s from (select doc_id, unnest(case when len(a) = 0 then [] when len(a) < 3 then [array_to_string(a, ' ')] else list_transform(range(1, len(a) - 1), lambda i: a[i] || ' ' || a[i + 1] || ' ' || a[i + 2]) end) as s from w)),
  n as (select doc_id, count(*) as n from sh group by doc_id),
  c as (select x.doc_id as u, y.doc_id as v, count(*) as c from sh x join sh y on x.s = y.s and x.doc_id < y.doc_id group by x.doc_id, y.doc_id),
  l as (select u, v from c join n a on u = a.doc_id join n b on v = b.doc_id where 100 * c >= 85 * (a.n + b.n - c)),
  e as (select u, v from l union all select v, u from l),
  r(doc_id, comp) as (select doc_id, doc_id from documents union select e.v, r.comp from r join e on r.doc_id = e.u),
  m as (select doc_id, min(comp) as component_id from r group by doc_id)
select d.doc_id, coalesce(n.n, 0) as n_shingles, component_id, d.doc_id = component_id as kept
from documents d left join n using (doc_id) join m using (doc_id)
"""

_ESCAPED = r"regexp_replace(regexp_replace(text, '\[(\\*/?INST\])', '[\\\1', 'g'), '<(\\*/?s>)', '<\\\1', 'g')"
OP4 = f"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  (sum(length('[INST]' || url_encode(role) || chr(10) || {_ESCAPED} || '[/INST]')) + 4)::bigint as formatted_chars
from c group by conv_id
"""

_LINES, _JOIN = sql_canonical("text"), "trim(regexp_replace({}, '[ \n]+', ' ', 'g'))"
_KNOWN = ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(KNOWN))
OP9 = f"""
with k as (select i, licence, md5({sql_joined(_LINES)}) as d from (values {_KNOWN}) as v(i, licence, text)),
  known as (select d, arg_min(licence, i) as licence from k group by d),
  c as (select row_number() over () as n, doc_id, {_LINES} as text from documents),
  w as (select n, doc_id, {sql_joined('text')} as whole, text from c),
  p as (
    select n, md5(whole) as d from w where whole <> ''
    union select n, md5({sql_joined('part')}) from (select n, unnest(regexp_split_to_array(text, '\n *\n')) as part from c)
    union select n, md5({sql_joined('part')}) from (select n, unnest(string_split(text, chr(10))) as part from c)),
  f as (select n, string_agg(distinct licence, ',' order by licence) as licences from p join known using (d) group by n)
select w.doc_id, case when whole <> '' then md5(whole) end as digest, known.licence as whole_licence, coalesce(f.licences, '') as licences
from w left join known on whole <> '' and md5(whole) = known.d left join f on f.n = w.n
"""

ORACLES: dict[str, str] = {"op2_neardup": OP2, "op4_chat": OP4, "op7_mixing": OP7, "op9_licences": OP9}
