"""SQL twins of the queries that SQL can express, for DuckDB."""

from __future__ import annotations

MIXING = r"""
with d as (
  select doc_id, source, coalesce('s' || source, 'n') as key,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         md5('mix-1|' || coalesce(doc_id::varchar, '')) as ord
  from documents),
s as (select key, min(source) as source, sum(size)::bigint as source_size from d group by key),
w as (select *, ((row_number() over (order by source nulls last) - 1) % 3 + 1)::bigint as weight from s),
m as (select *, source_size * 3 as most, (source_size * 3)::double / weight as ratio from w),
f as (select *,
        ((sum(source_size) over () - coalesce(sum(most) over (order by ratio, key rows between unbounded preceding and 1 preceding), 0))::double
         / (sum(weight) over (order by ratio, key rows between current row and unbounded following))::double) as level
      from m),
lv as (select level from f where ratio > level order by ratio, key limit 1),
t as (select key, source_size, least(most::double, coalesce(weight * (select level from lv), most::double)) as target from f),
b as (select *, greatest(1, floor(coalesce(min(case when source_size > 0 then source_size end) over (), 1) / 400.0))::bigint as block from t),
n as (select *, greatest(1, ceil(source_size / block::double))::bigint as blocks from b),
-- the k-th block of a source has the quotient target / (k - 1/2); it is taken if that is the block length or more
q as (select n.*, coalesce((select count(*) from range(1, (3 * n.source_size / n.block)::bigint + 1) as x(k) where n.target / (k - 0.5) >= n.block), 0)::bigint as quota,
        ('0x' || substr(md5('mix-1|' || key), 1, 12))::bigint % blocks as first_block,
        list_filter([7919, 104729, 15485863, 32452843, 49979687, 67867967, 86028121, 104395301], lambda p: blocks % p <> 0)[1]::bigint as step
      from n),
k as (select key, block, b, b * block as lo, (b + 1) * block as hi,
        quota // blocks + case when ((b + first_block) * step) % blocks < quota % blocks then 1 else 0 end as times
      from (select *, unnest(range(0, blocks)) as b from q)),
p as (select d.doc_id, d.size, d.key, d.ord, (coalesce(sum(d.size) over (partition by d.key order by d.ord rows between unbounded preceding and 1 preceding), 0))::bigint as lo from d),
w2 as (select p.doc_id, p.ord, p.size, p.key, p.lo, unnest(range(p.lo // q.block, (p.lo + p.size - 1) // q.block + 1)) as b from p join q using (key) where p.size > 0),
g as (select w2.key, w2.ord, w2.lo, sum(k.times * (least(w2.lo + w2.size, k.hi) - greatest(w2.lo, k.lo))) as taken
      from w2 join k using (key, b) group by all)
select p.doc_id, p.size, q.source_size, q.target, coalesce(g.taken, 0)::bigint as taken
from p join q using (key) left join g on p.key = g.key and p.ord = g.ord and p.lo = g.lo and p.size > 0
"""

DECONTAMINATION = r"""
with d as (
  select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w
  from documents),
i as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark where item_id is not null and text is not null),
iw as (
  select distinct item_id::varchar as item, least(len(w), 10) as n, array_to_string(list_slice(w, k, k + 9), ' ') as win
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as k from i where len(w) > 0)),
dw as (
  select doc_id, k, n, array_to_string(list_slice(w, k, k + n - 1), ' ') as win
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as k from d, (select distinct n from iw) where len(w) >= n)),
h as (select doc_id, k, dw.n, item from dw join iw on dw.win = iw.win and dw.n = iw.n),
c as (select doc_id, count(distinct p)::bigint as n_hit from (select doc_id, unnest(range(k, k + n)) as p from h) group by doc_id),
it as (select doc_id, count(distinct item)::bigint as n_items, string_agg(distinct item, ',' order by item) as items from h group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(c.n_hit, 0) as n_hit, coalesce(it.n_items, 0) as n_items,
       sha256(coalesce(it.items, '')) as items_sha256, coalesce(c.n_hit, 0) > 0 as contaminated
from d left join c using (doc_id) left join it using (doc_id)
"""

TOPK = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::bigint as score
  from v q, v c where q.vec_id % 50 = 0 and c.vec_id <> q.vec_id and len(q.e) = len(c.e)),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 5
"""


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text as DuckDB SQL, which has no function for it."""
    bits = "list_reduce(range(8), lambda b, i: xor(b >> 1, 3988292384 * (b & 1)), xor(c, x))"
    return f"xor(list_reduce(list_transform(string_split({text}, ''), lambda y: ascii(y)::bigint), lambda c, x: {bits}, 4294967295::bigint), 4294967295)"


PREFIX_TRIE = f"""
with c as (
  select conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} order by turn nulls first, coalesce(role, ''), md5(coalesce(text, ''))) as s
  from conversations where conv_id is not null group by conv_id),
h as (select *, {_crc32("conv_id::varchar")} % 9 as h from c),
r as (select h.conv_id, list_concat(coalesce(b.s[1:h.h], []), h.s[h.h + 1:]) as s from h left join c b on b.conv_id = h.conv_id - h.conv_id % 5),
p as (select conv_id, len(s) as n, depth, s[1:depth] as k from (select *, unnest(range(0, len(s) + 1)) as depth from r)),
n as (select k, depth, min(conv_id) as conv_id, count(*) as n_convs, string_agg(conv_id::varchar, ',' order by conv_id) filter (n = depth) as ends from p group by k, depth),
ch as (select k[1:depth - 1] as k, count(*) as n_children from n where depth > 0 group by all),
v as (select n.*, coalesce(n_children, 0) as n_children, case when depth = 0 then 0 else (n_convs - 1) * strlen(k[depth].text) end as saved from n left join ch using (k)),
su as (select k[1:a] as k, sum(case when n_children = 0 then 1 else 0 end) as n_leaves, sum(saved) as saved from (select *, unnest(range(0, depth + 1)) as a from v) group by all)
select v.conv_id, v.depth::bigint as depth, par.conv_id as parent_conv_id, v.n_convs::bigint as n_convs, v.n_children::bigint as n_children,
       su.n_leaves::bigint as n_leaves, su.saved::bigint as saved_tokens, sha256(coalesce(v.ends, '')) as ends_sha256
from v join su using (k) left join v par on v.depth > 0 and par.k = v.k[1:v.depth - 1]
"""

_STOPS = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

REPAIR = f"""
with recursive s as (
  select conv_id, coalesce(conv_id::varchar, ' ') as c, turn, coalesce(role, ' ') as role0, coalesce(text, ' ') as text0,
         {_crc32("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as fate from conversations),
d as (
  select c, turn, role0, md5(text0) as digest, case when fate = 4 then 'user' else role0 end as role,
         case fate when 1 then '' when 2 then regexp_replace(text0, '[.!?]', '', 'g') else text0 end as text,
         unnest(range(case fate when 0 then 0 when 3 then 2 else 1 end)) as copy from s),
o as (select *, trim(text, {_STOPS}) as seen, row_number() over (partition by c order by turn nulls first, role0, digest) as pos from d),
w as (
  select c, turn, pos, role, text, left(role, 1) as ini,
         case when seen = '' then 'b' when row_number() over (partition by c, role, text order by pos) > 1 then 'd' when right(seen, 1) in ('.', '!', '?') then '' else 't' end as fault
  from o),
-- before a row, nothing, one or two rows are inserted: three bring nothing new
ins(q, q2, cost, audit, made) as (values
  ('', '', 0, '', []::varchar[]), ('s', 's', 0, '', []::varchar[]), ('u', 'u', 0, '', []::varchar[]), ('a', 'a', 0, '', []::varchar[]),
  ('', 'u', 3, 'I', ['user:']), ('s', 'u', 3, 'I', ['user:']), ('a', 'u', 3, 'I', ['user:']), ('u', 'a', 3, 'I', ['assistant:']),
  ('', 'a', 6, 'II', ['user:', 'assistant:']), ('s', 'a', 6, 'II', ['user:', 'assistant:'])),
n as (select c, any_value(conv_id) as conv_id from s group by c),
dp as (
  select c, 0::bigint as i, '' as q, {{'cost': 0::bigint, 'audit': '', 'made': []::varchar[]}} as best from n
  union all
  select c, pos, q3, min({{'cost': cost, 'audit': audit, 'made': made}}) from (
    select dp.c, w.pos, e.q3, dp.best.cost + ins.cost + e.cost as cost, dp.best.audit || ins.audit || e.letter as audit,
           list_concat(list_concat(dp.best.made, ins.made), case when e.role is null then [] else [e.role || ':' || w.text] end) as made
    from dp join ins on ins.q = dp.q join w on w.c = dp.c and w.pos = dp.i + 1,
    lateral (
      select ins.q2 as q3, 4 as cost, 'D' as letter, null as role
      union all
      select w.ini, case when w.fault = 't' then 3 else 0 end, 'K', w.role
      where w.fault not in ('b', 'd') and ((w.ini = 's' and ins.q2 = '') or w.ini = case when ins.q2 = 'u' then 'a' else 'u' end)
      union all
      select case when ins.q2 = 'u' then 'a' else 'u' end, 3 + case when w.fault = 't' then 3 else 0 end, 'R', case when ins.q2 = 'u' then 'assistant' else 'user' end
      where w.fault not in ('b', 'd')) e)
  group by c, pos, q3),
f as (
  select c, min({{'cost': dp.best.cost + ins.cost, 'audit': dp.best.audit || ins.audit, 'made': list_concat(dp.best.made, ins.made)}}) as best
  from dp join ins using (q) where dp.i = coalesce((select max(pos) from w where w.c = dp.c), 0) and ins.q2 in ('', 'a') group by c),
g as (
  select c, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'b') as blank, count(*) filter (fault = 'd') as duplicate,
         count(*) filter (fault = 't') as truncated, count(*) filter (before || ini not in ('su', 'ua', 'au')) as illegal
  from (select *, lag(ini) over (partition by c order by pos) as before from w) group by c)
select n.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
       coalesce(illegal, 0)::bigint as illegal, f.best.cost::bigint as cost, f.best.audit as audit, sha256(array_to_string(f.best.made, chr(10))) as repaired_sha256
from n join f using (c) left join g using (c)
"""

JACCARD = r"""
with recursive w as (
  select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) as w
  from documents),
s as (
  select doc_id, list_sort(list_distinct(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
         else list_transform(range(1, len(w) - 1), lambda k: array_to_string(w[k:k + 2], ' ')) end)) as s from w),
d as (select doc_id, len(s)::bigint as n, md5(array_to_string(s, chr(10))) as h, s from s),
-- equal sets are one node
u as (select h, n, any_value(s) as s, min(doc_id) as least from d where n > 0 group by h, n),
g as (select h, n, unnest(s) as g from u),
p as (select a.h as a, b.h as b, a.n as m, b.n as n, count(*) as shared from g a join g b on a.g = b.g and a.h < b.h where a.n * 100 >= 90 * b.n and b.n * 100 >= 90 * a.n group by all),
l as (select a, b from p where 100 * shared >= 90 * (m + n - shared)),
e as (select a, b from l union all select b, a from l),
r as (select h as a, h as b from u union select r.a, e.b from r join e on e.a = r.b),
c as (select r.a as h, min(u.least) as component_id from r join u on u.h = r.b group by r.a)
select d.doc_id, d.n as n_shingles, case when d.n = 0 then d.doc_id else c.component_id end as component_id from d left join c using (h)
"""
