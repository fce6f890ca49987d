"""SQL twins of the queries, for DuckDB. Patterns come from the same source in RE2's spelling."""

from __future__ import annotations

from collections.abc import Sequence

from .functions import injection as I
from .functions import markup as M
from .functions import sentences as S
from .functions import tokens as T
from .functions import urls as U
from .functions.regex import ASTRAL, Rx
from .operators import gates
from .queries import ADDITIONS, BUDGET, QUESTION, SEARCH, SEEDS
from .text_oracles import truncated

_WORD, _ENDS = Rx(r"\S+"), Rx(r"^\s+|\s+$")
NL = "chr(10)"


def q(text: str) -> str:
    """A string literal; line ends by their code."""
    return "(" + " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in text.split("\n")) + ")"


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {pattern}))"


def units(x: str) -> str:
    return f"(length({x}) + {count(x, q(ASTRAL))})"


def trim(x: str) -> str:
    return f"regexp_replace({x}, {_ENDS.duck}, '', 'g')"


def lines(x: str) -> str:
    return f"string_split({x}, {NL})"


def is_code(x: str) -> str:
    points = [f"regexp_matches({x}, {s.duck})::int" for s in T.CODE_SIGNS]
    n = f"len({lines(x)})"
    points.append(f"(len(list_filter({lines(x)}, lambda l: regexp_matches(l, {T.INDENTED.duck}))) > {n} * 0.3)::int")
    points.append(f"(len(list_filter({lines(x)}, lambda l: {units('l')} < 80)) > {n} * 0.7)::int")
    return f"(({' + '.join(points)}) >= 3)"


def tokens(x: str) -> str:
    wide = f"len(regexp_extract_all({x}, {q(T.WIDE)}))"
    rest = f"regexp_replace({x}, {q(T.WIDE)}, '', 'g')"
    cpt = f"(case when {is_code(x)} then {T.CODE_CHARS} else {T.TEXT_CHARS} end)"
    return f"coalesce(greatest(ceil({units(rest)} / {cpt}), ceil({count(rest, _WORD.duck)} / {T.TOKEN_WORDS})) + ceil({wide} / {T.WIDE_CHARS}), 0)::bigint"


def points(x: str, rules, preserve: Sequence[str] = S.PRESERVE) -> str:
    return " + ".join(f"(case when regexp_matches({x}, {rx.duck}) then {n} else 0 end)" for kind, rx, n in rules if not kind or kind in preserve)


def salience(x: str) -> str:
    size = units(x)
    return (
        f"({points(x, S.SALIENCE)} - ({size} < 20)::int - ({size} > 300)::int + 3 * regexp_matches({trim(x)}, {S.HEADING.duck})::int"
        f" + regexp_matches({trim(x)}, {S.LIST.duck})::int)::int"
    )


def normal(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


def matches(x: str, terms: Sequence[str]) -> str:
    padded = f"(' ' || {normal(x)} || ' ')"
    each = []
    for term in terms:
        hits = " or ".join(f"contains({padded}, '{f' {v}' if len(v) >= 4 else f' {v} '}')" for v in S.variants(term))
        each.append(f"({hits})::int")
    return f"({' + '.join(each)})"


def case_of(parts: Sequence[str], n: int) -> str:
    return "(case " + " ".join(f"when doc_id % {n} = {k} then {q(p)}" for k, p in enumerate(parts)) + " else '' end)"


SEEDED = f"(select doc_id, text || {NL} || {case_of(SEEDS, 7)} as text from documents)"
DERIVED = f"(select doc_id, '# ' || source || {NL} || {NL} || '## ' || lang || {NL} || {NL} || replace(text, {NL}, {NL} || {NL}) || {case_of(ADDITIONS, 5)} as md from documents)"
#: One row a sentence: lines to paragraphs, standalone lines apart, paragraphs cut at marked places.
_PARTS = f"""list_transform(string_split(array_to_string(list_transform({lines('text')}, lambda l: case when {trim('l')} = '' then chr(1)
  when regexp_matches({trim('l')}, {S.HEADING.duck}) or regexp_matches({trim('l')}, {S.LIST.duck}) then chr(1) || {trim('l')} || chr(1) else {trim('l')} end), ' '), chr(1)),
  lambda p: {trim(f"regexp_replace(p, {Rx(chr(92) + 's+').duck}, ' ', 'g')")})"""
_CUT = rf"""flatten(list_transform(parts, lambda p: case when regexp_matches(p, {S.HEADING.duck}) or regexp_matches(p, {S.LIST.duck}) then [p]
  else string_split(regexp_replace(p, {Rx('([.!?])' + chr(92) + 's+([A-Z])').duck}, '\1' || chr(1) || '\2', 'g'), chr(1)) end))"""
LISTS = f"(select doc_id, text, list_filter({_CUT}, lambda s: s <> '') as units from (select doc_id, text, {_PARTS} as parts from documents))"
SENTENCES = f"(select doc_id, unnest(range(len(units)))::int as i, unnest(units) as s from {LISTS})"


def greedy(order: str) -> str:
    """Sentences that fit, tried in an order: a fold over structs of number and tokens."""
    return f"""
with s as (select doc_id, i, s, {salience('s')} as sal, {tokens('s')} as tok, {matches('s', S.question_terms(QUESTION))} as own from {SENTENCES}),
n as (select *, coalesce(lag(own) over (partition by doc_id order by i), 0) + coalesce(lead(own) over (partition by doc_id order by i), 0) as near from s),
r as (select *, sal + own * 3 + (case when own > 0 and regexp_matches({trim('s')}, {S.HEADING.duck}) then 2 else 0 end) + least(2, near) as rel from n),
l as (select doc_id, list({{'used': tok, 'kept': [i]}} order by {order}) as u, sum(own)::bigint as matches from r group by doc_id),
f as (select doc_id, matches, list_reduce(list_prepend({{'used': 0::bigint, 'kept': []::int[]}}, u),
  lambda a, x: case when a.used + x.used <= {BUDGET} then {{'used': a.used + x.used, 'kept': list_concat(a.kept, x.kept)}} else a end) as p from l)"""


def injections(x: str) -> str:
    each = ", ".join(f"list_transform(list_distinct(regexp_extract_all({x}, {rx.duck})), lambda m: {{'m': m, 'reason': {q(reason)}}})" for rx, reason in I.PATTERNS)
    return f"list_distinct(flatten([{each}]))"


def sanitized(x: str) -> str:
    for rx, _ in I.PATTERNS:
        x = f"regexp_replace({x}, {rx.duck}, '[POTENTIAL_INJECTION: \\0]', 'g')"
    return x


_HIGH = "(" + " or ".join(f"regexp_matches(text, {rx.duck})" for rx in I.SURE) + ")"
_URL = r"'^([A-Za-z][A-Za-z0-9+.\-]*)://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:@]*)(?::([0-9]*))?([^?#]*)(\?[^#]*)?(#.*)?$'"


def part(n: int) -> str:
    return f"regexp_extract(trim(url), {_URL}, {n})"


_SCHEME, _HOST = f"lower({part(1)})", f"lower({part(2)})"
_PORT = f"(case when ({_SCHEME} = 'http' and {part(3)} = '80') or ({_SCHEME} = 'https' and {part(3)} = '443') then '' else {part(3)} end)"
_PATH = f"(case when {part(4)} = '' then '/' else {part(4)} end)"
_VALID = f"({_SCHEME} <> '' and {part(2)} <> '')"
_ORIGIN = f"(case when {_VALID} then {_SCHEME} || '://' || {_HOST} || (case when {_PORT} = '' then '' else ':' || {_PORT} end) end)"
_TRACK = ", ".join(f"'{p}'" for p in U.TRACKING)
_QUERY = f"""coalesce((select array_to_string(list(case when contains(p, '=') then p else p || '=' end order by split_part(p, '=', 1), k), '&') from
  (select unnest(list_filter(string_split(substr({part(5)}, 2), '&'), lambda p: p <> '' and lower(split_part(p, '=', 1)) not in ({_TRACK}))) as p,
          generate_subscripts(list_filter(string_split(substr({part(5)}, 2), '&'), lambda p: p <> '' and lower(split_part(p, '=', 1)) not in ({_TRACK})), 1) as k)), '')"""
_CANON = f"(select page_id, html, url, case when {_VALID} then {_ORIGIN} || (case when length({_PATH}) > 1 and ends_with({_PATH}, '/') then left({_PATH}, length({_PATH}) - 1) else {_PATH} end) || (case when {_QUERY} = '' then '' else '?' || {_QUERY} end) || {part(6)} else url end as canon from pages)"
_MIME = "(case " + " ".join(f"when {' or '.join(f'ends_with(lower({_PATH}), {q(e)})' for e in ends)} then '{kind}'" for ends, kind in U.ENDINGS) + " end)"
_KEY = f"({_HOST} || '/' || (case when {_PATH} = '/' then 'root' else regexp_replace(regexp_replace(ltrim(regexp_replace({_PATH}, '/$', ''), '/'), '[^A-Za-z0-9/_.-]', '_', 'g'), '/{{2,}}', '/', 'g') end))"


def visible(x: str) -> str:
    for p in M.INVISIBLE:
        x = f"regexp_replace({x}, {q(p)}, ' ', 'g')"
    for name, char in M.ENTITIES:
        x = f"regexp_replace({x}, '(?i){name}', {q(char)}, 'g')"
    return f"trim(regexp_replace({x}, {Rx(chr(92) + 's+').duck}, ' ', 'g'))"


def plain(x: str) -> str:
    for pattern, by in M.PLAIN:
        rx = Rx(pattern.partition(")")[2], pattern[2]) if pattern.startswith("(?") else Rx(pattern)
        x = f"regexp_replace({x}, {rx.duck}, {q(by).replace('$', chr(92))}, 'g')"
    return trim(x)


_IPS = f"""(select doc_id, v, array_to_string([(v >> 24) % 256, (v >> 16) % 256, (v >> 8) % 256, v % 256], '.') as ip from
 (select doc_id, (([{', '.join(f'{gates._number(e)}::bigint' for pair in gates.IPV4_RANGES for e in pair)}])[doc_id % {2 * len(gates.IPV4_RANGES)} + 1]
   + ((doc_id // {2 * len(gates.IPV4_RANGES)}) % 3 - 1) + (doc_id // {6 * len(gates.IPV4_RANGES)}) * 1000003 + 4294967296) % 4294967296 as v from documents))"""
_BLOCKED = "(" + " or ".join(f"v between {gates._number(a)} and {gates._number(b)}" for a, b in gates.IPV4_RANGES) + ")"
_EVENTS = "(select event_id, user_id as host, ts, epoch_us(ts) as us from events)"
_FOLDERS = "(select conv_id, turn, 'c/' || conv_id || '/' as folder, text from conversations)"
_TERMS = S.question_terms(SEARCH)


def numbers(rx: Rx, most: int) -> str:
    return f"""coalesce((select array_to_string(list(v order by k), ', ') from (select v, k from (select v, min(k) as k from
  (select unnest(regexp_extract_all(substr(text, 1, 2000), {rx.duck})) as v, generate_subscripts(regexp_extract_all(substr(text, 1, 2000), {rx.duck}), 1) as k) group by v) order by k limit {most})), '')"""


ORACLES: dict[str, str] = {
    "tok_estimate": f"select doc_id, {tokens('text')} as est_tokens from documents",
    "tok_estimate_md": f"select doc_id, {tokens('md')} as est_tokens from {DERIVED}",
    "tok_is_code": f"select doc_id, {is_code('md')} as is_code from {DERIVED}",
    "tok_reading_time": f"select doc_id, greatest(1, ceil({count('text', _WORD.duck)} / 225))::bigint as minutes from documents",
    "hash_content": "select page_id, sha256(html) as content_hash from pages",
    "hash_source_id": f"select page_id, substr(sha256(canon || '|2024-01-01|' || sha256(html)), 1, 16) as source_id from {_CANON}",
    "sent_split": f"select doc_id, i, s from {SENTENCES}",
    "sent_salience": f"select doc_id, i, {salience('s')} as score from {SENTENCES}",
    "sent_neighbors": greedy("-sal, i") + " select doc_id, i, rel::int as score from r",
    "sent_dedupe": f"select l.doc_id, coalesce(n, 0) as n from {LISTS} l left join (select doc_id, count(distinct {normal('s')})::bigint as n from {SENTENCES} where {normal('s')} <> '' group by doc_id) using (doc_id)",
    "compact_question": greedy("-rel, -own, i") + " select doc_id, len(p.kept)::bigint as kept, p.used::bigint as used_tokens, matches from f",
    "compact_salience": greedy("-sal, i") + f""",
k as (select doc_id, unnest(list_sort(p.kept)) as i from f),
d as (select k.doc_id, k.i, s, row_number() over (partition by k.doc_id, {normal('s')} order by k.i) as nth from k join s on s.doc_id = k.doc_id and s.i = k.i where {normal('s')} <> ''),
m as (select doc_id, array_to_string(list(case when regexp_matches({trim('s')}, {S.HEADING.duck}) or regexp_matches({trim('s')}, {S.LIST.duck}) then chr(1) || {trim('s')} || chr(1) else {trim('s')} end order by i), ' ') as t from d where nth = 1 group by doc_id)
select f.doc_id, len(p.kept)::bigint as kept, p.used::bigint as used_tokens,
  coalesce(array_to_string(list_filter(list_transform(string_split(t, chr(1)), lambda x: {trim('x')}), lambda x: x <> ''), {NL} || {NL}), '') as summary from f left join m using (doc_id)""",
    "compact_question_summary": greedy("case when hits > 0 then -rel else -sal end, case when hits > 0 then -own else 0 end, i").replace("as rel from n)", "as rel, sum(own) over (partition by doc_id) as hits from n)") + f""",
k as (select doc_id, unnest(list_sort(p.kept)) as i from f),
d as (select k.doc_id, k.i, s, row_number() over (partition by k.doc_id, {normal('s')} order by k.i) as nth from k join s on s.doc_id = k.doc_id and s.i = k.i where {normal('s')} <> ''),
m as (select doc_id, array_to_string(list(case when regexp_matches({trim('s')}, {S.HEADING.duck}) or regexp_matches({trim('s')}, {S.LIST.duck}) then chr(1) || {trim('s')} || chr(1) else {trim('s')} end order by i), ' ') as t from d where nth = 1 group by doc_id),
c as (select doc_id, count(*) as n from s group by doc_id),
o as (select d.doc_id as id, coalesce(array_to_string(list_filter(list_transform(string_split(t, chr(1)), lambda x: {trim('x')}), lambda x: x <> ''), {NL} || {NL}), '') as text from documents d left join m using (doc_id)),
{truncated('o', BUDGET)}
select d.doc_id::varchar as source_id, z.text as summary,
  case when f.matches > 0 then 'Focused on question: "{QUESTION}..."|Selected ' || len(p.kept) || ' of ' || c.n || ' sentences' else 'Condensed from ' || coalesce(c.n, 0) || ' sentences to ' || coalesce(len(p.kept), 0) end as omissions,
  concat_ws('|', case when coalesce(f.matches, 0) = 0 then 'No sentence matched question terms, falling back to salience compaction' end, case when z.truncated then 'Summary truncated to fit token budget' end) as warnings
from documents d left join f using (doc_id) left join c using (doc_id) join cut_texts z on z.id = d.doc_id""",
    "compact_key_points": f"""
with s as (select *, row_number() over (partition by doc_id, {normal('s')} order by i) as nth from {SENTENCES} where {salience('s')} >= 2 and {normal('s')} <> ''),
k as (select *, row_number() over (partition by doc_id order by i) - 1 as k from s where nth = 1)
select doc_id, k::int as k, s as text from k where k < 10""",
    "compact_section_score": f"select doc_id, ({points('md', S.SECTION)} + ({units('md')} > 100 and {units('md')} < 2000)::int)::int as score from {DERIVED}",
    "compact_omission_label": f"""select doc_id, case when starts_with(l, '#') then 'Section: ' || regexp_replace(l, {Rx('^#+' + chr(92) + 's*').duck}, '') when length(l) < 60 then l else substr(l, 1, 57) || '...' end as label
from (select doc_id, {trim(f"{lines('text')}[1]")} as l from documents)""",
    "cite_first_block": f"""
with b as (select doc_id, list_filter(list_transform(string_split_regex(replace(text, {NL}, {NL} || {NL}), '\\n{{2,}}'), lambda x: trim(x)), lambda x: x <> '') as blocks from documents),
s as (select doc_id, i, {trim('s')} as bare, {normal('s')} as form from {SENTENCES}),
h as (select s.doc_id, s.i, bare, list_position(list_transform(blocks, lambda x: contains(x, bare) or (form <> '' and contains({normal('x')}, form))), true) as k from s join b using (doc_id))
select doc_id, i, case when bare = '' or k is null or k = 0 then '' else 'b' || (k - 1) end as citation from h""",
    "inject_detect_counts": f"select doc_id, x.reason as reason, count(*)::bigint as n from (select doc_id, unnest({injections('text')}) as x from {SEEDED}) group by all",
    "inject_sanitize": f"select doc_id, {sanitized('text')} as text from {SEEDED}",
    "inject_high_conf": f"select doc_id, {_HIGH} as high from {SEEDED}",
    "inject_risk": f"""select doc_id, round(case when n = 0 then 0.0 when high then least(1.0, {I.SURE_RISK} + n * {I.SURE_STEP}) else least(1.0, n * {I.STEP}) end::double, 6) as risk
from (select doc_id, len({injections('text')}) as n, {_HIGH} as high from {SEEDED})""",
    "summary_numbers_dates": f"select doc_id, {numbers(M.NUMBER, 5)} as numbers, {numbers(M.MONTH_DATE, 3)} as dates from documents",
    "text_code_flag": f"""select doc_id, ({' + '.join(f"regexp_matches(md, {s.duck})::int" for s in M.TEXT_CODE_SIGNS)}
 + (len(list_filter({lines('md')}, lambda l: regexp_matches(l, {T.INDENTED.duck}))) > len({lines('md')}) * 0.4)::int + (({units('md')} - (len({lines('md')}) - 1)) / len({lines('md')}) < 60)::int) >= 3 as code from {DERIVED}""",
    "md_plain_text": f"select doc_id, {plain('md')} as plain from {DERIVED}",
    "html_title_lang": r"""select page_id, """ + trim(r"""regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)""") + r""" as title, regexp_extract(html, '(?is)<html[^>]*?\blang\s*=\s*["'']([^"'']*)["'']', 1) as lang from pages""",
    "html_visible_text": f"select page_id, {visible('html')} as text from pages",
    "html_words": f"select page_id, {count(visible('html'), _WORD.duck)}::bigint as words from pages",
    "html_strip_comments": "select page_id, regexp_replace(html, '(?s)<!--.*?-->', '', 'g') as html from pages",
    "html_headings": rf"""with h as (select page_id, regexp_extract_all(html, '(?is)<h[1-6]\b[^>]*>.*?</h[1-6]>') as l from pages)
select page_id, (row_number() over (partition by page_id order by k) - 1)::int as k, level, text from (select page_id, k, substr(x, 3, 1)::int as level, {trim(f"regexp_replace(regexp_replace(x, '<[^>]+>', '', 'g'), {Rx(chr(92) + 's+').duck}, ' ', 'g')")} as text
from (select page_id, unnest(l) as x, generate_subscripts(l, 1) as k from h)) where text <> ''""",
    "url_normalize": f"select page_id, canon as url from {_CANON}",
    "url_origin": f"select page_id, {_ORIGIN} as origin, case when {_VALID} then {_HOST} end as host from pages",
    "url_mime": f"select page_id, {_MIME} as mime from pages",
    "url_object_key": f"select page_id, {_KEY} as key from pages",
    "url_js_heavy": "select page_id, page_id % 3 = 0 as heavy from pages",
    "fetch_error_code": "select page_id, case when page_id % 3 = 0 then 'HTTP_503' when octet_length(encode(html)) > 1500 then 'CONTENT_TOO_LARGE' end as code, page_id % 3 = 0 as retry from pages",
    "ssrf_ipv4_join": f"select doc_id, ip from {_IPS} where {_BLOCKED}",
    "ssrf_ipv4_flag": f"select doc_id, {_BLOCKED} as blocked from {_IPS}",
    "ssrf_host_verdict": f"""select doc_id, e is null as safe, e as error from (select doc_id, case when doc_id % 5 = 0 then 'Protocol not allowed' when doc_id % 5 = 1 then 'Localhost is blocked'
 when doc_id % 5 = 2 and {_BLOCKED} then 'Resolved IP address is blocked' when doc_id % 5 > 2 and {_BLOCKED} then 'IP address is blocked' end as e from {_IPS})""",
    "robots_decision": "select page_id, page_id % 3 <> 0 as allowed from pages",
    "retrieve_scoped_topk": f"""select lpad(conv_id::varchar, 8, '0') || ':' || lpad(turn::varchar, 4, '0') as chunk_id, round({matches('text', _TERMS)} / {len(_TERMS)}, 6) as score from {_FOLDERS}
where folder > 'c/1' and folder <= 'c/1z' and {matches('text', _TERMS)} > 0 order by score desc, chunk_id limit 20""",
    "filter_scope_range": f"select conv_id, turn from {_FOLDERS} where (turn = 0 or turn > 2) and folder > 'c/1' and folder <= 'c/1z'",
    "scope_ids": f"select conv_id, turn, substr(sha256('/root/work'), 1, 12) as workspace_id, substr(sha256(folder), 1, 16) as thread_id from {_FOLDERS}",
    "page_cursor": "select page_id, url from pages order by url, page_id limit 50 offset 50",
    "complete_rank": "select value from (select distinct p_name as value from part where trim(p_name) <> '') where contains(lower(value), 'a') order by instr(lower(value), 'a'), length(value), value limit 20",
    "resource_list": "select page_id::varchar as source_id from pages",
    "rate_window": f"select event_id, count(*) over (partition by host order by ts range between interval 3600 seconds preceding and current row)::bigint as recent from {_EVENTS}",
    "rate_admission": f"""with l as (select host, list({{'recent': [us], 'n': 1::bigint}} order by us) as t from {_EVENTS} group by host)
select host, len(t)::bigint as n, list_reduce(list_prepend({{'recent': []::bigint[], 'n': 0::bigint}}, t), lambda a, x: case when len(list_filter(a.recent, lambda r: r > x.recent[1] - 86400000000)) < 3
 then {{'recent': list_concat(list_filter(a.recent, lambda r: r > x.recent[1] - 86400000000), x.recent), 'n': a.n + 1}} else {{'recent': list_filter(a.recent, lambda r: r > x.recent[1] - 86400000000), 'n': a.n}} end).n as admitted from l""",
    "crawl_schedule": f"""with i as (select *, row_number() over (partition by host order by us, event_id) as i from {_EVENTS})
select event_id, (i * 2000000 + max(us - i * 2000000) over (partition by host order by i rows between unbounded preceding and current row))::bigint as start_us from i""",
    "cache_latest_ttl": f"select host as key, event_id from (select *, row_number() over (partition by host order by ts desc) as n from {_EVENTS} where ts > (select max(ts) from events) - interval 259200 seconds) where n = 1",
    "cache_evict": f"select host as key, event_id from (select *, row_number() over (partition by host order by ts desc) as n from {_EVENTS} where ts > (select max(ts) from events) - interval 259200 seconds) where n = 1 order by ts desc, host limit 20",
    "backoff": "select event_id, least(300.0, case when event_id % 4 = 0 then 400.0 when event_id % 4 = 1 then 10.0 else pow(2.0, least(event_id % 9, 6)) end)::double as seconds from events",
    "ingest_part_keys": f"select page_id, {_KEY} || '/' || sha256(html) || '/part-0001.md' as key from pages",
    "ingest_skip_existing": f"select page_id, key from (select page_id, {_KEY} || '/' || sha256(html) || '/part-0001.md' as key from pages) where key not in (select {_KEY} || '/' || sha256(html) || '/part-0001.md' from pages where page_id % 3 = 0)",
    "thread_upsert": """with n as (select conv_id::varchar as key, min(turn) as a, max(turn) as b from conversations group by all), k as (select distinct conv_id::varchar as key from conversations where turn = 0 and conv_id % 2 = 0)
select n.key, case when k.key is null then substr(sha256(n.key), 1, 16) else 'known' end as conversation_id, (case when k.key is null then a else 5 end)::bigint as created_at, (case when k.key is null then b else greatest(5, b) end)::bigint as last_used_at from n left join k using (key)""",
    "json_valid": "select event_id, json_valid(props) as valid from events",
}


# --- twins that spell their own constants ---------------------------------------------

_REQUEST = "(case page_id % 3 when 0 then 'https://cdn.other.com/x.js' when 1 then 'https://t.other.com/pixel' else 'https://o.com/a.js' end)"
_REQUEST_ORIGIN = "(case page_id % 3 when 0 then 'https://cdn.other.com' when 1 then 'https://t.other.com' else 'https://o.com' end)"
_TRACKER_RX = "'analytics|tracking|pixel|beacon|ads|doubleclick|googlesyndication|facebook\\.net|twitter\\.com/i/'"
_PAYWALL_HTML = "(html || case page_id % 4 when 0 then '<div class=\"x paywall\">' when 1 then '<p>Sign up to read</p>' else '' end)"
_PAYWALL_CLASS_RX = (
    "'(?is)<[a-z][^>]*\\bclass\\s*=\\s*[\"''](?:[^\"'']*\\s)?(?:paywall|subscription-wall|metered-paywall|subscriber-only|premium-content|piano-paywall)(?:\\s[^\"'']*)?[\"'']'"
)
_PAYWALL_ATTRIBUTE_RX = "'(?is)<[a-z][^>]*\\s(?:data-paywall|data-subscriber-content)[\\s=>]'"
_PAYWALL_PHRASE_RX = "'subscribe to continue reading|this content is for subscribers|to read the full article|sign up to read|premium subscribers only|members-only content'"


def _leading(x: str) -> str:
    """How many white space characters a line begins with."""
    return f"(length({x}) - length(regexp_replace({x}, {Rx('^' + chr(92) + 's+').duck}, '')))"


def _capitals(x: str) -> str:
    return f"({trim(x)} <> '' and {units(trim(x))} < 80 and {trim(x)} = upper({trim(x)}) and regexp_matches({trim(x)}, '[A-Z]'))"


def _code_text(x: str) -> str:
    signs = (
        "(?m)^(function|const|let|var|class|import|export|def|async|public|private|void)\\s", "[{}\\[\\]();]", "=>", "(?m)^\\s*(if|for|while|switch|try|catch)\\s*\\(",
        "(?m)^\\s*#include", "(?m)^\\s*package\\s+", "(?m)^\\s*using\\s+", "(?m)^\\s*require\\s*\\(",
    )
    n = f"len({lines(x)})"
    marks = [f"regexp_matches({x}, {q(s)})::int" for s in signs]
    marks += [f"(len(list_filter({lines(x)}, lambda l: {_leading('l')} >= 2)) > {n} * 0.4)::int", f"(({units(x)} - ({n} - 1)) / {n} < 60)::int"]
    return f"(({' + '.join(marks)}) >= 3)"


_TITLED = f"""(select doc_id, k, {trim('line')} as bare, {trim("coalesce(after, '')")} as under, {_capitals('line')} as caps from
  (select doc_id, k, line, lead(line) over (partition by doc_id order by k) as after from
    (select doc_id, unnest(list_slice({lines('text')}, 1, 5)) as line, generate_subscripts(list_slice({lines('text')}, 1, 5), 1) as k from documents)))"""
_TITLE_CASE = """array_to_string(list_transform(range(1, length(bare) + 1), lambda i: case
  when regexp_matches(substr(lower(bare), i, 1), '[a-z]') and (i = 1 or not regexp_matches(substr(lower(bare), i - 1, 1), '[A-Za-z0-9_]'))
  then upper(substr(lower(bare), i, 1)) else substr(lower(bare), i, 1) end), '')"""

ORACLES |= {
    "url_request_block": f"""select page_id, coalesce(({_REQUEST_ORIGIN} <> {_ORIGIN}) and (regexp_matches({_REQUEST}, {_TRACKER_RX})
  or not regexp_matches({_REQUEST}, 'cdn|static|assets')), true) as blocked from pages""",
    "render_fallback": f"""select page_id, size >= 5000 and (regexp_matches(seen, '(?i)enable\\s+javascript|enable\\s+js|requires\\s+javascript|turn\\s+on\\s+javascript')
  or words < 40 or (words < 80 and size >= 20000) or (words < 200 and size >= 10000)) as retry
 from (select page_id, seen, size, {count('seen', _WORD.duck)} as words from (select page_id, {visible('html')} as seen, strlen(html) * 5 as size from pages))""",
    "html_paywall": f"""select page_id, regexp_matches(h, {_PAYWALL_CLASS_RX}) or regexp_matches(h, {_PAYWALL_ATTRIBUTE_RX}) or regexp_matches(lower({visible('h')}), {_PAYWALL_PHRASE_RX}) as paywalled
 from (select page_id, {_PAYWALL_HTML} as h from pages)""",
    "text_structure": f"""select doc_id, len(list_filter(ls, lambda l: regexp_matches(l, {Rx('^' + chr(92) + 's*[-*•◦▪►]' + chr(92) + 's+').duck}))) > 0 as has_bullet_lists,
  len(list_filter(ls, lambda l: regexp_matches(l, {Rx('^' + chr(92) + 's*' + chr(92) + 'd+[.)]' + chr(92) + 's+').duck}))) > 0 as has_numbered_lists,
  len(list_filter(range(2, len(ls) + 1), lambda i: {_leading('ls[i]')} >= 4 and {trim('ls[i - 1]')} <> '' and {_leading('ls[i - 1]')} < 4)) > 0 as has_code_blocks,
  len(ls)::int as line_count, {_code_text('md')} as is_likely_code
 from (select doc_id, md, {lines('md')} as ls from {DERIVED})""",
    "text_title": f"""select d.doc_id, t.title from documents d left join (select doc_id, arg_min(title, k) as title from
  (select doc_id, k, case when bare = '' then null when regexp_full_match(under, '=+|-+') then bare when caps then {_TITLE_CASE}
    when {units('bare')} < 100 and not contains(bare, '  ') and not ends_with(bare, '.') then bare end as title from {_TITLED})
  where title is not null group by doc_id) t on d.doc_id = t.doc_id""",
}
