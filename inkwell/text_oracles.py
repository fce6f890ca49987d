"""SQL twins of queries over derived Markdown, pages and properties, with constants of their own.

The derived Markdown has two headings, a paragraph a line of the text, and an
addition by ``doc_id % 5``; the twins take it apart with SQL's own means.
"""

from __future__ import annotations

#: White space as the engine's patterns have it, for a character class of RE2.
_WS = r"\t-\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"


def _trim(text: str) -> str:
    return f"regexp_replace({text}, '^[{_WS}]+|[{_WS}]+$', '', 'g')"


_ADDED = """case doc_id % 5
  when 0 then '- first item' || chr(10) || '- second item with 42 points' || chr(10) || '- third item'
  when 1 then '```python' || chr(10) || 'def run(x):' || chr(10) || '    return {"a": [x]}' || chr(10) || '```'
  when 2 then '| name | value |' || chr(10) || '|---|---|' || chr(10) || '| a | 1 |' || chr(10) || '| b | 2 |'
  when 3 then '> "We found that the new method is better by far", said Jane Doe.' end"""
DERIVED_SQL = f"(select doc_id, source, lang, text, '# ' || source || chr(10) || chr(10) || '## ' || lang || chr(10) || chr(10) || replace(text, chr(10), chr(10) || chr(10)) || coalesce(chr(10) || chr(10) || {_ADDED}, '') as md from documents)"

_HEADS = f"""
l as (select doc_id, md, unnest(string_split(md, chr(10))) as line, generate_subscripts(string_split(md, chr(10)), 1) as i from {DERIVED_SQL}),
f as (select *, sum(case when regexp_matches(line, '^(```|~~~)') then 1 else 0 end) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding) as fences from l),
h as (select doc_id, i, length(regexp_extract(line, '^(#{{1,6}})[{_WS}]+(.*)$', 1)) as level, {_trim(f"regexp_extract(line, '^(#{{1,6}})[{_WS}]+(.*)$', 2)")} as text
      from f where coalesce(fences, 0) % 2 = 0 and regexp_matches(line, '^#{{1,6}}[{_WS}]+.'))"""
#: The last heading of each upper level that no heading of a lower one has ended.
_PATH = """case level when 1 then text else coalesce(last_value(case when level = 1 then text end ignore nulls) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding) || ' > ', '') || text end"""

_CHARS = """list_reduce(list_prepend({'done': []::varchar[], 'held': ''}, list_transform(string_split(part, ''), lambda c: {'done': []::varchar[], 'held': c})),
   lambda a, c: case when strlen(a.held) + strlen(c.held) <= 500 then {'done': a.done, 'held': a.held || c.held} else {'done': list_append(a.done, a.held), 'held': c.held} end)"""


def _code(x: str) -> str:
    lines = f"string_split({x}, chr(10))"
    signs = (rf"(?m)^[{_WS}]*(function|const|let|var|class|import|export|def|async|await)[{_WS}]", r"[{}\[\]();]", "=>", rf"(?m)^[{_WS}]*#include", rf"(?m)^[{_WS}]*package[{_WS}]", rf"(?m)^[{_WS}]*use[{_WS}]")
    points = [f"regexp_matches({x}, '{r}')::int" for r in signs]
    points += [f"(len(list_filter({lines}, lambda l: regexp_matches(l, '^[{_WS}]{{2,}}'))) > len({lines}) * 0.3)::int", f"(len(list_filter({lines}, lambda l: length(l) < 80)) > len({lines}) * 0.7)::int"]
    return f"(({' + '.join(points)}) >= 3)"


def _tokens(x: str) -> str:
    """The estimate for a text without wide characters."""
    return f"greatest(ceil(length({x}) / case when {_code(x)} then 3.0 else 3.5 end), ceil(len(regexp_extract_all({x}, '[^{_WS}]+')) / 0.75))::bigint"


#: Chunks of 180 tokens: blocks as ``blocks_all`` has them; one that is too long is cut near 630 characters, behind a sentence if one ends late.
_CHUNKS = rf"""
with recursive p as (
  select doc_id, 0 as i, 'heading' as kind, '# ' || source as text, source as path from documents union all select doc_id, 1, 'heading', '## ' || lang, source || ' > ' || lang from documents
  union all select doc_id, 2 + k, 'paragraph', line, path from (select doc_id, source || ' > ' || lang as path, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as k from documents)
  union all select doc_id, 1000000000, 'other', {_ADDED}, source || ' > ' || lang from documents where doc_id % 5 < 4),
b as (select doc_id, i, kind, {_trim("text")} as text, path from p where {_trim("text")} <> ''),
t as (select *, {_tokens("text")} as n from b),
cut as (
  select doc_id, i, 0 as k, null::varchar as piece, text as rest from t where n > 180
  union all
  select doc_id, i, k + 1, {_trim("substr(rest, 1, stop)")}, {_trim("substr(rest, stop + 1)")} from (
    select *, case when {_tokens("rest")} <= 180 then length(rest) when sent > least(630, length(rest)) * 0.7 then sent + 1 else least(630, length(rest)) end as stop
    from (select *, case when regexp_matches(substr(rest, 1, 630), '[.!?][{_WS}]+[A-Z][^.!?]*$') then least(630, length(rest)) - length(regexp_extract(substr(rest, 1, 630), '[.!?][{_WS}]+[A-Z][^.!?]*$')) else -1 end as sent from cut where rest <> ''))),
c as (select doc_id, i, list(piece order by k) as pieces from cut where piece <> '' group by doc_id, i),
items as (select doc_id, list({{'head': kind = 'heading', 'text': text, 'n': n, 'path': path, 'pieces': coalesce(pieces, []::varchar[]), 'out': []::struct(path varchar, text varchar)[], 'held': '', 'used': 0::bigint, 'begun': ''}} order by i) as l from t left join c using (doc_id, i) group by doc_id),
f as (select doc_id, list_reduce(list_prepend({{'head': false, 'text': '', 'n': 0::bigint, 'path': '', 'pieces': []::varchar[], 'out': []::struct(path varchar, text varchar)[], 'held': '', 'used': 0::bigint, 'begun': ''}}, l), lambda a, x: {{
    'head': false, 'text': '', 'n': 0::bigint, 'path': '', 'pieces': []::varchar[],
    'out': list_concat(list_concat(a.out, case when a.held <> '' and (x.head or x.n > 180 or a.used + x.n > 180) then [{{'path': a.begun, 'text': a.held}}] else [] end), list_transform(x.pieces, lambda y: {{'path': x.path, 'text': y}})),
    'held': case when x.n > 180 then '' when a.held = '' or x.head or a.used + x.n > 180 then x.text else a.held || chr(10) || chr(10) || x.text end,
    'used': case when x.n > 180 then 0 when a.held = '' or x.head or a.used + x.n > 180 then x.n else a.used + x.n end,
    'begun': case when a.held = '' or x.head or a.used + x.n > 180 then x.path else a.begun end}}) as r from items),
g as (select doc_id, list_concat(r.out, case when r.held = '' then [] else [{{'path': r.begun, 'text': r.held}}] end) as l from f),
r as (select doc_id, generate_subscripts(l, 1) - 1 as k, unnest(l) as x from g),
chunks as (select doc_id::varchar as source_id, doc_id || ':c' || k as chunk_id, k::int as chunk_index, x.path as headings_path, {_tokens("x.text")} as est_tokens, x.text as text, length(x.text)::int as char_len from r)
"""

def truncated(table: str, most: int) -> str:
    """Common tables up to ``cut_texts(id, text, truncated)``: the texts of ``table(id, text)`` cut to about ``most`` tokens. For texts that are no code."""
    now = f"greatest(ceil(length(text) / 3.5), ceil(len(regexp_extract_all(text, '[^{_WS}]+')) / 0.75))"
    goal = f"floor(length(text) * ({float(most)}::double / greatest(now, 1)) * 0.95)"
    breaks = ("case when contains(head, chr(10) || chr(10)) then length(head) - instr(reverse(head), chr(10) || chr(10)) - 1 else -1 end as par", "case when contains(head, chr(10)) then length(head) - instr(reverse(head), chr(10)) else -1 end as line")
    at = "case when par > goal * 0.8 then par when sent < length(head) and sent > goal * 0.8 then sent + 1 when line > goal * 0.9 then line else goal end"
    return f"""sized as (select id, text, {now} as now from {table}),
headed as (select *, substr(text, 1, {goal}::bigint) as head, {goal} as goal from sized),
broken as (select *, {", ".join(breaks)}, length(head) - length(regexp_extract(head, '[.!?][{_WS}]+[A-Z][^.!?]*$')) as sent from headed),
cut_texts as (select id, case when now <= {most} then text else {_trim(f"substr(head, 1, ({at})::bigint)")} end as text, now > {most} as truncated from broken)"""


ORACLES: dict[str, str] = {
    "md_headings": f"with {_HEADS} select doc_id, (row_number() over (partition by doc_id order by i) - 1)::int as k, level::int as level, text from h",
    "outline_paths": f"with {_HEADS} select doc_id, (row_number() over (partition by doc_id order by i) - 1)::int as k, level::int as level, text, {_PATH} as path from h",
    "outline_text": f"with {_HEADS} select d.doc_id, coalesce(string_agg(repeat('  ', level - 1) || h.text, chr(10) order by i), '') as text from documents d left join h on h.doc_id = d.doc_id and level <= 2 group by d.doc_id",
    "heading_path_at": "select doc_id, case when length(source) + 4 <= 20 then source || ' > ' || lang else source end as path from documents",
    "sections": f"""with {_HEADS}, s as (select l.doc_id, l.i, l.line, count(h.i) over (partition by l.doc_id order by l.i) as part from l left join h using (doc_id, i)),
g as (select doc_id, part, {_trim("string_agg(line, chr(10) order by i)")} as section from s group by doc_id, part)
select doc_id, (row_number() over (partition by doc_id order by part) - 1)::int as k, section from g where section <> ''""",
    "blocks_all": f"""with p as (
  select doc_id, 0 as i, 'heading' as kind, '# ' || source as text from documents union all select doc_id, 1, 'heading', '## ' || lang from documents
  union all select doc_id, 2 + k, 'paragraph', line from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as k from documents)
  union all select doc_id, 1000000000, case doc_id % 5 when 0 then 'list' when 1 then 'code' when 2 then 'table' else 'quote' end, {_ADDED} from documents where doc_id % 5 < 4),
t as (select doc_id, i, kind, {_trim("text")} as text from p)
select doc_id, 'b' || (row_number() over (partition by doc_id order by i) - 1) as block_id, kind, text, length(text)::int as char_len from t where text <> ''""",
    "md_clean": rf"""select doc_id, {_trim(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(md, '\n{3,}', chr(10) || chr(10), 'g'), '(?m)[ \t]+$', '', 'g'), '(?m)^[•◦▪▸►]\s*', '- ', 'g'), '\[([^\]]+)\]\(\s*\)', '\1', 'g'), '(?m)^#{1,6}[ \t]*$', '', 'g')")} as markdown from {DERIVED_SQL}""",
    "bytes_split": f"""with p as (select doc_id, strlen(md) as n, md, regexp_split_to_array(md, '\\n{{2,}}') as parts from {DERIVED_SQL}),
r as (select doc_id, n, md, list_reduce(list_prepend({{'done': []::varchar[], 'held': ''}}, list_transform(parts, lambda part: case when strlen(part) <= 500 then {{'done': []::varchar[], 'held': part}} else {_CHARS} end)),
  lambda a, x: case when len(x.done) = 0 and strlen(case when a.held = '' then x.held else a.held || chr(10) || chr(10) || x.held end) <= 500
                 then {{'done': a.done, 'held': case when a.held = '' then x.held else a.held || chr(10) || chr(10) || x.held end}}
                 else {{'done': list_concat(list_concat(a.done, case when a.held = '' then [] else [a.held] end), x.done), 'held': x.held}} end) as r from p where md is not null),
f as (select doc_id, case when n <= 500 then [md] else list_concat(r.done, case when r.held = '' then [] else [r.held] end) end as parts from r)
select doc_id, (generate_subscripts(parts, 1) - 1)::int as k, unnest(parts) as part from f""",
    "ctype_detect": "select page_id, case page_id % 4 when 1 then 'json' when 2 then 'xml' else 'html' end as type from pages",
    "md_sanitize": r"""select page_id,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', '', 'g'), '(?is)<style.*?</style>', '', 'g'), '(?is)<iframe.*?(</iframe>|/?>)', '[iframe removed]', 'g'),
    '(?i)\s+on\w+="[^"]*"', '', 'g'), '(?i)\s+on\w+=''[^'']*''', '', 'g'), '```(\w+)([^\n\w])', '```\1' || chr(10) || '\2', 'g') as markdown,
  len(regexp_extract_all(html, '(?is)<script.*?</script>'))::bigint as scripts, len(regexp_extract_all(regexp_replace(html, '(?is)<script.*?</script>', '', 'g'), '(?is)<style.*?</style>'))::bigint as styles,
  len(regexp_extract_all(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', '', 'g'), '(?is)<style.*?</style>', '', 'g'), '(?is)<iframe.*?(</iframe>|/?>)'))::bigint as iframes
from pages""",
    "html_meta": rf"""select page_id, {_trim(r"regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} as title, regexp_extract(html, '(?is)<html[^>]*?\blang\s*=\s*["'']([^"'']*)["'']', 1) as language, '' as author from pages""",
    "json_schema_summary": """select event_id, '# JSON Data' || repeat(chr(10), 2) || '## Structure' || repeat(chr(10), 2) || 'Object {' || chr(10) || '  "k": number (e.g., ' || v || ')' || chr(10) || '}' || repeat(chr(10), 2)
  || '## Sample Data' || repeat(chr(10), 2) || '```json' || chr(10) || '{' || chr(10) || '  "k": ' || v || chr(10) || '}' || chr(10) || '```' as markdown, 'JSON Data Structure:' || chr(10) || '- Object with 1 properties: k' as text
from (select event_id, json_extract_string(props, '$.k') as v from events)""",
    "compact_quotes": "select doc_id, 0::int as k, 'We found that the new method is better by far' as quote from documents where doc_id % 5 = 3",
    "fetch_verdicts": "select url as original_url, page_id % 10 <> 0 as success, case when page_id % 10 = 0 then 'HTTP_404' end as error_code from pages",
    "text_markdown": f"""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents),
b as (select *, {_trim("line")} as bare from l),
m as (select doc_id, i, case when bare <> '' and length(bare) < 80 and bare = upper(bare) and regexp_matches(bare, '[A-Z]') then '## ' || list_reduce(list_prepend({{'o': '', 'w': false}},
    list_transform(string_split(lower(bare), ''), lambda c: {{'o': c, 'w': false}})),
    lambda a, c: {{'o': a.o || case when not a.w and regexp_matches(c.o, '^[a-z]$') then upper(c.o) else c.o end, 'w': regexp_matches(c.o, '^[A-Za-z0-9_]$')}}).o else line end as line from b)
select doc_id, string_agg(line, chr(10) order by i) as markdown from m group by doc_id""",
    "tok_truncate": f"with d as (select doc_id as id, text from documents), {truncated('d', 100)} select id as doc_id, text, truncated from cut_texts",
    "chunk_pack_greedy": _CHUNKS + "select * from chunks",
    "chunk_totals": _CHUNKS + "select source_id, count(*) as total_chunks, sum(est_tokens)::bigint as total_est_tokens from chunks group by source_id",
    "chunk_by_index": _CHUNKS + "select chunk_id, text from chunks where chunk_index = 1",
    "chunk_search": _CHUNKS + "select chunk_id from chunks where contains(lower(text), 'second item')",
}
