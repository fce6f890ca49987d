"""Queries of caches, limits, redirects, retrieval and ingest, each with its SQL twin beside it.

The twins spell their own constants and recurrences for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import markup as M
from .functions import urls as U
from .operators import markdown as MD
from .operators import completion, documents, gates, html, ranking, redirects, retrieval, scans
from .plans import packets
from .queries import derived
from .streaming import caches, limits
from .text_oracles import DERIVED_SQL


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def limit_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as operations of a host's limiter; errors name a pause in every third case."""
    kind = F.when(F.col("event_type") == "error", "error").when(F.col("event_id") % 97 == 0, "reset").otherwise("request")
    pause = F.when(F.col("event_id") % 3 == 0, F.lit(5000.0))
    return read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("host"), "ts", kind.alias("op"), pause.alias("retry_after"))


def rate_wait(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the limiter says to each event: 3 requests in 12 hours, waits of 3 hours at most."""
    log = limits.limit_log(limit_ops(spark, sf_dir), 3, op="op", retry_after="retry_after", seconds=43_200, max_wait=10_800)
    return log.select("event_id", "admitted", (F.col("wait_us") / 1e6).alias("wait_s"), "in_window", (F.col("backoff_us") / 1e6).alias("backoff_s"))


RATE_WAIT = """
with recursive o as (
  select event_id, user_id as host, epoch_us(ts) as now, case when event_type = 'error' then 'error' when event_id % 97 = 0 then 'reset' else 'request' end as op,
         case when event_id % 3 = 0 then 5000000000 end as pause, row_number() over (partition by user_id order by epoch_us(ts), event_id) as i from events),
r as (
  select host, 0::bigint as i, null::bigint as event_id, []::bigint[] as recent, []::bigint[] as waiting, 0::bigint as blocked,
         null::boolean as admitted, null::bigint as wait, null::bigint as in_window, null::bigint as backoff from (select distinct host from o)
  union all
  select host, i, event_id,
         case when op = 'reset' then [] when op = 'request' and wait = 0 then list_append(recent, now) else recent end,
         case when op = 'request' and wait > 0 and wait <= 10800000000 then list_append(waiting, now + wait) else waiting end,
         case when op = 'reset' then 0 when op = 'error' then now + coalesce(pause, least(300, pow(2, least(len(recent), 6)))::bigint * 1000000) else blocked end,
         case when op = 'request' then wait <= 10800000000 end, case when op = 'request' then wait end, len(recent)::bigint, greatest(0, blocked - now)
  from (
    select *, case when now < blocked then blocked - now when len(recent) < 3 then 0 else recent[1] + 43200000000 - now end as wait
    from (
      select o.*, r.blocked, list_filter(r.waiting, lambda w: w > o.now) as waiting,
             list_sort(list_filter(list_concat(r.recent, list_filter(r.waiting, lambda w: w <= o.now)), lambda t: t > o.now - 43200000000)) as recent
      from r join o on o.host = r.host and o.i = r.i + 1)))
select event_id, admitted, wait / 1e6 as wait_s, in_window, backoff / 1e6 as backoff_s from r where i > 0
"""


def cache_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as operations on a cache of each tenth of the users; the key is a user, lifetimes differ by key."""
    kind = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "click", "set").when(F.col("event_id") % 401 == 0, "clear").when(F.col("event_id") % 5 == 0, "get").otherwise("fetch")
    rows = read(spark, sf_dir, "events")
    return rows.select(
        "event_id", (F.col("user_id") % 10).cast("string").alias("cache"), F.col("user_id").cast("string").alias("key"), "ts", kind.alias("op"), F.col("event_id").cast("string").alias("value"),
        F.when(F.col("user_id") % 4 == 0, F.lit(7200)).alias("ttl"),
    )


def cache_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's effect on its cache of 3 entries that live 6 hours."""
    return caches.cache_log(cache_ops(spark, sf_dir), 3, 21_600, ttl="ttl").select("event_id", "hit", "found", "evicted", "is_new", "size")


CACHE_REPLAY = """
with recursive o as (
  select event_id, user_id % 10 as cache, user_id::varchar as key, epoch_us(ts) as now, event_id::varchar as value, case when user_id % 4 = 0 then 7200000000 else 21600000000 end as life,
         case when event_type = 'error' then 'delete' when event_type = 'click' then 'set' when event_id % 401 = 0 then 'clear' when event_id % 5 = 0 then 'get' else 'fetch' end as op,
         row_number() over (partition by user_id % 10 order by epoch_us(ts), event_id) as i from events),
r as (
  select cache, 0::bigint as i, null::bigint as event_id, []::struct(k varchar, v varchar, e bigint, p bigint)[] as es, null::boolean as hit, null::varchar as found, null::varchar as evicted, null::boolean as is_new
  from (select distinct cache from o)
  union all
  select cache, i, event_id,
         case when op = 'clear' then [] when op = 'delete' then list_filter(es, lambda x: x.k <> key)
              when writes then list_append(list_filter(es, lambda x: x.k <> key and (victim is null or x.k <> victim)), {'k': key, 'v': value, 'e': now + life,
                   'p': coalesce(list_filter(es, lambda x: x.k = key and (victim is null or x.k <> victim))[1].p, i)})
              else es end,
         case when op <> 'clear' then old is not null end, case when op in ('get', 'fetch') then old.v end, case when writes then victim end, case when writes then old is null end
  from (
    select *, op = 'set' or (op = 'fetch' and old is null) as writes, case when len(es) >= 3 then list_sort(list_transform(es, lambda x: {'e': x.e, 'p': x.p, 'k': x.k}))[1].k end as victim
    from (
      select o.*, list_filter(r.es, lambda x: x.e >= o.now) as es, list_filter(r.es, lambda x: x.e >= o.now and x.k = o.key)[1] as old
      from r join o on o.cache = r.cache and o.i = r.i + 1)))
select event_id, hit, found, evicted, is_new, len(es)::bigint as size from r where i > 0
"""


def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views as requests, purchases as responses of the same user: found within two days, too old, or none."""
    rows = read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("key"), "ts", "event_type")
    asked, given = rows.where("event_type = 'view'").drop("event_type"), rows.where("event_type = 'purchase'").select("key", "ts", F.col("event_id").alias("response_id"))
    return caches.lookups(asked, given, 172_800).select("event_id", "found", (F.col("age_us") / 1e6).alias("age_s"), "verdict")


CACHE_LOOKUP = """
with r as (select user_id, epoch_us(ts) as at, event_id from events where event_type = 'purchase'),
q as (select v.event_id, epoch_us(v.ts) as now, (select max({'at': r.at, 'id': r.event_id}) from r where r.user_id = v.user_id and r.at <= epoch_us(v.ts)) as last from events v where event_type = 'view')
select event_id, case when now - last.at <= 172800000000 then last.id end as found, (now - last.at) / 1e6 as age_s,
       case when last is null then 'miss' when now - last.at <= 172800000000 then 'hit' else 'expired' end as verdict from q
"""


def delay_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each event of a host may start if every one needs its own delay (minutes) after the last start."""
    rows = read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("host"), scans.micros("ts").alias("at"), ((F.col("event_id") % 7 + 1) * 3_600_000_000).alias("delay"))
    return scans.after_delays(rows, "host", "at", "delay", ("event_id",)).select("event_id", F.col("start").alias("start_us"))


DELAY_SCHEDULE = """
with recursive o as (select event_id, user_id as host, epoch_us(ts) as t, (event_id % 7 + 1) * 3600000000 as delay, row_number() over (partition by user_id order by ts, event_id) as i from events),
r as (
  select event_id, host, i, t as begins from o where i = 1
  union all
  select o.event_id, o.host, o.i, greatest(o.t, r.begins + o.delay) from r join o on o.host = r.host and o.i = r.i + 1)
select event_id, begins::bigint as start_us from r
"""

def redirect_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each page's URL leads if eight pages each redirect to the next: chains, long ones, loops, and some without a location."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    k = F.col("page_id") % 8
    goal = F.when(F.col("page_id") % 5 == 4, F.lit(None)).when(F.col("page_id") % 16 == 7, F.col("page_id") - 2).when(F.col("page_id") % 16 == 15, F.lit(None)).otherwise(F.col("page_id") + 1)
    moves = pages.where((k != 3) & ((F.col("page_id") % 16 != 15) | (F.col("page_id") % 5 == 4))).select(F.col("url").alias("src"), goal.alias("goal"))
    moves = moves.join(pages.select(F.col("page_id").alias("goal"), F.col("url").alias("dst")), "goal", "left").select("src", "dst")
    return redirects.follow(pages, moves, 3)


REDIRECT_CHAINS = """
with recursive m as (
  select p.url as src, min(q.url) as dst from pages p left join pages q
    on q.page_id = case when p.page_id % 5 = 4 then null when p.page_id % 16 = 7 then p.page_id - 2 when p.page_id % 16 = 15 then null else p.page_id + 1 end
  where p.page_id % 8 <> 3 and (p.page_id % 16 <> 15 or p.page_id % 5 = 4) group by p.url),
r as (
  select distinct url, url as now, [url] as seen, null::varchar as verdict from pages where url is not null
  union all
  select r.url, coalesce(m.dst, r.now), case when m.dst is null then seen else list_append(seen, m.dst) end,
         case when m.src is null then 'OK' when m.dst is null then 'INVALID_REDIRECT' when len(seen) > 3 then 'TOO_MANY_REDIRECTS' when list_contains(seen, m.dst) then 'REDIRECT_LOOP' end
  from r left join m on m.src = r.now where r.verdict is null)
select url, case when verdict = 'OK' then now end as final_url, (len(seen) - 1)::int as hops, verdict from r where verdict is not null
"""

BM25_QUERY = "the report of an Étion in zu 2020 thereof"


def bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty turns that answer a query best, through the index."""
    rows = read(spark, sf_dir, "conversations")
    rows = rows.select(F.concat_ws(":", F.lpad(F.col("conv_id").cast("string"), 8, "0"), F.lpad(F.col("turn").cast("string"), 4, "0")).alias("chunk_id"), "text")
    return ranking.search(ranking.build(rows), BM25_QUERY, 20).select("id", F.round("score", 6).alias("score"))


BM25 = """
with d as (select lpad(conv_id::varchar, 8, '0') || ':' || lpad(turn::varchar, 4, '0') as id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from conversations),
s as (select count(*) as n, avg(len(w)) as mean from d),
q as (select distinct unnest(['the', 'report', 'of', 'an', 'étion', 'in', 'zu', '2020', 'thereof']) as term),
p as (select id, len(w) as l, q.term, len(list_filter(w, lambda x: x = q.term)) as tf from d, q where list_contains(w, q.term)),
f as (select term, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) as idf from p, s group by term)
select id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean))), 6) as score from p join f using (term), s group by id order by sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean))) desc, id limit 20
"""


def complete_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completions of part names and of pages' URLs for three things typed."""
    parts = read(spark, sf_dir, "part").select(F.lit("part").alias("kind"), F.col("p_name").alias("value"))
    pages = read(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("url").alias("value"))
    found = completion.index(parts.unionByName(pages))
    asked = (("part", " GREEN "), ("part", "a"), ("page", "example.com/de"))
    rows = [completion.complete(found, kind, typed, 15).select(F.lit(kind).alias("kind"), F.lit(typed).alias("typed"), "value", "total", "has_more") for kind, typed in asked]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


COMPLETE_KINDS = """
with v as (select distinct 'part' as kind, p_name as value from part union all select distinct 'page', url from pages),
q as (select * from (values ('part', ' GREEN '), ('part', 'a'), ('page', 'example.com/de')) t(kind, typed)),
m as (select kind, typed, value, instr(lower(value), lower(trim(typed))) as pos from v join q using (kind) where trim(value) <> '' and contains(lower(value), lower(trim(typed)))),
r as (select *, count(*) over (partition by kind, typed) as total, row_number() over (partition by kind, typed order by pos, length(value), value) as n from m)
select kind, typed, value, total, total > 15 as has_more from r where n <= 15
"""

def robots_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of a file for each page's site: two groups, comments, an alias, delays that begin with a number."""
    k = F.col("page_id").cast("string")
    lines = F.concat_ws(
        "\n", F.lit("# rules"), F.lit("User-agent: other"), F.concat(F.lit("Disallow: /other"), k), F.concat(F.lit("User-Agent: "), F.when(F.col("page_id") % 3 == 0, "*").when(F.col("page_id") % 3 == 1, "PageBot").otherwise("nobody")),
        F.concat(F.lit(" Disallow : /p"), k, F.lit("#x\r")), F.lit("#Allow: /no"), F.concat(F.lit("ALLOW: /p"), k, F.lit("/open")), F.lit("Allow:"), F.concat(F.lit("Crawl-delay: "), F.col("page_id") % 4, F.lit(".5s")), F.lit("no colon"),
    )
    files = read(spark, sf_dir, "pages").select(F.concat(F.lit("https://s"), k).alias("origin"), F.when(F.col("page_id") % 10 == 9, 404).otherwise(200).alias("status"), lines.alias("body"))
    return gates.parse_robots(files, gates.agent_names("PageBot/1.0 (+https://x)")).select("origin", "allow", "pattern", "crawl_delay")


ROBOTS_PARSE = """
select 'https://s' || page_id as origin, a as allow, case when a then '/p' || page_id || '/open' else '/p' || page_id || '#x' end as pattern, (page_id % 4 + 0.5)::double as crawl_delay
from pages, (select unnest([true, false]) as a) where page_id % 10 <> 9 and page_id % 3 < 2
"""


def feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of a feed for each source's documents: at most twenty, descriptions without tags."""
    d = read(spark, sf_dir, "documents").where("doc_id % 4 < 2").select("source", "doc_id", "lang")
    k = F.col("doc_id").cast("string")
    item = F.concat(F.lit("<item><title>Item "), k, F.lit("</title><link>https://e.com/"), k, F.lit("</link><description>&lt;p&gt;In &amp;amp; of "), F.col("lang"), F.lit("&lt;/p&gt;</description></item>"))
    feeds = d.groupBy("source").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", item.alias("x")))), lambda e: e["x"]), "").alias("items"))
    xml = F.concat(F.lit('<rss version="2.0"><channel><title>News</title><link>https://e.com</link>'), "items", F.lit("</channel></rss>"))
    found = feeds.select("source", F.posexplode(documents.feed_items(xml)).alias("k", "x"))
    return found.select("source", "k", "x.title", "x.link", M.strip_tags(F.col("x.description")).alias("description"))


FEED_ITEMS = """
with d as (select source, doc_id, lang, row_number() over (partition by source order by doc_id) - 1 as k from documents where doc_id % 4 < 2)
select source, k::int as k, 'Item ' || doc_id as title, 'https://e.com/' || doc_id as link, 'In & of ' || lang as description from d where k < 20
"""


def pdf_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of books of six, some without text, some with what a file says of itself."""
    d = read(spark, sf_dir, "documents")
    book = F.floor(F.col("doc_id") / 6).cast("long")
    text = F.when(F.col("doc_id") % 7 < 3, F.lit(" ")).when(F.col("doc_id") % 7 == 3, F.lit(None)).otherwise(F.substring(F.regexp_replace("text", "[^A-Za-z. ]", "x"), 1, 400))
    pages = d.select(book.alias("doc"), (F.col("doc_id") % 6 + 1).cast("int").alias("page_no"), text.alias("text"))
    info = d.where("doc_id % 12 = 0").select(book.alias("doc"), F.concat(F.lit("Book "), book.cast("string")).alias("title"), F.when(F.col("doc_id") % 24 == 0, F.col("source")).alias("author"), F.when(F.col("doc_id") % 36 == 0, "D:20240229").when(F.col("doc_id") % 36 == 12, "D:201912312359").otherwise("soon").alias("created"))
    return documents.pages_markdown(pages, info).select("doc", "title", "author", F.date_format("created_at", "yyyy-MM-dd HH:mm").alias("created_at"), "markdown", "excerpt", "page_count", "empty_pages", "low_confidence", "warning")


PDF_PAGES = """
with p as (select doc_id // 6 as doc, doc_id % 6 + 1 as page, case when doc_id % 7 < 4 then '' else trim(substr(regexp_replace(text, '[^A-Za-z. ]', 'x', 'g'), 1, 400)) end as t from documents),
i as (select doc_id // 6 as doc, 'Book ' || (doc_id // 6) as title, case when doc_id % 24 = 0 then source end as author, case doc_id % 36 when 0 then '2024-02-29 00:00' when 12 then '2019-12-31 23:59' end as made from documents where doc_id % 12 = 0),
g as (select doc, count(*) as n, count(*) filter (t = '') as empty, avg(length(t)) as mean, string_agg(case when t <> '' then '## Page ' || page || chr(10) || chr(10) || t || chr(10) end, chr(10) order by page) as body, trim(string_agg(t, chr(10) || chr(10) order by page), ' ' || chr(10)) as whole from p group by doc)
select doc::bigint as doc, coalesce(title, 'PDF Document (' || n || ' pages)') as title, author, made as created_at,
       rtrim(coalesce('# ' || title || chr(10) || chr(10), '') || coalesce('- **Author:** ' || author || chr(10), '') || coalesce('- **Created:** ' || substr(made, 1, 10) || chr(10), '') || '- **Pages:** ' || n || chr(10) || coalesce(chr(10) || body, ''), chr(10) || ' ') as markdown,
       substr(whole, 1, 300) as excerpt, n as page_count, empty as empty_pages, mean < 100 or empty / n > 0.5 as low_confidence,
       case when mean < 100 or empty / n > 0.5 then 'Low text extraction confidence - PDF may be scanned images. Average ' || floor(mean + 0.5)::bigint || ' chars/page, ' || empty || '/' || n || ' empty pages.' end as warning
from g left join i using (doc)
"""


def url_same_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = F.when(F.col("page_id") % 3 == 0, F.concat("url", F.lit("#top"))).when(F.col("page_id") % 3 == 1, F.replace("url", F.lit(".example."), F.lit(".example.org."))).otherwise(F.regexp_replace("url", "^http(s?)://([^/?#]*)", "HTTP$1://$2:8443"))
    return read(spark, sf_dir, "pages").select("page_id", U.same_origin(F.col("url"), other).alias("same"))


def fetch_cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a response is kept under: the URL as it is normalised, and all that the answer may depend on."""
    headers = F.create_map(F.lit("X-Page"), F.col("page_id").cast("string"), F.lit("Accept"), F.lit("a/b"))
    url = F.concat(F.lit("https://E.com/p/"), F.col("page_id").cast("string"), F.lit("/?b=2&utm_source=x&a="), (F.col("page_id") % 5).cast("string"))
    return read(spark, sf_dir, "pages").select("page_id", packets.cache_key(url, F.lit("agent/1"), headers, F.lit(1000), F.lit(5)).alias("key"))


def resource_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of resources, well-formed and not, and what they name."""
    k, kinds = F.col("page_id").cast("string"), F.array(*[F.lit(x) for x in ("packet", "content", "normalized", "screenshot", "other")])
    uri = F.concat(F.lit("inkwell://"), F.get(kinds, (F.col("page_id") % 5).cast("int")), F.lit("/"), F.when(F.col("page_id") % 7 == 0, F.concat(k, F.lit("/x"))).when(F.col("page_id") % 7 == 1, F.concat(k, F.lit("%20b"))).when(F.col("page_id") % 7 == 2, F.concat(k, F.lit("?q"))).otherwise(k))
    found = read(spark, sf_dir, "pages").select("page_id", U.parse_resource(uri).alias("x"))
    return found.select("page_id", "x.kind", "x.source_id", U.build_resource(F.col("x.kind"), F.col("x.source_id")).alias("again"))


RESOURCE_PARSE = """
with r as (select page_id, ['packet', 'content', 'normalized', 'screenshot', 'other'][page_id % 5 + 1] as kind, page_id % 5 < 4 and page_id % 7 not in (0, 2) as good, page_id % 7 = 1 as spaced from pages)
select page_id, case when good then kind end as kind, case when good then page_id || case when spaced then ' b' else '' end end as source_id,
       case when good then 'inkwell://' || kind || '/' || page_id || case when spaced then '+b' else '' end end as again from r
"""


def scope_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a conversation's packets are stored and looked for, by the scope it asks for."""
    rows = read(spark, sf_dir, "conversations").where("turn = 0")
    k, kinds = F.col("conv_id").cast("string"), F.array(*[F.lit(x) for x in ("global", "workspace", "conversation", "conversation", "conversation")])
    thread = F.when(F.col("conv_id") % 5 == 3, "  ").when(F.col("conv_id") % 5 < 4, k)
    columns = [F.lit("w1"), thread, F.concat(F.lit("t"), k), F.lit("base/")]
    kind = F.get(kinds, (F.col("conv_id") % 5).cast("int"))
    rows = rows.select("conv_id", retrieval.scope_of(kind, *columns).alias("a"), retrieval.scope_of(kind, *columns, require_thread=True)["error"].alias("strict_error"))
    return rows.select("conv_id", "a.*", "strict_error")


SCOPE_PREFIXES = """
with s as (select conv_id, case conv_id % 5 when 0 then 'global' when 2 then 'conversation' else 'workspace' end as scope from conversations where turn = 0),
p as (select *, case scope when 'global' then 'base/' when 'workspace' then 'base/workspaces/w1/' else 'base/workspaces/w1/conversations/t' || conv_id || '/' end as prefix from s)
select conv_id, scope, case when scope <> 'global' then 'w1' end as workspace_id, case when scope = 'conversation' then 't' || conv_id end as conversation_id, prefix as upload_prefix,
       case when scope = 'global' then '' else prefix end as folder_prefix, null::varchar as error, case when conv_id % 5 > 2 then 'AI_SEARCH_MISSING_THREAD_KEY' end as strict_error from p
"""


def search_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search request for each turn, and how long it waits."""
    rows = read(spark, sf_dir, "conversations")
    k = F.col("turn")
    set_ = {"rewrite_query": F.when(k % 3 > 0, k % 3 == 1), "max_num_results": F.when(k % 2 == 0, k)}
    given = {"model": F.when(k % 4 == 0, F.lit("")).when(k % 4 == 1, F.lit("m")), "system_prompt": F.when(k % 5 == 0, F.concat(F.lit('say "'), F.col("role"), F.lit('"')))}
    return rows.select("conv_id", "turn", retrieval.request_json(F.col("role"), set_, given).alias("request"), retrieval.wait_ms((k - 2) * 4000, 15_000).alias("wait_ms"))


SEARCH_REQUESTS = """
select conv_id, turn, '{"query":"' || role || '"' || case turn % 3 when 1 then ',"rewrite_query":true' when 2 then ',"rewrite_query":false' else '' end || case when turn % 2 = 0 then ',"max_num_results":' || turn else '' end
  || case when turn % 4 = 1 then ',"model":"m"' else '' end || case when turn % 5 = 0 then ',"system_prompt":"say \\"' || role || '\\""' else '' end || '}' as request,
  least(greatest((turn - 2) * 4000, 0), 15000)::bigint as wait_ms from conversations
"""


def outline_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines of given headings: each source's documents in order, levels by number."""
    heads = read(spark, sf_dir, "documents").select("source", "doc_id", (F.col("doc_id") * 7 % 5 + 1).cast("int").alias("level"), F.concat(F.lit("h"), F.col("doc_id").cast("string")).alias("text"))
    return MD.outline_rows(heads, "source", "doc_id")


OUTLINE_HEADINGS = """
with recursive h as (select source, (doc_id * 7 % 5 + 1)::int as level, 'h' || doc_id as text, row_number() over (partition by source order by doc_id) as i from documents),
r as (
  select source, 0::bigint as i, 0 as level, '' as text, []::varchar[] as parts from (select distinct source from h)
  union all
  select h.source, h.i, h.level, h.text, list_append(r.parts[1:h.level - 1], h.text) from r join h on h.source = r.source and h.i = r.i + 1)
select source, (i - 1)::int as k, level, text, array_to_string(parts, ' > ') as path from r where i > 0
"""


def summary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a document is about: its headings, numbers and dates near the start, and its length."""
    rows = derived(read(spark, sf_dir, "documents")).withColumn("md", F.concat(F.col("md"), F.lit("\n\nOn May 5, 2021 and 2020-01-02 or 3/4/21 it was 12.5% of $1,200K.")))
    start = F.concat(F.substring("md", 1, 60), F.lit(" 7 of 2021-12-31, 7 "), F.substring("md", 61, 10_000_000))
    rows = rows.withColumn("md", start)
    return rows.select("doc_id", F.array_join(M.source_summary(F.col("md"), MD.outline_column("md")), "\n").alias("summary"))


_START_SQL = "substr(md, 1, 60) || ' 7 of 2021-12-31, 7 ' || substr(md, 61)"
SUMMARY_LINES = rf"""
with d as (select doc_id, md || repeat(chr(10), 2) || 'On May 5, 2021 and 2020-01-02 or 3/4/21 it was 12.5% of $1,200K.' as md from {DERIVED_SQL}),
t as (select doc_id, {_START_SQL} as md from d),
l as (select doc_id, unnest(string_split(md, chr(10))) as line, generate_subscripts(string_split(md, chr(10)), 1) as i from t),
h as (select doc_id, i, trim(regexp_extract(line, '^#{{1,6}}\s+(.+)$', 1)) as text, row_number() over (partition by doc_id order by i) as n, length(regexp_extract(line, '^#+')) as level from l where regexp_matches(line, '^#{{1,6}}\s+.')),
tp as (select doc_id, string_agg(text, ', ' order by i) as topics from h where level <= 2 group by doc_id),
x as (select doc_id, regexp_extract_all(substr(md, 1, 2000), '[0-9]+(?:,[0-9]{{3}})*(?:\.[0-9]+)?%?|\$[0-9]+(?:,[0-9]{{3}})*(?:\.[0-9]+)?[KMB]?') as nums,
  regexp_extract_all(substr(md, 1, 2000), '(?i)\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+[0-9]{{1,2}},?\s+[0-9]{{4}}|\b[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{2,4}}\b|\b[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}\b') as dates,
  len(regexp_split_to_array(md, '\s+')) as words from t),
u as (select doc_id, words, list_filter(nums, lambda v, k: list_position(nums, v) = k)[1:5] as nums, list_filter(dates, lambda v, k: list_position(dates, v) = k)[1:3] as dates from x)
select u.doc_id, coalesce('Main topics: ' || topics || chr(10), '') || case when len(nums) > 0 then 'Key numbers mentioned: ' || array_to_string(nums, ', ') || chr(10) else '' end
  || case when len(dates) > 0 then 'Dates mentioned: ' || array_to_string(dates, ', ') || chr(10) else '' end || 'Content length: ~' || words || ' words' as summary
from u left join tp using (doc_id)
"""


def resource_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of resources of a store that has two thirds of the packets and half of the screenshots."""
    pages = read(spark, sf_dir, "pages").select("page_id", F.col("page_id").cast("string").alias("source_id"))
    store = pages.where("page_id % 3 > 0").select("source_id", F.concat(F.lit("text of "), "source_id").alias("content"), F.when(F.col("page_id") % 2 == 0, "cG5n").alias("screenshot_base64"), F.lit("h").alias("hashes"))
    kinds = F.array(*[F.lit(k) for k in (*U.RESOURCE_KINDS, "other")])
    uris = pages.select("source_id", F.explode(kinds).alias("kind")).select(F.concat(F.lit("inkwell://"), "kind", F.lit("/"), "source_id").alias("uri"))
    return packets.read_resources(store, uris)


RESOURCE_READ = """
with u as (select page_id, unnest(['packet', 'content', 'normalized', 'screenshot', 'other']) as kind from pages),
r as (select 'inkwell://' || kind || '/' || page_id as uri, kind, case when page_id % 3 > 0 then case kind
  when 'packet' then '{"source_id":"' || page_id || '","content":"text of ' || page_id || '"' || case when page_id % 2 = 0 then ',"screenshot_base64":"cG5n"' else '' end || ',"hashes":"h"}'
  when 'content' then 'text of ' || page_id when 'normalized' then '{"source_id":"' || page_id || '","content":"text of ' || page_id || '"' || case when page_id % 2 = 0 then ',"screenshot_base64":"cG5n"' else '' end || '}'
  when 'screenshot' then case when page_id % 2 = 0 then 'cG5n' end end end as text from u)
select uri, case when text is not null then case kind when 'content' then 'text/markdown' when 'screenshot' then 'image/png' else 'application/json' end end as mime_type, text, case when text is null then 'Resource not found' end as error from r
"""


def html_readability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose article isn't marked: words of the page and of the article found, and whether it stands for the page."""
    bare = F.regexp_replace("html", "(?i)<(/?)(article|main)", "<$1div")
    rows = read(spark, sf_dir, "pages").withColumn("e", html.extract_column(bare))
    return rows.select("page_id", "e.whole_words", "e.read_words", gates.readability_fits(F.col("e.whole_words"), F.col("e.read_words")).alias("fits"))


def fetch_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages served whole, thin, not at all, or from a host that needs a browser; a browser made four fifths of them."""
    k = F.col("page_id")
    url = F.when(k % 4 == 2, F.concat(F.lit("https://medium.com/p/"), k)).otherwise(F.concat(F.lit("https://e.com/p/"), k))
    shell = F.concat(F.lit("<html><body><p>Please enable JavaScript</p><script>"), F.repeat(F.lit("var x = 1; "), 600), F.lit("</script></body></html>"))
    full = F.concat(F.lit("<html><body><main>"), F.repeat(F.lit("<h2>Part</h2><p>One of many sentences that a page has. </p>"), 50), F.lit("</main></body></html>"))
    page = [url.alias("original_url"), url.alias("final_url"), F.lit("text/html").alias("content_type"), F.to_timestamp(F.lit("2024-01-01 00:00:00")).alias("retrieved_at")]
    rows = read(spark, sf_dir, "pages")
    served = rows.select(*page, F.when(k % 4 == 0, 404).otherwise(200).alias("status"), F.encode(F.when(k % 4 == 1, shell).otherwise(full), "UTF-8").alias("body"))
    made = rows.where(k % 5 > 0).select(*page, F.lit(200).alias("status"), F.encode(full, "UTF-8").alias("body"), F.when(k % 3 == 0, F.encode(F.lit("png"), "UTF-8")).alias("screenshot"))
    return packets.fetch_rendered(served, made).select("original_url", "success", "error_code", "used_render", "screenshot_base64", F.length("content").cast("long").alias("chars"))


FETCH_FALLBACK = """
select case when page_id % 4 = 2 then 'https://medium.com/p/' else 'https://e.com/p/' end || page_id as original_url, page_id % 4 <> 0 as success, case when page_id % 4 = 0 then 'HTTP_404' end as error_code,
       page_id % 4 in (1, 2) and page_id % 5 > 0 as used_render, case when page_id % 4 in (1, 2) and page_id % 5 > 0 and page_id % 3 = 0 then 'cG5n' end as screenshot_base64,
       case when page_id % 4 = 0 then null when page_id % 4 = 1 and page_id % 5 = 0 then length('Please enable JavaScript') else 50 * (length('## Part') + length('One of many sentences that a page has.') + 2) + 49 * 2 end::bigint as chars from pages
"""

QUERIES = {
    "rate_wait": rate_wait, "cache_replay": cache_replay, "cache_lookup": cache_lookup, "delay_schedule": delay_schedule, "redirect_chains": redirect_chains, "retrieve_bm25": bm25, "complete_kinds": complete_kinds,
    "robots_parse": robots_parse, "xml_feed_items": feed_items, "pdf_pages": pdf_pages, "url_same_origin": url_same_origin, "fetch_cache_key": fetch_cache_key, "resource_parse": resource_parse,
    "scope_prefixes": scope_prefixes, "html_readability": html_readability,
    "search_requests": search_requests, "outline_headings": outline_headings, "summary_lines": summary_lines, "resource_read": resource_read, "fetch_fallback": fetch_fallback,
}

ORACLES = {
    "rate_wait": RATE_WAIT, "cache_replay": CACHE_REPLAY, "cache_lookup": CACHE_LOOKUP, "delay_schedule": DELAY_SCHEDULE, "redirect_chains": REDIRECT_CHAINS, "retrieve_bm25": BM25, "complete_kinds": COMPLETE_KINDS,
    "robots_parse": ROBOTS_PARSE, "xml_feed_items": FEED_ITEMS, "pdf_pages": PDF_PAGES, "url_same_origin": "select page_id, page_id % 3 = 0 as same from pages",
    "fetch_cache_key": "select page_id, 'https://e.com/p/' || page_id || '?a=' || (page_id % 5) || '&b=2::agent/1::accept:a/b|x-page:' || page_id || '::1000::5' as key from pages",
    "resource_parse": RESOURCE_PARSE, "scope_prefixes": SCOPE_PREFIXES,
    "search_requests": SEARCH_REQUESTS, "outline_headings": OUTLINE_HEADINGS, "summary_lines": SUMMARY_LINES, "resource_read": RESOURCE_READ, "fetch_fallback": FETCH_FALLBACK,
}
