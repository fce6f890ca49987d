"""Redirects, ranked retrieval, completion and ingest: against plain definitions, with odd rows and failures."""

import math
import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from inkwell.operators import completion, ranking, redirects
from inkwell.sources import partfiles, web

# --- redirects ---------------------------------------------------------------


def plain_follow(url, to, most):
    seen = [url]
    for hop in range(most + 1):
        if url not in to:
            return url, len(seen) - 1, "OK"
        if to[url] is None:
            return None, len(seen) - 1, "INVALID_REDIRECT"
        url = to[url]
        loop = url in seen
        seen.append(url)
        if hop == most:
            return None, len(seen) - 1, "TOO_MANY_REDIRECTS"
        if loop:
            return None, len(seen) - 1, "REDIRECT_LOOP"


@pytest.mark.parametrize("most", [0, 2, 5])
def test_redirects_are_followed(spark, most):
    rng = random.Random(7)
    to = {f"u{i}": rng.choice([f"u{rng.randrange(60)}", f"u{i + 1}", None if i % 9 == 0 else f"u{i + 1}"]) for i in range(40)}
    to |= {"u9": None, "u18": None, "u20": "u20", "u30": "u31", "u31": "u30"}
    urls = [f"u{i}" for i in range(60)] + ["u1", None]
    moves = spark.createDataFrame([*to.items(), ("u2", "zzz"), (None, "u1")], "src string, dst string")
    got = {r.url: (r.final_url, r.hops, r.verdict) for r in redirects.follow(spark.createDataFrame([(u,) for u in urls], "url string"), moves, most).collect()}
    to["u2"] = min(x for x in (to["u2"], "zzz") if x)
    assert got == {u: plain_follow(u, to, most) for u in set(urls) if u}
    assert len({v for _, _, v in got.values()}) == (3 if most == 0 else 4)


# --- ranked retrieval --------------------------------------------------------


def plain_bm25(texts, query, k):
    words = {i: re.findall(r"[^\W_]+", (t or "").lower()) for i, t in texts}
    n, mean = len(texts), sum(map(len, words.values())) / len(texts)
    scores = {}
    for term in sorted(set(re.findall(r"[^\W_]+", query.lower()))):
        df = sum(term in w for w in words.values())
        for i, w in words.items():
            if tf := w.count(term):
                scores[i] = scores.get(i, 0) + math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
    return sorted(((round(-s, 9), i) for i, s in scores.items()))[:k]


@pytest.mark.parametrize("k", [1, 7, 1000])
def test_index_finds_what_a_scan_finds(spark, tmp_path, monkeypatch, k):
    monkeypatch.setattr(ranking, "BLOCK", 8)
    rng = random.Random(8)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    texts = [(i, " ".join(rng.sample(words, rng.choice([1, 5, 60])))) for i in range(300)] + [(300, None), (301, ""), (302, "w1 W1, w1!"), (303, "w1 w1 w1")]
    index = ranking.build(spark.createDataFrame(texts, "chunk_id long, text string"))
    index.save(str(tmp_path))
    loaded = ranking.Index.load(spark, str(tmp_path))
    assert (loaded.documents, loaded.mean) == (index.documents, index.mean)
    for query in ("w1 w3 w40", "W7", "none at all", ""):
        got = [(round(-r.score, 9), r.id) for r in ranking.search(loaded, query, k).collect()]
        assert got == plain_bm25(texts, query, k), query
    assert ranking.search(loaded, "w1", 5, threshold=1e6).count() == 0
    assert ranking.search(ranking.build(spark.createDataFrame([], "chunk_id long, text string")), "w1").count() == 0


def test_a_search_skips_blocks(spark, monkeypatch):
    monkeypatch.setattr(ranking, "BLOCK", 4)
    texts = [(i, "rare common" if i < 3 else "common " * (2 + i % 50)) for i in range(400)]
    index = ranking.build(spark.createDataFrame(texts, "chunk_id long, text string"))
    assert [r.id for r in ranking.search(index, "rare common", 3).collect()] == [0, 1, 2]
    plan = ranking.search(index, "rare common", 3)._jdf.queryExecution().toString()
    assert "LeftSemi" in plan and index.blocks.select("block").distinct().count() > 20


# --- completion --------------------------------------------------------------


def test_completion_by_kind(spark, tmp_path):
    rng = random.Random(9)
    values = [("packet", "".join(rng.choice("abCé ") for _ in range(rng.randrange(1, 9)))) for _ in range(400)] + [("packet", None), ("packet", "  "), ("other", "abc"), (None, "abc")]
    found = completion.index(spark.createDataFrame(values, "kind string, value string"))
    found.save(str(tmp_path))
    found = completion.CompletionIndex.load(spark, str(tmp_path))
    some = {v for k, v in values if k == "packet" and v and v.strip(" ")}
    for typed in ("a", " AB", "abc", "abca", "é", "zz", "c abc a"):
        low = typed.strip().lower()
        want = sorted((v.lower().index(low), len(v), v) for v in some if low in v.lower())
        got = completion.complete(found, "packet", typed, 20).collect()
        assert [r.value for r in got] == [v for _, _, v in want[:20]], typed
        assert all((r.total, r.has_more) == (len(want), len(want) > 20) for r in got)
    assert [r.value for r in completion.complete(found, "packet", " ", 5).collect()] == sorted(some)[:5]
    assert completion.complete(found, "none", "a").count() == 0
    packets = spark.createDataFrame([("p", None), ("q", "png")], "source_id string, screenshot string")
    assert sorted(map(tuple, completion.resource_candidates(packets).collect())) == sorted([(k, s) for s in "pq" for k in ("packet", "content", "normalized")] + [("screenshot", "q")])


# --- ingest ------------------------------------------------------------------


def packets(spark, n=4):
    rows = [(f"s{i}", f"https://e.com/{i}", f"https://e.com/{i}", "2024-01-01", f"hash{i}", "text/html", "T", "\n\n".join(f"paragraph {k} of {i} " + "x" * 200 for k in range(i * 3))) for i in range(n)]
    return spark.createDataFrame(rows, "source_id string, original_url string, canonical_url string, retrieved_at string, content_hash string, content_type string, title string, content string")


def tree(path, inside=""):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in sorted(Path(path).rglob("*")) if p.is_file() and not p.name.startswith((".", "_")) and str(p.relative_to(path)).startswith(inside or ("e.com", "k/"))}


def test_ingest_stores_once(spark, tmp_path):
    store = str(tmp_path / "store")
    first = {r.source_id: r for r in partfiles.ingest(packets(spark), store, 900, "k").collect()}
    files = tree(store)
    assert all(r.uploaded and not r.skipped_existing and r.error is None for r in first.values()) and first["s3"].parts > 1
    assert len(files) == sum(r.parts for r in first.values()) and all((Path(store) / f).stat().st_size <= 900 for f in files)
    assert sum((Path(store) / f).stat().st_size for f in files) == sum(r.bytes for r in first.values())
    whole = "\n\n".join(re.sub(r"(?s)^---.*?---\n\n", "", (Path(store) / f).read_text()) for f in files if f.startswith("k/e.com/3/"))
    assert whole == packets(spark).where("source_id = 's3'").first().content
    again = {r.source_id: r for r in partfiles.ingest(packets(spark, 5), store, 900, "k").collect()}
    assert [again[f"s{i}"].skipped_existing for i in range(5)] == [True] * 4 + [False] and again["s4"].uploaded
    assert {f: t for f, t in tree(store).items() if f in files} == files and not (Path(store) / "_staging").exists()
    # a packet whose last part is missing is stored again
    last = sorted(f for f in files if f.startswith("k/e.com/3/"))[-1]
    (Path(store) / last).unlink()
    third = {r.source_id: r for r in partfiles.ingest(packets(spark), store, 900, "k").collect()}
    assert third["s3"].uploaded and third["s2"].skipped_existing and last in tree(store)


def test_heads_that_are_too_large(spark, tmp_path):
    got = partfiles.ingest(packets(spark, 2), str(tmp_path / "s"), 50).collect()
    assert all(not r.uploaded and r.error.startswith("CONTENT_TOO_LARGE") for r in got) and tree(tmp_path / "s") == {}


def test_an_aborted_write_leaves_nothing(spark, tmp_path):
    spark.dataSource.register(partfiles.PartFiles)
    rows = spark.range(40).select(F.concat(F.lit("k/"), "id").alias("key"), F.when(F.col("id") == 37, F.lit(None)).otherwise("text").alias("text")).repartition(8)
    with pytest.raises(Exception, match="encode|NoneType"):
        rows.write.format("partfiles").option("path", str(tmp_path / "s")).mode("append").save()
    assert tree(tmp_path / "s") == {} and not (tmp_path / "s" / "_staging").exists()


def test_retries_wait_longer_each_time():
    waits, left = [], [2]

    def work():
        left[0] -= 1
        if left[0] >= 0:
            raise OSError("again")
        return "done"

    assert partfiles.with_retries(work, sleep=waits.append) == "done" and waits == [0.5, 1.0]
    left[0] = 9
    with pytest.raises(OSError):
        partfiles.with_retries(work, sleep=waits.append)


# --- fetching ----------------------------------------------------------------


def test_bad_addresses_and_headers_are_rows():
    served = {
        "http://a/": web.Response(302, {"location": "http://[bad/"}), "http://b/": web.Response(200, {"content-length": "12, 12"}, b"body"), "http://c/": web.Response(200, {"content-length": "99"}, b"x"),
        "http://d/": web.Response(302, {"location": "//[x"}), "http://e/": web.Response(200, {"content-length": "²"}, b"body"),
    }
    options = dict(transport=lambda url, *_: served[url], max_bytes=50)
    codes = {u: web.row_of(u, **options)[7] for u in (*served, "http://[bad/")}
    assert codes == {"http://a/": "INVALID_REDIRECT", "http://b/": None, "http://c/": "CONTENT_TOO_LARGE", "http://d/": "INVALID_REDIRECT", "http://e/": None, "http://[bad/": "INVALID_URL"}
    assert sum(len(p.urls) for p in web._Reader({"urls": '["http://[bad/", "http://a/"]'}).partitions()) == 2


def test_both_readers_of_crawl_rules_agree(spark):
    from inkwell.operators import gates

    rng = random.Random(11)
    words = ["User-agent: *", "user-AGENT : Bot", "User-agent: bot/2.0 (x)", "User-agent: inkwell", "User-agent: other", "Disallow: /a", "Allow: /a/b ", " disallow:/c#d", "# Disallow: /no", "Disallow:", "Crawl-delay: 2s", "Crawl-delay: .5", "crawl-delay: -3", "Crawl-delay: 1e1x", "Crawl-delay: soon", "nothing", " Allow: / ", ""]
    files = [(f"https://s{i}", 404 if i == 7 else 200, None if i == 8 else "\n".join(w + rng.choice(["", "\r"]) for w in rng.choices(words, k=rng.randrange(0, 14)))) for i in range(60)]
    names = gates.agent_names("Bot/2.0 (x)")
    assert names == ("bot", "bot/2.0 (x)", "inkwell", "*")
    rows = gates.parse_robots(spark.createDataFrame(files, "origin string, status int, body string"), names).collect()
    for origin, status, body in files:
        rules, delay = web.rules_of(body, names) if status == 200 and body is not None else ([], 0.0)
        mine = [r for r in rows if r.origin == origin]
        assert sorted((r.allow, r.pattern) for r in mine if r.pattern is not None) == sorted(rules), body
        assert {r.crawl_delay for r in mine} <= {delay or None} and (not delay or mine), body


def test_pages_of_a_book(spark):
    from inkwell.operators import documents

    pages = spark.createDataFrame([("a", 2, "two " * 60), ("a", 1, " one  "), ("a", 3, None), ("b", 1, ""), (None, 1, "x" * 200)], "doc string, page_no int, text string")
    got = {r.doc: r for r in documents.pages_markdown(pages).collect()}
    assert got["a"].markdown == f"- **Pages:** 3\n\n## Page 1\n\none\n\n## Page 2\n\n{('two ' * 60).strip()}" and got["a"].title == "PDF Document (3 pages)"
    assert got["a"].low_confidence and got["a"].warning.endswith("Average 81 chars/page, 1/3 empty pages.") and got["b"].low_confidence and not got[None].low_confidence and got[None].warning is None
    info = spark.createDataFrame([("a", "T", "", None), (None, None, "A", "D:2020")], "doc string, title string, author string, created string")
    told = {r.doc: r for r in documents.pages_markdown(pages, info).collect()}
    assert told["a"].markdown.startswith("# T\n\n- **Pages:** 3\n\n") and told[None].markdown.startswith("- **Author:** A\n- **Created:** 2020-01-01\n- **Pages:** 1\n")


def site_with(answers):
    """A transport that answers from lists, in turn, and notes what was asked."""
    asked = []

    def served(url, *_):
        asked.append(url)
        answer = answers[url].pop(0) if len(answers[url]) > 1 else answers[url][0]
        if isinstance(answer, Exception):
            raise answer
        return answer

    return served, asked


def test_a_fetch_looks_into_memory_and_waits_its_turn():
    now, waits = [0.0], []
    page = web.Response(200, {}, b"x")
    served, asked = site_with({f"http://h/{i}": [page] for i in range(9)} | {"http://h/busy": [web.Response(429, {"retry-after": "20s"})], "http://k/": [OSError("no route")]})
    memory = web.Memory(per_host=2, ttl_seconds=100, clock=lambda: now[0], sleep=waits.append)
    code = lambda url: web.row_of(url, memory, transport=served, attempts=1)[7]
    assert [code(f"http://h/{i}") for i in (0, 0, 1)] == [None] * 3 and asked == ["http://h/0", "http://h/1"] and waits == []
    now[0] = 20.0
    assert code("http://h/2") == "RATE_LIMITED" and code("http://h/0") is None and len(asked) == 2
    now[0] = 35.0
    assert code("http://h/2") is None and waits == [25.0]
    now[0] = 61.0
    assert code("http://h/3") is None and waits == [25.0]
    now[0] = 122.0
    # kept too long, so it is asked for again; then the host wants a pause, which all its pages share
    assert code("http://h/0") is None and asked[-1] == "http://h/0" and code("http://h/busy") == "HTTP_429"
    waits.clear()
    assert code("http://h/4") is None and waits == [20.0]
    assert code("http://k/") == "FETCH_ERROR" and code("http://k/") == "FETCH_ERROR" and waits[1:] == [2.0]
    assert code("http://[bad/") == "INVALID_URL" and code("ftp://h/") == "INVALID_PROTOCOL"


def test_gates_come_before_memory():
    served, asked = site_with({"http://h/": [web.Response(302, {"location": "/to"})], "http://h/to": [web.Response(200, {}, b"x")]})
    seen, memory = [], web.Memory()
    gate = lambda url: seen.append(url) or (("SSRF_BLOCKED", "no") if len(seen) > 3 else None)
    row = lambda: web.row_of("http://h/", memory, gate, transport=served)
    assert row()[1] == "http://h/to" and seen == ["http://h/", "http://h/to"] and row()[5] == b"x" and asked == ["http://h/", "http://h/to"]
    assert row()[7] == "SSRF_BLOCKED" and len(asked) == 2
