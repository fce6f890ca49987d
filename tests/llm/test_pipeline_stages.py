"""Stages of the pipeline against brute force on a small table, each on its own input."""

import re

import numpy as np
import pytest
from test_llm import roots

import corpus_pipeline
from inkwell.llm.hashing import jaccard

VOCABULARY = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """Documents with copies, near copies above and below the bound, benchmark passages, nulls, empty texts and a repeated row."""
    rng = np.random.default_rng(21)
    draw = lambda n: " ".join(rng.choice(VOCABULARY, n))
    items = [draw(n) for n in (14, 30, 10, 6)] + [None, ""]
    texts = []
    for edits in (0, 2, 6, 12, 25):
        base = rng.choice(VOCABULARY, 200)
        for _ in range(4):
            words = base.copy()
            words[rng.choice(200, edits, replace=False)] = rng.choice(VOCABULARY, edits)
            texts.append(" ".join(words))
    texts += [f"{draw(40)}, {items[0]}! {draw(30)}", f"{items[1].upper()} {draw(5)}", f"{draw(60)}\n{items[2]}\n{draw(3)} {items[3]}", draw(80), None, "", " \n", "One. two", "one. TWO"]
    rows = [(i, t, "en", f"s{i % 3}", None if t is None else len(t), f"kept {i}") for i, t in enumerate(texts)]
    rows += [rows[3], (None, texts[3], "en", None, None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, __row string")
    sf_dir = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{sf_dir}/benchmark.parquet")
    return docs, rows, items, sf_dir


def test_near_copies_stage(spark, made):
    docs, rows, _, sf_dir = made
    texts = [r[1] for r in rows]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(texts[i], texts[j], 5) >= 0.8]
    component = roots(near, len(texts))
    # one row of each group's smallest id stays, and so do rows without an id
    least = {c: min(r[0] for r, k in zip(rows, component, strict=True) if k == c and r[0] is not None) for c in set(component)}
    want = sorted({r for r, c in zip(rows, component, strict=True) if r[0] is None or r[0] == least[c]}, key=str)
    got = corpus_pipeline.drop_near_copies(spark, docs, sf_dir)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect()), key=str) == want
    assert len({component[i] for i in range(20)}) not in (5, 20)


def test_benchmark_stage(spark, made):
    docs, rows, items, sf_dir = made
    split = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    windows = {tuple(w[k : k + 10]) for w in map(split, items) for k in range(max(1, len(w) - 9)) if w}
    want = {}
    for r in rows:
        words, hit = split(r[1]), set()
        for w in windows:
            for k in range(len(words) - len(w) + 1):
                if tuple(words[k : k + len(w)]) == w:
                    hit |= set(range(k, k + len(w)))
        if len(hit) <= corpus_pipeline.MOST_BENCHMARK_SHARE * max(1, len(words)):
            want[r[5]] = [w for k, w in enumerate(words) if k not in hit], bool(hit), r
    got = {r["__row"]: r for r in corpus_pipeline.cut_benchmark(spark, docs, sf_dir).collect()}
    assert got.keys() == want.keys() and 0 < sum(h for _, h, _ in want.values()) and len(want) < len({r[5] for r in rows})
    for name, (words, hit, row) in want.items():
        r = got[name]
        assert split(r.text) == words, name
        assert (r.doc_id, r.lang, r.source) == (row[0], row[2], row[3]) and (hit or r.text == row[1]) and r.n_chars == (None if r.text is None else len(r.text))


def test_stages_of_an_empty_table(spark, made):
    docs, _, _, sf_dir = made
    none = docs.where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf_dir).count() == 0, name


def test_mixing_and_sharding_stages_keep_what_they_take(spark, made):
    docs, rows, _, sf_dir = made
    mixed = corpus_pipeline.mix_sources(spark, docs, sf_dir)
    assert mixed.columns == docs.columns
    taken = [tuple(r) for r in mixed.collect()]
    assert set(taken) <= set(rows) and all(taken.count(r) <= 3 * rows.count(r) for r in set(taken))
    sharded = corpus_pipeline.assign_shards(spark, docs, sf_dir).collect()
    assert sorted((tuple(r[c] for c in docs.columns) for r in sharded), key=str) == sorted(rows, key=str)
    slots = [sorted(r.slot for r in sharded if r.shard == k) for k in range(16)]
    assert all(s == list(range(len(s))) for s in slots) and max(map(len, slots)) - min(map(len, slots)) <= 1
