"""The ten operators on small tables: nulls, empty and long texts, ties, repeats, empty tables, odd columns."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.llm import gph, langid, quality, secrets, toxicity
from inkwell.llm.automaton import SuffixAutomaton
from inkwell.llm.components import components
from inkwell.llm.decontaminate import contamination, decontaminate
from inkwell.llm.hashing import bit_counts, jaccard, shingle_hashes, simhash
from inkwell.llm.mixing import block_quotas, mix, resample, source_targets
from inkwell.llm.pieces import Lattice
from inkwell.llm.sharding import shard
from inkwell.llm.simhash import drop_copies, near_copies, near_duplicates
from inkwell.llm.substring import remove_repeats
from inkwell.llm.topk import top_k

SCHEMA = "doc_id long, text string, lang string, source string, score string, row string, w int"
RNG = np.random.default_rng(3)
WORDS = [f"w{i}" for i in range(400)]


def prose(n):
    return " ".join(RNG.choice(WORDS, n))


def table(spark, texts, **kw):
    rows = [(i, t, kw.get("lang"), kw.get("source", "a"), None, None, 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def texts():
    base = [prose(120) for _ in range(12)]
    near = [base[0].replace("w1", "x", 1), base[1] + " more"]
    shared = prose(70)
    return [*base, *near, base[2], base[2], None, "", "  \n", "one", "one", prose(5000), f"{prose(30)} {shared} {prose(30)}", f"{prose(20)} {shared}"]


def roots(pairs, n):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_fingerprint_by_definition():
    text = " ".join(WORDS[:300])
    h = shingle_hashes(text, 4, 42)
    bits = [(int(x) >> b) & 1 for b in range(64) for x in h]
    assert bit_counts(h).tolist() == [sum(bits[b * len(h) : (b + 1) * len(h)]) for b in range(64)]
    assert simhash(None, 4, 42) == simhash(" ", 4, 42) == 0 and len(shingle_hashes("a b", 4, 42)) == 1


def test_simhash_components(spark, texts):
    got = {r.doc_id: r for r in near_duplicates(table(spark, texts)).collect()}
    fps = [simhash(t, 4, 42) for t in texts]
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if bin((fps[i] ^ fps[j]) & (2**64 - 1)).count("1") <= 4]
    want = roots(pairs, len(fps))
    assert all(got[i].fp == fps[i] and got[i].component_id == want[i] for i in range(len(fps)))
    assert near_duplicates(table(spark, [])).count() == 0


@pytest.mark.parametrize("cell", [4, 1024])
def test_pigeonhole_finds_all(spark, cell):
    base = RNG.integers(-(2**63), 2**63 - 1, 40)
    fps = sorted({int(x) for x in base} | {int(np.int64(x) ^ np.int64(sum(1 << int(b) for b in RNG.choice(63, 3, replace=False)))) for x in base for _ in range(4)})
    links = gph.near_links(spark.createDataFrame([(x,) for x in fps], "node long"), 4, cell=cell)
    found = {r.node: r.root for r in components(links).collect()}
    at = {x: i for i, x in enumerate(fps)}
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if bin((fps[i] ^ fps[j]) & (2**64 - 1)).count("1") <= 4]
    want = roots(pairs, len(fps))
    assert [at[found.get(x, x)] for x in fps] == want


def test_thresholds_add_up():
    n, both = 1000, np.full((64, 64), 250.0) + np.eye(64) * 250
    for tau in (2, 4, 7):
        plan = gph.make_plan(n, both, tau)
        assert sum(plan.thresholds) == tau - len(plan.groups) + 1 and sorted(b for g in plan.groups for b in g) == list(range(64))


def test_near_copies_by_jaccard(spark, texts):
    got = {r.doc_id: r.component_id for r in near_copies(table(spark, texts)).collect()}
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(texts[i], texts[j], 5) >= 0.8]
    assert [got[i] for i in range(len(texts))] == roots(pairs, len(texts))
    kept = drop_copies(table(spark, texts).unionByName(table(spark, texts[:3])))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values()))


def test_language_lattice_sums_all_segmentations():
    lattice = Lattice(["▁", "▁a", "a", "b", "ab"])
    p = np.array([[0.2], [0.1], [0.3], [0.15], [0.2], [0.05]])
    got = np.exp(lattice.log_likelihoods(["ab", "c"], p))[:, 0]
    assert np.allclose(got, [0.2 * 0.3 * 0.15 + 0.1 * 0.15 + 0.2 * 0.2, 0.2 * 0.05])
    # the recurrence over places, in logarithms
    for word in ("ab" * 40, "abcb" * 100):
        marked, ways = "▁" + word, [0.0]
        for j in range(1, len(marked) + 1):
            parts = [ways[i] + np.log(p[lattice.ids.get(marked[i:j], 5), 0]) for i in range(max(0, j - 2), j) if marked[i:j] in lattice.ids or (j == i + 1)]
            ways.append(float(np.logaddexp.reduce(parts)))
        assert np.allclose(lattice.log_likelihoods([word], p)[0, 0], ways[-1])


def test_language(spark):
    rows = [(i, ("the house and the garden " if i % 2 else "das haus und der garten ") * 5, "en" if i % 2 else "de") for i in range(20)]
    rows += [(90, None, "en"), (91, "123 456", "de"), (92, "", None), (93, "garten und haus", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs.where("doc_id < 90"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, model).collect()}
    assert all(got[i][0] == ("en" if i % 2 else "de") for i in range(20)) and got[93][0] == "de" and 0 <= got[93][1] <= 1
    assert [got[i] for i in (90, 91, 92)] == [("und", 0.0)] * 3
    nothing = langid.fit(docs.where("false"))
    assert {r.lang_pred for r in langid.identify(docs, nothing, keep=["doc_id"]).collect()} == {"und"}


@pytest.mark.parametrize("model,target", [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers(spark, model, target):
    good = target == "quality"
    rows = [(i, (prose(40) + ("" if i % 2 else " idiot | | $$$ idiots"))) for i in range(120)] + [(900, None), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2 if good else 1 - i % 2) for i in range(80)] + [(5, None), (999, 1)], f"doc_id long, {target} int")
    fitted = model.fit(docs, labels, target)
    got = {r.doc_id: r for r in model.score(docs, fitted).collect()}
    held = [(got[i].score, i % 2 if good else 1 - i % 2) for i in range(80, 120)]
    assert sum(a > b for a, x in held for b, y in held if x > y) > 0.95 * sum(x > y for _, x in held for _, y in held)
    assert 0 <= got[900].score == got[901].score <= 1 and all(0 <= r.score <= 1 for r in got.values())
    assert {r.score for r in model.score(docs, model.fit(docs, labels.where("false"), target)).collect()} == {0.5}


def test_counterfactuals_score_alike(spark):
    rows = [(i, f"{prose(10)} {'idiot' if i % 4 == 0 else ''} {'women' if i % 8 == 0 else ''}") for i in range(160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(160)], "doc_id long, toxic int")
    c = toxicity.fit(docs, labels)
    probe = spark.createDataFrame([(1, "women met here"), (2, "men met here"), (3, "an idiot")], "doc_id long, text string")
    a, b, t = (r.score for r in toxicity.score(probe, c).orderBy("doc_id").collect())
    assert abs(a - b) < 0.2 and t > max(a, b)


def brute_repeats(texts, w):
    seen, out = {}, []
    for i, t in enumerate(texts):
        words = (t or "").encode().split()
        gone = [False] * len(words)
        for k in range(len(words) - w + 1):
            first = seen.setdefault(tuple(words[k : k + w]), i)
            if first < i:
                gone[k : k + w] = [True] * w
        kept = b" ".join(x for x, g in zip(words, gone, strict=True) if not g)
        out.append((len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("size", [2, 2048])
def test_substrings(spark, texts, size, monkeypatch):
    monkeypatch.setattr("inkwell.llm.substring.SHARD", size)
    mixed = [*texts, *(f"{prose(9)} {texts[3]} {prose(9)}" for _ in range(6)), "a " * 300, "a " * 200]
    found, tables = remove_repeats(table(spark, mixed))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in found.collect()}
    assert [got[i] for i in range(len(mixed))] == brute_repeats(mixed, 50)
    tables.drop()
    assert remove_repeats(table(spark, []))[0].count() == 0


def test_automaton_statistics():
    a = SuffixAutomaton()
    for s in ("abcbc", "bcbd"):
        a.add(list(s))
    text = "xabcbdbcbcz"
    want = [max(k for k in range(i + 2) if any(text[i + 1 - k : i + 1] in s for s in ("abcbc", "bcbd"))) for i in range(len(text))]
    assert list(a.statistics(list(text))) == want


def test_secrets(spark):
    key = "9c8b45435718dcc700c184a7e303cdc64c6a8f7f"
    texts = [f'the token = "{key[i:] + key[:i]}" of it' for i in range(20)] + [f"number {4000000000000000 + i * 7} here" for i in range(20)] + [None, "", "short 123", f"example token = {key}"]
    found = {(r.doc_id, r.is_secret) for r in secrets.scan(table(spark, texts)).collect()}
    assert found == {(i, True) for i in range(20)} | {(i, False) for i in range(20, 40)} | {(43, False)}
    assert secrets.scan(table(spark, [None, ""])).count() == 0


def test_mixing(spark):
    docs = spark.createDataFrame([(i, prose(5 + i % 40) if i % 9 else None, [None, "a", "b", "é"][i % 4] if i % 3 else "b") for i in range(400)], "doc_id long, text string, source string")
    docs = docs.unionByName(docs.where("doc_id < 9")).unionByName(spark.createDataFrame([(999, "tiny", "z")], docs.schema)).cache()
    got = mix(docs).join(docs.distinct(), "doc_id").toPandas()
    again = mix(docs.repartition(7)).join(docs.distinct(), "doc_id").toPandas()
    key = ["doc_id", "taken"]
    assert got[key].sort_values(key).values.tolist() == again[key].sort_values(key).values.tolist()
    assert (got.taken <= 3 * got["size"]).all() and (got["size"] == got.text.map(lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")))).all()
    sums = got.groupby("source", dropna=False).agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"), whole=("source_size", "first"))
    assert (sums["size"] == sums.whole).all() and ((sums.taken - sums.target).abs() <= 1 + sums.whole / 100).all()
    total, order = sums.whole.sum(), sorted(sums.index, key=lambda s: (not isinstance(s, str), s if isinstance(s, str) else ""))
    weight, target, open_ = {s: i % 3 + 1 for i, s in enumerate(order)}, {}, list(order)
    size = {s: w for s, w in zip(sums.index, sums.whole, strict=True)}
    while open_:
        level = (total - sum(target.values())) / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * level > 3 * size[s]]
        for s in over or open_:
            target[s] = 3 * size[s] if over else weight[s] * level
        open_ = [s for s in open_ if s not in target]
    assert all(abs(t - target[s]) < 1e-6 for s, t in zip(sums.index, sums.target, strict=True))
    # highest quotients: a source's count is the number of its quotients that reach the divisor
    sizes = spark.createDataFrame([("a", "a", 500), ("b", "b", 300), ("c", "c", 41)], "key string, source string, source_size long")
    for r in block_quotas(source_targets(sizes), "s", 4).collect():
        want = [sum(r.target / (k - 0.5) >= r.block * 4 / j for k in range(1, 3 * r.source_size + 1)) for j in range(1, 5)]
        assert r.quotas == [b - a for a, b in zip([0, *want[:3]], want, strict=True)] and sum(r.quotas) == r.quota <= 3 * r.blocks
    assert resample(docs).columns == docs.columns and mix(docs.where("false")).count() == 0


def test_top_k_with_ties(spark):
    vectors = [[float(x) for x in v] for v in RNG.normal(0, 1, (300, 24))]
    vectors[10] = vectors[11] = vectors[12]
    rows = list(enumerate(vectors)) + [(400, None), (401, [float("nan")] * 24), (402, [None] + [1.0] * 23), (403, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = top_k(df.where("vec_id % 50 = 0"), df, k=5).orderBy("query_id", "rank").collect()
    grid = np.floor(256 * np.array(vectors))
    want = []
    for i in range(0, 300, 50):
        s = grid @ grid[i]
        best = sorted((j for j in range(300) if j != i), key=lambda j: (-s[j], j))[:5]
        want += [(i, k + 1, j, int(s[j])) for k, j in enumerate(best)]
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == want
    assert top_k(df.where("false"), df).count() == 0


def test_shards_are_even_and_keep_copies_together(spark):
    texts = [prose(5) for _ in range(90)] + ["same"] * 60 + ["pair", "pair"] + [None] * 5 + [""]
    got = shard(table(spark, texts), shards=8).toPandas()
    sizes = got.groupby("shard").slot.agg(["size", "max", "nunique"])
    assert len(got) == len(texts) and sizes["size"].max() - sizes["size"].min() <= 1 and (sizes["max"] + 1 == sizes["size"]).all() and (sizes["nunique"] == sizes["size"]).all()
    where = got.set_index("doc_id").shard
    assert where[150] == where[151] and where[list(range(90, 150))].nunique() <= 4
    assert shard(table(spark, [])).count() == 0


def test_benchmark(spark):
    item = " ".join(WORDS[:14])
    texts = [f"x {item.upper()} y", f"{' '.join(WORDS[3:13])}, z", "tiny words", "tiny, WORDS?", None, "", item, prose(50), "É tiny words é"]
    items = spark.createDataFrame([(10, item), (9, item), (3, "Tiny words"), (4, None), (5, "--")], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, list(r.item_ids)) for r in contamination(table(spark, texts), items).collect()}
    assert got[0] == (16, 14, ["10", "9"]) and got[1] == (11, 10, ["10", "9"]) and got[2] == got[3] == (2, 2, ["3"]) and got[4] == got[5] == (0, 0, []) and got[8] == (4, 2, ["3"])
    kept = {r.doc_id: r.text for r in decontaminate(table(spark, texts), items, 0.6).collect()}
    assert set(kept) == {4, 5, 7, 8} and kept[8] == "É é" and kept[7] == texts[7]
    assert contamination(table(spark, texts), items.where("false")).agg(F.sum("n_hit")).first()[0] == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    good = ["the house and the garden of the old town " + prose(30) for _ in range(40)]
    rows = [(i, t, "en" if i % 2 else "fr", f"s{i % 3}", len(t)) for i, t in enumerate(good)] + [(90, good[0], "en", "s0", 1), (91, "123", "en", "s1", 3), (92, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, good[5])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    seen = []
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen.append({r.doc_id for r in docs.collect()})
    assert seen[0] == set(range(40)) | {90} and seen[1] == set(range(40)) and seen[2] == set(range(40)) - {5}
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert out.groupby("shard").size().max() - min(out.groupby("shard").size().reindex(range(16), fill_value=0)) <= 1 and 5 not in set(out.doc_id)
