"""Cases that the operators once did in part only."""

import hashlib

import numpy as np
import pytest
from test_llm import WORDS, brute_repeats, roots, table

from inkwell.llm import secrets
from inkwell.llm.decontaminate import decontaminate
from inkwell.llm.hashing import jaccard
from inkwell.llm.prefixes import MAP_BITS, bit_map, brief, parity, unlike
from inkwell.llm.simhash import drop_copies, near_copies
from inkwell.llm.substring import remove_repeats


def family(rng, members, edits, length=300):
    base = rng.choice(WORDS, length)
    out = []
    for _ in range(members):
        words = base.copy()
        words[rng.choice(length, edits, replace=False)] = rng.choice(WORDS, edits)
        out.append(" ".join(words))
    return out


def test_near_copies_of_families_are_those_of_brute_force(spark):
    rng = np.random.default_rng(11)
    texts = [t for edits in (3, 4) for _ in range(12) for t in family(rng, 8, edits)]
    got = {r.doc_id: r.component_id for r in near_copies(table(spark, texts)).collect()}
    pairs = [(i, j) for i in range(len(texts)) for j in range(i - i % 8, i) if jaccard(texts[i], texts[j], 5) >= 0.8]
    assert [got[i] for i in range(len(texts))] == roots(pairs, len(texts))


def test_substrings_in_a_block_that_its_document_repeats(spark):
    rng = np.random.default_rng(14)
    draw = lambda n: " ".join(rng.choice(WORDS, n))
    passage, block = draw(60), f"{draw(80)} %s {draw(80)}"
    block = block % passage
    texts = [f"{draw(70)} {passage} {draw(70)}", f"{block} {draw(30)} {block}", f"{draw(5)} {block}", draw(90)]
    found, tables = remove_repeats(table(spark, texts))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in found.collect()}
    tables.drop()
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts, 50) and got[1][1] == 120


def test_secrets_of_every_run(spark):
    aws, ghp = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYzzzzzzzzKEY", "ghp_16C7e42F292c6912E7710c838347Ae178B4a"
    hexes = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(6)]
    texts = [f"AWS_SECRET_ACCESS_KEY={aws}", f"x GITHUB_ACCESS_TOKEN={ghp} y", '{"token":"%s","id":"%s"}' % tuple(hexes[:2]), "&".join(f"https://a.b/?k={h}" for h in hexes), f'the token = "{hexes[0]}" of it']
    rows = secrets.candidates(table(spark, texts)).collect()
    got = [sorted((r.at, r.nth, r.candidate) for r in rows if r.doc_id == i) for i in range(len(texts))]
    names = {"AWS_SECRET_ACCESS_KEY", "GITHUB_ACCESS_TOKEN"}
    assert [[c for _, _, c in g if c not in names] for g in got] == [[aws], [ghp], hexes[:2], hexes, hexes[:1]]
    by = {(r.doc_id, r.candidate): r for r in rows}
    assert by[0, aws].credential_before == by[0, aws].assigned == 1 and by[1, ghp].kind == "vendor_token" and by[2, hexes[1]].quoted == by[2, hexes[1]].assigned == 1


@pytest.mark.parametrize("cell", [2, 1024])
def test_near_copies_do_not_hang_on_fingerprints(spark, monkeypatch, cell):
    """Pairs at 0.8 to 0.84 are found even if the fingerprints find none, in lists of any length."""
    monkeypatch.setattr("inkwell.llm.prefixes.CELL", cell)
    monkeypatch.setattr("inkwell.llm.simhash.WIDE_BITS", 3)
    monkeypatch.setattr("inkwell.llm.simhash.WIDE_ACCEPT", 3)
    rng = np.random.default_rng(12)
    texts = [t for _ in range(30) for t in family(rng, 2, 3)] + [t for _ in range(3) for t in family(rng, 9, 3)]
    texts += ["a b c d e f", "a b c d e g", "a b c", "a b c d e"]
    got = {r.doc_id: r.component_id for r in near_copies(table(spark, texts)).collect()}
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(texts[i], texts[j], 5) >= 0.8]
    assert [got[i] for i in range(len(texts))] == roots(pairs, len(texts)) and len(pairs) > 30


def test_near_copies_with_null_ids(spark):
    rng = np.random.default_rng(13)
    a, b = family(rng, 2, 1)
    docs = spark.createDataFrame([(None, a), (3, a), (4, a), (2, b), (None, b)], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in near_copies(docs).collect()} == {(None, 2), (2, 2), (3, 2), (4, 2)}
    assert sorted(str(r.doc_id) for r in drop_copies(docs).collect()) == ["2", "None", "None"]


def test_benchmark_with_null_ids(spark):
    item = " ".join(WORDS[:12])
    docs = spark.createDataFrame([(None, f"one two {item} three " * 1 + "x " * 30)], "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [r.text for r in decontaminate(docs, items).collect()] == ["one two three " + "x " * 30]


def test_benchmark_cuts_spans_only(spark):
    item = " ".join(WORDS[:10])
    rest = "I don't,  at 3.14%:\n\n- « é »\t(so" + " filler." * 20
    texts = [f"{rest}\n\n{item.upper()}.\n\nEnd -- of \"it\".\n", f"{item}, then", f"{rest}: ({item})", rest]
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = {r.doc_id: r.text for r in decontaminate(table(spark, texts), items, 0.95).collect()}
    assert kept == {0: f"{rest}.\n\nEnd -- of \"it\".\n", 1: ", then", 2: f"{rest}: ()", 3: rest}


def test_parity_never_exceeds_the_difference():
    rng = np.random.default_rng(15)
    for n, m, both in ((300, 320, 270), (40, 700, 30), (1, 1, 0), (5000, 4000, 3900)):
        h = np.unique(rng.integers(-(2**63), 2**63 - 1, n + m))
        a, b = h[:n], h[n - both : n - both + m]
        assert unlike(parity(a), parity(b)) <= len(np.setxor1d(a, b)) and unlike(parity(a), parity(a)) == 0


def test_brief_parity_is_no_more_than_the_whole():
    rng = np.random.default_rng(9)
    for size in (0, 1, 100, 5000):
        a, b = (np.unique(rng.integers(-(1 << 63), 1 << 63, size, dtype=np.int64)) for _ in range(2))
        short = np.bitwise_count((brief(parity(a)) ^ brief(parity(b))).view(np.uint64)).sum()
        assert short <= unlike(parity(a), parity(b)) and not (brief(parity(a)) ^ brief(parity(a))).any()


def test_bit_map_holds_every_key(spark):
    keys = [0, 7, 8, MAP_BITS - 1, MAP_BITS, -1, -(1 << 63), (1 << 63) - 1, 123456789012345]
    bits = bit_map(spark.createDataFrame([(k,) for k in keys], "key long"))
    slots = {k % MAP_BITS for k in keys}
    assert int(np.bitwise_count(bits).sum()) == len(slots) and all(bits[s >> 3] >> (s & 7) & 1 for s in slots)


def test_pairs_of_a_long_shared_run_come_once_and_none_that_parities_part(spark, monkeypatch):
    """Every shared shingle of a prefix gave its pairs again, and sets of more than some 600 shingles passed the folded parity unlooked at."""
    from inkwell.llm import prefixes

    made = []
    rng = np.random.default_rng(1)
    shared = np.sort(rng.integers(0, 1 << 60, 150))
    sets = [np.unique(np.concatenate((shared, rng.integers(1 << 60, 1 << 61, 850)))) for _ in range(12)]
    twin = [np.unique(np.concatenate((s[:960], rng.integers(1 << 61, 1 << 62, 40)))) for s in sets[:2]]
    rows = [(n, n, len(s), prefixes.prefix(s, np.empty(0, np.int64), 0.8).tolist(), bytearray(parity(s))) for n, s in enumerate([*sets, *twin])]
    table = spark.createDataFrame(rows, "node long, part long, size int, keys array<bigint>, parity binary")
    distinct = type(table).distinct

    def counted(rows):
        if rows.columns == ["a", "b"]:
            made.append(rows.count())
        return distinct(rows)

    monkeypatch.setattr(type(table), "distinct", counted)
    got = {tuple(r) for r in prefixes.crossing_pairs(table, 0.8).collect()}
    assert {(0, 12), (1, 13)} <= got and len(got) < 10
    # the twins alone share 150 shingles and more of their prefixes
    assert len(made) == 1 and made[0] < 20
