"""Prefix trie, structure repair and Jaccard join against brute force, with odd rows."""

import hashlib
import random
import sys
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pytest
from test_llm import roots, table

from inkwell.llm import repair as repairs
from inkwell.llm import trie as tries
from inkwell.llm import triejoin
from inkwell.llm.components import components
from inkwell.llm.hashing import jaccard
from inkwell.llm.repair import Path, repair
from inkwell.llm.trie import prefix_trie
from inkwell.llm.triejoin import PrefixTree, Similar, jaccard_groups, ordered

sys.setrecursionlimit(20_000)  # of the brute force
SCHEMA = "conv_id long, turn long, role string, text string, conv string, part string, k1 string"


def talks(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


def md5(text):
    return hashlib.md5(text.encode()).digest()


@pytest.fixture(scope="module")
def odd():
    """Null turns, roles, texts and ids, ties, repeated rows, a conversation without its base, equal conversations, long ones."""
    rng = random.Random(5)
    texts = ["Hi.", "ok", "", " ", "Yes!", "no. ", None, *[f"t{i}." for i in range(6)]]
    rows = [
        (c, rng.choice([None, *range(12)]) if c % 2 else t, rng.choice(["user", "assistant", "system", "tool", None, "", "User"]), rng.choice(texts))
        for c in range(40) for t in range(rng.randrange(1, 14))
    ]
    rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"same {t}.") for c in (-7, 45, 46, 47, 50, 51, 57) for t in range(30)]
    rows += [(60, t, "user", "ü" * t) for t in range(80)] + [(64, 0, "user", "only"), (64, 0, "user", "only"), (None, 1, "user", "a"), (73, None, None, None)]
    return rows


# --- prefix trie -------------------------------------------------------------


def brute_trie(rows, graft):
    by = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            by[c].append(((t is not None, t or 0), r or "", md5(x or ""), x or ""))
    seqs = {c: [(a[1], a[3]) for a in sorted(v)] for c, v in by.items()}
    if graft:
        mod = lambda c: int(np.fmod(c, 5))
        takes = {c: zlib.crc32(str(c).encode()) % 9 for c in seqs}
        seqs = {c: seqs.get(c - mod(c), [])[: takes[c]] + seqs[c][takes[c] :] for c in seqs}
    members, children, leaves, saved = defaultdict(list), defaultdict(int), defaultdict(int), defaultdict(int)
    for c in sorted(seqs):
        for d in range(len(seqs[c]) + 1):
            members[tuple(seqs[c][:d])].append(c)
    for k in members:
        children[k[:-1]] += bool(k)
    for k, m in members.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
            leaves[k[:d]] += not children[k]
    return sorted((
        m[0], len(k), members[k[:-1]][0] if k else None, len(m), children[k], leaves[k], saved[k],
        hashlib.sha256(",".join(str(c) for c in m if len(seqs[c]) == len(k)).encode()).hexdigest(),
    ) for k, m in members.items()) if seqs else []


@pytest.mark.parametrize("graft", [True, False])
def test_trie_is_that_of_brute_force(spark, odd, graft, monkeypatch):
    monkeypatch.setattr(tries, "BUCKET", 7)
    monkeypatch.setattr(tries, "FANIN", 2)
    got = prefix_trie(talks(spark, odd).repartition(5), graft=graft)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute_trie(odd, graft), key=key)


def test_trie_of_one_conversation_in_several_parts(spark):
    rows = [(c, t, "user", f"{t}") for c in (3, 8) for t in range(3000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.depth: r for r in prefix_trie(talks(spark, rows)).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == 3001 and all(r.n_convs == 2 and r.n_leaves == 1 and r.n_children == (d < 3000) for d, r in got.items())
    assert got[0].saved_tokens == sum(len(str(t)) for t in range(3000)) and got[3000].ends_sha256 == hashlib.sha256(b"3,8").hexdigest()


def test_empty_conversations(spark):
    none = talks(spark, [(1, 1, "user", "a")]).where("false")
    assert prefix_trie(none, graft=True).count() == prefix_trie(none).count() == repair(none, damage=True).count() == repair(none).count() == 0


# --- structure repair --------------------------------------------------------


def brute_repair(rows, damage):
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t, " " if r is None else r, " " if x is None else x))
    return sorted((brute_one(c, v, damage) for c, v in by.items()), key=str)


def brute_one(c, rows, damage):
    rows = sorted(rows, key=lambda a: (a[0] is not None, a[0] or 0, a[1], md5(a[2])))
    kept = []
    for t, r, x in rows:
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20 if damage else 9
        x = "" if fate == 1 else "".join(s for s in x if s not in ".!?") if fate == 2 else x
        kept += [(t, "user" if fate == 4 else r, x)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    faults, seen = [], set()
    for _, r, x in kept:
        y = x.strip(" \t\n\x0b\x0c\r")
        faults.append("b" if not y else "d" if (r, x) in seen else "t" if y[-1] not in ".!?" else "")
        seen.add((r, x))

    @lru_cache(None)
    def best(i, before, inserted):
        """The cheapest (cost, audit, rows) from row i on, after a row with this initial; every edit is tried."""
        found = [(0, "", ())] if i == len(kept) and before in ("", "a") else []
        role = "assistant" if before == "u" else "user"
        after = lambda cost, edit, now, row, at, k=0: [(r[0] + cost, edit + r[1], row + r[2]) for r in [best(at, now, k)] if r]
        if inserted < 3:
            found += after(3, "I", role[0], ((role, ""),), i, inserted + 1)
        if i < len(kept):
            found += after(4, "D", before, (), i + 1)
            if faults[i] not in ("b", "d"):
                more, (_, r, x) = 3 if faults[i] == "t" else 0, kept[i]
                if r[:1] == role[0] or (r[:1] == "s" and not before):
                    found += after(more, "K", r[:1], ((r, x),), i + 1)
                found += after(more + 3, "R", role[0], ((role, x),), i + 1)
        return min(found) if found else None

    cost, audit, made = best(0, "", 0)
    turns = {t for t, _, _ in kept if t is not None}
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
    digest = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in made).encode()).hexdigest()
    return c, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in "bdt"), illegal, cost, audit, digest


@pytest.mark.parametrize("damage", [True, False])
def test_repair_is_that_of_brute_force(spark, odd, damage):
    got = sorted(map(tuple, repair(talks(spark, odd), damage=damage).collect()), key=str)
    assert got == brute_repair(odd, damage)


def test_repair_of_dropped_rows(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert tuple(repair(talks(spark, [(gone, 0, "user", "a.")]), damage=True).first()) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


@pytest.mark.parametrize("segment", [1, 2, 5, 4096])
def test_search_in_segments_gives_the_same_path(monkeypatch, segment):
    monkeypatch.setattr(repairs, "SEGMENT", segment)
    rng = random.Random(9)
    for _ in range(150):
        rows = [(0, rng.choice(["user", "assistant", "system", "x"]), rng.choice(["", f"{k}", f"{k}.", f"{k}.", "again."])) for k in range(rng.randrange(0, 30))]
        want, path, seen = brute_one(0, [], False), Path(), set()
        ordered_rows = sorted(rows, key=lambda a: (a[1], md5(a[2])))
        for _, r, x in ordered_rows:
            path.add(r[:1], "b" if not x else "d" if (r, x) in seen else "" if x[-1] == "." else "t")
            seen.add((r, x))
        want = brute_one(0, rows, False)
        assert path.best() == (want[6], want[7])


# --- Jaccard join ------------------------------------------------------------


def family(rng, members, edits, length=300):
    base = rng.choice([f"w{i}" for i in range(400)], length)
    out = []
    for _ in range(members):
        words = base.copy()
        words[rng.choice(length, edits, replace=False)] = rng.choice([f"v{i}" for i in range(400)], edits)
        out.append(" ".join(words))
    return out


def test_join_of_families_is_that_of_brute_force(spark, monkeypatch):
    monkeypatch.setattr(triejoin, "CELL", 3)
    monkeypatch.setattr(triejoin, "TREE", 600)
    rng = np.random.default_rng(4)
    texts = [t for edits in (2, 4, 5) for _ in range(10) for t in family(rng, 8, edits)] + ["A b c d", "a  B c d", "a b", "A b\n", None, "", " \t", "a b c"]
    sets = [ordered(t, 3, 42, np.empty(0, np.int64)) for t in texts]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i]) and len(sets[j]) and Similar(90).holds(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]))]
    assert all(jaccard(texts[i], texts[j], 3) >= 0.9 for i, j in near) and len(near) > 200
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_groups(table(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == [(len(s), r) for s, r in zip(sets, roots(near, len(texts)), strict=True)]


def test_second_search_alone_loses_no_link(spark):
    """Every set a part of its own: all links must come from the n-grams of prefixes."""
    rng = np.random.default_rng(6)
    texts = [t for edits in (1, 2, 3) for _ in range(8) for t in family(rng, 6, edits)]
    sets = [ordered(t, 3, 42, np.empty(0, np.int64)) for t in texts]
    like = Similar(90)
    rows = [(i, i, len(s), s[: like.prefix(len(s))].tolist(), bytearray(triejoin.parities(s))) for i, s in enumerate(sets)]
    got = {(r.a, r.b) for r in triejoin._crossing(spark.createDataFrame(rows, "node long, part long, size long, keys array<long>, odd binary"), like).collect()}
    near = {(j, i) for i in range(len(texts)) for j in range(i) if like.holds(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]))}
    assert near and near <= got and len(got) < len(texts) ** 2 / 8
    assert components(spark.createDataFrame(sorted(near), "a long, b long")).count() > 0


def test_tree_shares_and_prunes():
    rng = np.random.default_rng(2)
    base = np.unique(rng.integers(0, 1 << 40, 400))
    sets = [np.unique(np.concatenate((np.delete(base, rng.choice(400, k, replace=False)), rng.integers(0, 1 << 40, k)))) for k in (0, 3, 10, 18, 22, 40, 90) for _ in range(4)]
    sets += [np.unique(rng.integers(0, 1 << 40, n)) for n in (1, 2, 400, 400)] + [base[:200], base[:370]]
    like, sizes = Similar(90), [len(s) for s in sets]
    tree, nodes = PrefixTree(sets, sizes), 0
    for k, x in enumerate(sets):
        want = [m for m, y in enumerate(sets) if like.holds(len(np.intersect1d(x, y)), len(x), len(y))]
        assert sorted(tree.probe(x, len(x), like)) == want and k in want
        some = [np.flatnonzero(rng.random(like.prefix(n)) < 0.7) for n in sizes]  # a part of each prefix, as of those that others share
        heads, mine = PrefixTree([y[p] for y, p in zip(sets, some, strict=True)], sizes, some), some[k]
        shared = {m for m in want if len(np.intersect1d(x[mine], sets[m][some[m]])) == len(np.intersect1d(x[: like.prefix(len(x))], sets[m][: like.prefix(sizes[m])]))}
        assert shared <= set(heads.probe(x[mine], len(x), like, mine) if len(mine) else shared)
    todo = list(tree.root)
    while todo:
        *_, children, _ = node = todo.pop()
        nodes += len(node[0])
        todo += children
    assert nodes < sum(sizes) * 0.95


def test_join_of_odd_rows(spark):
    rows = [(None, "null id here " * 4), (1, None), (2, ""), (3, " \n\t"), (4, "tie a b c"), (5, "Tie  a b c"), (6, "rep x"), (6, "rep x"), (7, "w" * 200_000), (8, "many words " * 30_000), (None, "tie a b c"), (9, "null id here null id here")]
    docs = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in rows], "doc_id long, text string, node string, keys string, part string")
    got = sorted(map(tuple, jaccard_groups(docs).collect()), key=str)
    assert got == sorted([(None, 3, 9), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 2, 4), (5, 2, 4), (6, 1, 6), (6, 1, 6), (7, 1, 7), (8, 2, 8), (None, 2, 4), (9, 3, 9)], key=str)
    assert jaccard_groups(docs.where("false")).count() == 0


def test_common_shingles_are_those_where_prefixes_begin(spark):
    from inkwell.llm.hashing import shingle_set
    from inkwell.llm.prefixes import COMMON, COUNTED, common_shingles, prefix

    rng = np.random.default_rng(5)
    passage = " ".join(rng.choice([f"w{i}" for i in range(400)], 80))
    texts = [f"{passage} {' '.join(rng.choice([f'v{i}' for i in range(400)], 40))}" for _ in range(COMMON)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row long, text string")
    shared = shingle_set(passage, 5, 42)
    got = common_shingles(rows, 5, 42)
    assert sorted(got.tolist()) == sorted(shared[shared.view(np.uint64) < COUNTED].tolist()) and 20 < len(got) < 45
    # so a prefix begins with what is rare
    head = prefix(shingle_set(texts[0], 5, 42), got, 0.8)
    assert not np.isin(head, got).any() and not np.isin(head[:10], shared).any()
