"""Operators 6, 7 and 8 against brute force, and their edge cases."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from ledgerkit.llm import exact_dedup, near_dup, substring_dedup
from ledgerkit.llm.components import connected
from tests.llm import helpers as H

# ---- operator 6


def shingle_set(text, n):
    words = (text or "").encode().lower().split()
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def components_brute(rows, n, percent):
    """doc_id -> (set size, component) for unique ids."""
    sets = {d: shingle_set(t, n) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.mark.parametrize("seed,n,percent,block", [(0, 3, 90, 4096), (1, 5, 80, 4), (2, 2, 60, 5)])
def test_near_dup_matches_brute_force(spark, monkeypatch, seed, n, percent, block):
    monkeypatch.setattr(near_dup, "BLOCK", block)  # hot shingles are cut into blocks
    rows = list(enumerate(H.corpus(seed, vocabulary=60 if seed else 400)))
    random.Random(seed).shuffle(rows)
    got = near_dup.components(H.documents(spark, [(d, t, None) for d, t in rows]), n, percent).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == components_brute(rows, n, percent)


def test_near_dup_one_large_group_with_few_rows_made(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for d in range(200):
        words = list(base)
        for _ in range(rng.randrange(6)):
            words[rng.randrange(120)] = f"x{rng.randrange(10_000)}"
        rows.append((d, " ".join(words)))
    got = near_dup.components(H.documents(spark, [(d, t, None) for d, t in rows]), 3, 90).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == components_brute(rows, 3, 90)


def test_near_dup_rare_shingles_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(base[:k] + [f"x{k}"] + base[k + 1 :]) for k in range(120)]
    docs = near_dup.pick(H.documents(spark, [(d, t, None) for d, t in enumerate(texts)]), "doc_id", "text")
    none = np.zeros(0, dtype=np.uint64)
    members = near_dup.materialize(near_dup.prefixes(docs, none, 3, 80), "test-members")
    rows = near_dup.buckets(near_dup.shared_tokens(members, none, 80), members)
    sizes = [r["count"] for r in rows.groupBy("token", "bi", "bj").count().collect()]
    assert max(sizes) <= 6 * 8  # two blocks of about eight members; one bucket of 100 or more if not cut


def test_common_shingles_cuts_a_class_by_exact_counts(spark):
    texts = [" ".join(f"a{d}x{i}" for i in range(12)) for d in range(3)]
    rows = [(d * 10 + k, t + f" end{k}", None) for d, t in enumerate(texts) for k in range(4 if d else 5)]
    docs = near_dup.pick(H.documents(spark, rows).coalesce(1), "doc_id", "text")
    common = near_dup.common_shingles(docs, 1, 15)
    tokens = {d: set(near_dup.shingles(t, 1).tolist()) for d, t in enumerate(texts)}
    assert len(common) == 15 and set(common[-12:].tolist()) == tokens[0]
    assert set(common[:3].tolist()) == set(sorted(tokens[1] | tokens[2], key=lambda h: h - (h >> 63 << 64))[:3])
    assert len(near_dup.common_shingles(docs, 1, 5)) == 5  # the top class alone does not fit


def test_near_dup_bitmaps_never_lose_a_link():
    rng = np.random.default_rng(2)
    for _ in range(300):
        common = rng.integers(0, 2**63, rng.integers(1, 1500)).astype(np.uint64)
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 2**63, rng.integers(0, 300)).astype(np.uint64)])) for _ in range(2))
        i = len(np.intersect1d(a, b))
        rows = [(0, 0, 0, len(x), bytes([k]), near_dup.bitmap(x)) for k, x in enumerate((a, b))]
        passes = near_dup.pair_passes(*rows, 80)
        table = near_dup.Bucket([r[3] for r in rows], [r[4] for r in rows], [r[5] for r in rows], 80)
        assert passes == bool(len(table.passing(0, np.array([1]))))
        if 100 * i >= 80 * (len(a) + len(b) - i):
            assert passes


def test_near_dup_pairs_across_components_are_all_reported():
    tokens = np.arange(1, 400, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    sets = [np.unique(np.delete(tokens, k)) for k in range(4)]
    rows = [(7, 0, 0, len(s), bytes([k]), near_dup.bitmap(s), bytes([k // 2])) for k, s in enumerate(sets)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=list("abcdefg"))
    out = [r for b in near_dup._across(80)(iter([batch])) for r in zip(b.column(3).to_pylist(), b.column(4).to_pylist())]
    assert sorted(out) == [(bytes([a]), bytes([b])) for a in (0, 1) for b in (2, 3)]


def test_near_dup_edges(spark):
    rows = near_dup.components(H.messy(spark), 3, 90).collect()
    assert len(rows) == 11
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], set()).add((r["n_shingles"], r["component_id"]))
    assert by[2] == {(0, 2)} and by[3] == {(0, 3)} and by[4] == {(0, 4)} and by[6] == by[5]
    assert by[None] == {(2, 1), (0, None)}  # a copy of document 1, and a text without words
    assert near_dup.components(H.empty(spark)).count() == 0
    kept = near_dup.one_per_component(H.messy(spark))
    assert kept.columns == H.messy(spark).columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [1, 1, 1, 2, 3, 4, 5, 7]


@pytest.mark.parametrize("seed", [0, 1])
def test_connected_components(spark, seed):
    rng = random.Random(seed)
    links = [(i, i + 1) for i in range(40)] if seed else [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    rows = connected(spark.createDataFrame(links, "a long, b long")).collect()
    root = {x: x for link in links for x in link if link[0] != link[1]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    assert sorted((r["node"], r["root"]) for r in rows) == sorted((x, find(x)) for x in root)


# ---- operator 7


def substring_brute(rows, span):
    """Sorted (id, n_words, n_removed, sha) for rows of (doc_id, text); None is above all."""
    rank = lambda d: float("inf") if d is None else d
    words = [(t or "").encode().split() for _d, t in rows]
    low = {}
    for (d, _t), w in zip(rows, words):
        for i in range(len(w) - span + 1):
            key = tuple(w[i : i + span])
            low[key] = min(low.get(key, float("inf")), rank(d))
    out = []
    for (d, _t), w in zip(rows, words):
        gone = {j for i in range(len(w) - span + 1) if low[tuple(w[i : i + span])] < rank(d) for j in range(i, i + span)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((rank(d), len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("seed,span", [(0, 6), (1, 4), (2, 9)])
def test_substring_dedup_matches_brute_force(spark, monkeypatch, seed, span):
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 60)  # several shards
    monkeypatch.setattr(substring_dedup, "TASK_WORDS", 300)  # several copies of a shard
    texts = H.corpus(seed, n=90, vocabulary=12 if seed == 2 else 60)
    ids = random.Random(seed).sample(range(1000), len(texts))
    rows = [*zip(ids, texts), (None, texts[0]), (ids[1], texts[1]), (ids[2], texts[3])]
    docs = H.documents(spark, [(d, t, None) for d, t in rows]).repartition(5)
    got = sorted((float("inf") if r[0] is None else r[0], *r[1:]) for r in substring_dedup.dedupe(docs, span).collect())
    assert got == substring_brute(rows, span)


def test_automaton_matching_statistics():
    rng = random.Random(4)
    for _ in range(60):
        refs = [([rng.randrange(3) for _ in range(rng.randrange(1, 25))], rng.randrange(50)) for _ in range(4)]
        text, doc, span = [rng.randrange(3) for _ in range(40)], rng.randrange(50), rng.randrange(1, 6)
        automaton = substring_dedup.Automaton()
        for words, owner in refs:
            automaton.add(words, owner)
        automaton.finish()
        low = {}
        for words, owner in refs:
            for i in range(len(words) - span + 1):
                key = tuple(words[i : i + span])
                low[key] = min(low.get(key, 99), owner)
        assert automaton.matches(text, doc, span) == [i + span for i in range(len(text) - span + 1) if low.get(tuple(text[i : i + span]), 99) < doc]


def test_substring_edges(spark):
    rows = substring_dedup.dedupe(H.messy(spark)).collect()
    assert len(rows) == 11
    by = {r["doc_id"]: r for r in rows}
    assert by[6]["n_removed"] == by[6]["n_words"] == 30_001 and by[5]["n_removed"] == 0
    assert substring_dedup.dedupe(H.empty(spark)).count() == 0


# ---- operator 8


@pytest.mark.parametrize("largest", [True, False])
def test_exact_dedup_matches_brute_force(spark, largest):
    texts = H.corpus(7, n=150, vocabulary=8)
    rows = [(d, t if d % 11 else None) for d, t in enumerate(texts)] + [(1000, "")]
    got = exact_dedup.resolve(H.documents(spark, [(d, t, None) for d, t in rows]).repartition(6), largest).collect()
    groups = {}
    for d, t in rows:
        groups.setdefault(t or "", []).append(d)
    keep = max if largest else min
    expected = {d: (keep(groups[t or ""]), len(groups[t or ""]), d == keep(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in rows}
    assert {r[0]: tuple(r[1:]) for r in got} == expected


def test_patricia_trie_and_spill_by_subtree():
    rng = random.Random(1)
    for _ in range(100):
        keys = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(7))) for _ in range(40)]
        counts = {k: keys.count(k) for k in keys}
        trie = exact_dedup.Patricia(lambda a, b: a + b)
        for k in keys:
            trie.insert(k, 1)
        assert list(trie.items()) == sorted(counts.items())
        trie, out = exact_dedup.Patricia(lambda a, b: a + b), []
        width = 5  # the operator's strings have one length, so none is a prefix of another
        keys = sorted(bytes(rng.choice(b"ab") for _ in range(width)) for _ in range(40))
        for k in keys:
            out += trie.spill_before(k)
            trie.insert(k, 1)
            assert len(list(trie.items())) == 1  # one open path only
        out += trie.items()
        assert out == sorted((k, keys.count(k)) for k in set(keys))


def test_exact_dedup_resolves_hash_collisions():
    """Different texts of one length and hash are told apart by the trie."""
    rows = [(3, 9, b"abc", 1, 1), (3, 9, b"abc", 4, 2), (3, 9, b"abd", 2, 1), (3, 10, b"abc", 5, 1)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=list("abcde"))
    out = [r for b in exact_dedup._final_owners(True)(iter([batch])) for r in zip(*[c.to_pylist() for c in b.columns])]
    sha = lambda t: hashlib.sha256(t).hexdigest()
    assert out == [(sha(b"abc"), 4, 3), (sha(b"abd"), 2, 1), (sha(b"abc"), 5, 1)]


def test_exact_dedup_shares_prefixes_and_spills_by_subtree(monkeypatch):
    """Many strings of one length and bucket: one trie holds their common prefixes, and finished
    subtrees leave while strings still come."""
    rng = random.Random(5)
    heads = ["shared head %02d " % i for i in range(4)]
    texts = sorted({(rng.choice(heads) + "".join(rng.choice("ab") for _ in range(9))).encode() for _ in range(400)})
    copies = [rng.randrange(1, 4) for _ in texts]
    rows = [(24, 7, t, k * 10 + j, 1) for k, t in enumerate(texts) for j in range(copies[k])]
    spilled, splits = [], []
    real_spill, real_common = exact_dedup.Patricia.spill_before, exact_dedup._common
    monkeypatch.setattr(exact_dedup.Patricia, "spill_before", lambda self, key: [spilled.append(x) or x for x in real_spill(self, key)])
    monkeypatch.setattr(exact_dedup, "_common", lambda label, key, at: splits.append(at) or real_common(label, key, at))
    fields = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows[a : a + 50]), fields)], names=list("abcde")) for a in range(0, len(rows), 50)]
    out = [r for b in exact_dedup._final_owners(True)(iter(batches)) for r in zip(*[c.to_pylist() for c in b.columns])]
    assert sorted(out) == sorted((hashlib.sha256(t).hexdigest(), k * 10 + copies[k] - 1, copies[k]) for k, t in enumerate(texts))
    assert len(spilled) > 0.95 * len(texts) - 1  # nearly all left before the end
    assert max(splits) >= len(heads[0])  # strings met inside the tails: their heads were shared


def test_exact_dedup_edges(spark):
    rows = exact_dedup.resolve(H.messy(spark), largest=True).collect()
    assert len(rows) == 11
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], set()).add((r["keep_id"], r["group_size"], r["kept"]))
    assert by[None] == {(1, 3, False), (3, 3, False)} and by[3] == {(3, 3, True)} and by[5] == {(6, 2, False)}
    kept = exact_dedup.drop_copies(H.messy(spark), largest=True)
    assert kept.columns == H.messy(spark).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 1, 3, 4, 6, 7]
    assert exact_dedup.resolve(H.empty(spark)).count() == 0 and exact_dedup.drop_copies(H.empty(spark)).count() == 0
