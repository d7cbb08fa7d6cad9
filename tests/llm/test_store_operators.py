"""Operators 11, 12 and 13 against brute force, exact round trips and file metadata."""

import base64
import glob
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.orc as orc
import pytest
import sentencepiece
from tokenizers import Tokenizer

from ledgerkit.llm import merkle, token_align, token_store
from ledgerkit.llm.common import pick
from tests.conftest import SF_SMALL
from tests.llm import helpers as H

def table_of(spark, rows):
    """``rows`` of (doc_id, text, lang, source, n_chars) with extra columns whose names clash."""
    return spark.createDataFrame([(*r, "other", "x", 7, None, "no") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, TEXT string, size string, key string, h double, pos string")


# ---- operator 11


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def merkle_brute(rows):
    """doc -> (leaf, subroot, root, proof, folded, verified), one list entry per row."""
    def leaf(doc_id, text, lang, source, n):
        fields = (doc_id, source, lang, n, text)
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
        return out

    def climb(tree, at):
        for level in tree[:-1]:
            yield at % 2, level[at ^ 1] if at ^ 1 < len(level) else None
            at //= 2

    by_lang = defaultdict(list)
    for r in rows:
        by_lang[r[2]].append((r[0] is not None, r[0] or 0, leaf(*r), r))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: levels([m[2] for m in sorted(by_lang[x], key=lambda m: m[:3])]) for x in langs}
    top = levels([trees[x][-1][0] for x in langs]) if langs else [[]]
    out = []
    for k, x in enumerate(langs):
        for i, (_has, _id, h, r) in enumerate(sorted(by_lang[x], key=lambda m: m[:3])):
            now = h
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None:
                now = leaf(*r[:4], r[4] + 1)
            proof = ""
            for right, other in [*climb(trees[x], i), *climb(top, k)]:
                proof += other or ""
                now = sha(now if other is None else other + now if right else now + other)
            out.append((r[0], h, trees[x][-1][0], top[-1][0], sha(proof), now, now == top[-1][0]))
    return out


def merkle_rows(spark, rows, step):
    found = merkle.proofs(merkle.build(table_of(spark, rows), step=step))
    return [tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in found.collect()]


def order(rows):
    return sorted(rows, key=repr)


MESSY = [
    (1, "alpha", "en", "s", 5), (1, "alpha", "en", "s", 5), (1, "beta", "en", None, 4), (2, None, "en", "s", None),
    (None, "x", None, None, 1), (None, None, None, None, None), (3, "", "de", "", 0), (4, "é漢😀\n\t", "é", "s", 5),
    (5, "y" * 300_000, "", "s", 2**63 - 1), (14, "t", "en", "s", 9), (-7, "neg", "de", "-", 3),
]


@pytest.mark.parametrize("step", [1, 3])
def test_merkle_matches_brute_force(spark, step):
    rng = random.Random(step)
    rows = MESSY + [(i, f"text {i}", rng.choice(["en", "en", "en", "fr", None]), "s", i) for i in range(100, 190)]
    rng.shuffle(rows)
    got = merkle_rows(spark, rows, step)
    assert order(got) == order(merkle_brute(rows))
    assert {v for *_x, v in got} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 3])
def test_merkle_of_few_rows(spark, n):
    rows = MESSY[:n]
    assert order(merkle_rows(spark, rows, 6)) == order(merkle_brute(rows))


def test_merkle_empty_table(spark):
    built = merkle.build(H.empty(spark))
    assert built.root() is None and merkle.proofs(built).count() == 0


def test_merkle_persists_only_every_few_levels(spark):
    rows = [(i, "t", "en", "s", i) for i in range(300)]
    built = merkle.build(table_of(spark, rows), step=4)
    # 300 leaves, 19 nodes four levels up, 2 nodes eight levels up, the top
    assert [x.count() for x in built.trees.levels] == [300, 19, 2, 1]
    other = [list(r) for r in rows]
    other[77][4] += 1
    assert merkle.build(table_of(spark, other)).root() != built.root() == merkle.build(table_of(spark, rows), step=6).root()


def test_merkle_paths_fold_to_the_root(spark):
    tree = merkle.subtree([sha(str(i)) for i in range(11)], 4)
    for i in range(11):
        assert merkle.fold(tree[0][i], merkle.path_in(tree, i)) == tree[-1][0]


# ---- operator 12


@pytest.fixture(scope="module")
def vocabularies():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        sizes = {int(n): len(base64.b64decode(t)) for t, n in map(bytes.split, lines)}
    return a, b, sizes


def links_brute(vocabularies, text):
    """A ids, B ids, links (token numbers) and groups by the byte ranges of all tokens."""
    a, b, sizes = vocabularies
    if not text:
        return [], [], [], ""
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    joined = b"".join(bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b)
    if joined != (" " + text).encode():
        return [], [], [], ""

    def spans(lengths):
        out, at = [], 0
        for n in lengths:
            out.append((at, at + n))
            at += n
        return out

    span_a = spans([sizes[i] for i in ids_a])
    span_b = spans([1 if b.is_byte(i) else len(b.id_to_piece(i).replace("▁", " ").encode()) for i in ids_b])
    links = [(x, y) for x, (s, e) in enumerate(span_a) for y, (t, f) in enumerate(span_b) if s < f and t < e]
    cuts = sorted({e for _s, e in span_a} & {e for _s, e in span_b})
    groups, low = [], 0
    for cut in cuts:
        part = [",".join(str(i) for i, (s, e) in zip(ids, span) if low <= s and e <= cut) for ids, span in ((ids_a, span_a), (ids_b, span_b))]
        groups.append("|".join(part))
        low = cut
    return ids_a, ids_b, links, ";".join(groups)


def align_brute(vocabularies, rows):
    docs = [(i, *links_brute(vocabularies, t)) for i, t in rows]
    held = Counter()
    for _i, a, b, links, _g in docs:
        held.update({(a[x], b[y]) for x, y in links})
    best = defaultdict(int)
    for (x, _y), n in held.items():
        best[x] = max(best[x], n)
    out = []
    for i, a, b, links, groups in docs:
        n = [held[a[x], b[y]] for x, y in links]
        top = [held[a[x], b[y]] == best[a[x]] for x, y in links]
        out.append((i, len(a), len(b), groups.count(";") + 1 if groups else 0, len(links), sum(top), sum(n), sha(groups) if groups else ""))
    return out


TEXTS = [
    "alpha beta gamma", "alpha beta", "Zürich – naïve café 漢字 😀👩‍👩‍👧", "<|endoftext|> plain <s> </s> <unk> <0x41>", " leading and  double   spaces ",
    "tabs\tand\nnewlines\r\n\n", "x", "ééé", "▁ piece marks ▁▁", "á combining", "1234567890 3.14159", None, "", " ", " 　", "word " * 200, "﻿ bom",
]


def test_alignment_matches_brute_force(spark, vocabularies):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "alpha beta"), (1, "alpha beta"), (None, None)]
    docs = H.documents(spark, [(i, t, "s") for i, t in rows])
    columns = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    expected = order(align_brute(vocabularies, rows))
    for options in ({}, {"lane": 3}, {"lane": 1, "broadcast_pairs": 0}):
        got = [tuple(r[c] for c in columns) for r in token_align.scored(docs, **options).collect()]
        assert order(got) == expected


def test_alignment_of_documents(spark, vocabularies):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").where("length(text) < 3000")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = [tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in token_align.scored(docs).collect()]
    assert order(got) == order(align_brute(vocabularies, rows))


def test_alignment_of_empty_tables_and_long_texts(spark):
    assert token_align.scored(H.empty(spark)).count() == 0
    long = "".join(random.Random(1).choice(["word ", "été ", "\n", "漢", "zz"]) for _ in range(60_000))
    r = token_align.scored(H.documents(spark, [(1, long, "s"), (2, " " * 300_000, "s")])).where("doc_id = 1").first()
    both = token_align.Tokenizers()
    a, b = both.encode(long)
    assert (r["n_a"], r["n_b"]) == (len(a), len(b))
    assert r["n_links"] == len(a) + len(b) - r["n_groups"]  # each group of i and j tokens has i + j - 1 links


def test_lanes_begin_where_both_vocabularies_do():
    a, b = np.arange(1, 100_001), np.arange(2, 100_001, 2)
    starts = token_align.lanes(a, b, np.array([0]), np.array([0]), 100)
    assert len(starts[0]) == 1000 and (a[starts[0][1:] - 1] == b[starts[1][1:] - 1]).all()
    links_a, links_b, cut = token_align.lockstep(a, b, *starts)
    assert (links_a == np.arange(100_000)).all() and (links_b == links_a // 2).all() and (cut == (links_a % 2 == 1)).all()


# ---- operator 13


def files_of(store):
    return sorted(glob.glob(store.path.removeprefix("file:") + "/data/*.orc"))


def store_brute(rows):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out, at = [], 0
    for doc_id, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, at, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)), ids))
        at += len(ids)
    return out


def test_store_round_trip_of_documents(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    store = token_store.write(docs.repartition(5), parts=3)
    expected = store_brute(rows)
    got = token_store.digest(spark, store).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == [r[:4] for r in expected]
    read = token_store.read(spark, store).collect()
    assert sorted((r["doc_id"], r["start"], list(r["ids"])) for r in read) == [(r[0], r[1], r[4]) for r in expected]
    # files in name order hold the documents in id order
    ids = [i for f in files_of(store) for i in orc.read_table(f, columns=["doc_id"]).column(0).to_pylist()]
    assert ids == [r[0] for r in rows]


def test_store_of_messy_rows(spark):
    docs = H.messy(spark)
    got = token_store.digest(spark, token_store.write(docs, parts=4)).collect()
    texts = [(r["doc_id"], r["text"]) for r in pick(docs, "doc_id", "text").collect()]
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((r[0], r[2], r[3]) for r in store_brute(texts))
    starts = sorted((r["start"], r["n_tokens"], (r["doc_id"] is not None, r["doc_id"] or 0)) for r in got)
    assert all(a[0] + a[1] == b[0] and a[2] <= b[2] for a, b in zip(starts, starts[1:])) and starts[0][0] == 0
    assert token_store.digest(spark, token_store.write(H.empty(spark))).count() == 0


def scanned_rows(df):
    """Rows that the ORC scan of ``df`` gave to the plan, after running it."""
    def walk(plan):
        name = plan.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            yield from walk(plan.executedPlan())
        elif name.endswith("QueryStage"):
            yield from walk(plan.plan())
        elif "Scan orc" in name and "doc_id" in plan.output().toString():
            yield plan.metrics().apply("numOutputRows").value()
        else:
            for i in range(plan.children().length()):
                yield from walk(plan.children().apply(i))

    df.collect()
    return sum(walk(df._jdf.queryExecution().executedPlan()))


def test_store_prunes_by_row_index_and_bloom_filter(spark):
    docs = H.documents(spark, [(2 * i, f"text {i}", "s") for i in range(12_000)])
    store = token_store.write(docs, parts=1, rows_per_index=1000)
    assert scanned_rows(store.data(spark).select("doc_id")) == 12_000
    hit = token_store.lookup(spark, store, [2000])
    assert [r["doc_id"] for r in hit.collect()] == [2000] and scanned_rows(hit) <= 1000
    # odd ids lie inside the range of every file and row group: only Bloom filters can skip them
    assert scanned_rows(store.data(spark).where("doc_id IN (2001, 3333, 5555, 7001, 21001)")) <= 1000


def test_store_stripes_are_read_by_several_tasks(spark):
    rng = random.Random(3)
    docs = H.documents(spark, [(i, " ".join(str(rng.random()) for _ in range(200)), "s") for i in range(1500)])
    store = token_store.write(docs, parts=1, stripe_bytes=300_000)
    file = files_of(store)[0]
    assert orc.ORCFile(file).nstripes >= 3
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "300000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1000")
        rows = store.data(spark).selectExpr("spark_partition_id() AS p").groupBy("p").count().collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(rows) >= 3 and sum(r["count"] for r in rows) == 1500


def test_store_window_of_ids(spark):
    rows = [(i, f"words of text {i} " * (i % 7), "s") for i in range(60)]
    store = token_store.write(H.documents(spark, rows), parts=4)
    whole = [x for r in store_brute([r[:2] for r in rows]) for x in r[4]]
    for first, count in ((0, 10), (37, 500), (len(whole) - 5, 100), (11, 0)):
        parts = sorted((r["start"], list(r["ids"])) for r in token_store.window(spark, store, first, count).collect())
        assert [x for _s, ids in parts for x in ids] == whole[first : first + count]
        assert not parts or parts[0][0] == first
