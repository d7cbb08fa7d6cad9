"""Operators 2, 9 and 10, the pipeline and the registration."""

import hashlib
import io
import json
import random
import zlib

import numpy as np
import pytest

from ledgerkit.llm import mixing, packing, quality_crf, warc
from tests.conftest import SF_SMALL
from tests.llm import helpers as H
from tests.llm.test_dedup_operators import components_brute

# ---- operator 2


def targets_brute(sizes, weights, share, repeat):
    """Source sizes in order -> targets, sharing the excess again until none is above."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    cap, fixed = [repeat * s for s in sizes], set()
    while True:
        free = [i for i in range(len(sizes)) if i not in fixed]
        left = share * sum(sizes) - sum(cap[i] for i in fixed)
        target = [cap[i] if i in fixed else left * w[i] / sum(w[j] for j in free) for i in range(len(sizes))]
        above = {i for i in free if target[i] >= cap[i]}
        if not above or above == set(free):
            return target
        fixed |= above


def _mixed_docs(spark, seed=0):
    rng = random.Random(seed)
    rows = [(d, " ".join("w" for _ in range(rng.randrange(0, 80))), rng.choice(["é", "b", "a", None, "b", "b", "Z"])) for d in range(300)]
    return H.documents(spark, rows), rows


def test_mixing_targets_and_taken(spark):
    docs, rows = _mixed_docs(spark)
    got = {r["doc_id"]: r for r in mixing.schedule(docs).collect()}
    order = sorted({s for _d, _t, s in rows}, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(len(t.split()) for _d, t, x in rows if x == s) for s in order}
    expected = dict(zip(order, targets_brute([sizes[s] for s in order], (5, 2, 1), 1.5, 2)))
    taken = dict.fromkeys(order, 0)
    for d, t, s in rows:
        r = got[d]
        assert (r["size"], r["source_size"]) == (len(t.split()), sizes[s]) and r["target"] == pytest.approx(expected[s])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    # copies are whole: the one that crosses a target is off by at most half of its words
    assert all(abs(taken[s] - expected[s]) <= 79 / 2 + 1 for s in order)
    assert got == {r["doc_id"]: r for r in mixing.schedule(docs.repartition(3)).collect()}


def test_mixing_positions_invert_the_schedule(spark):
    for knots in mixing.SCHEDULES:
        sql = mixing.inverse_sql(knots, "u")
        rows = spark.range(0, 101).selectExpr("id / 100e0 AS u").selectExpr("u", f"{sql} AS t").collect()
        for r in rows:
            done = 0.0
            for (t0, m0), (t1, m1) in zip(knots, knots[1:]):
                t = min(max(r["t"], t0), t1)
                done += (t - t0) * (2 * m0 + (m1 - m0) * (t - t0) / (t1 - t0)) / 2
            assert done == pytest.approx(r["u"], abs=1e-9)
    with pytest.raises(ValueError):
        mixing.inverse_sql(((0.0, 2.0), (1.0, 2.0)), "u")


def test_mix_returns_the_copies_in_training_order(spark):
    docs, rows = _mixed_docs(spark, 1)
    plan = {r["doc_id"]: r for r in mixing.plan(docs).collect()}
    out = mixing.mix(docs).collect()
    words, texts = {}, {d: t for d, t, _s in rows}
    for r in out:
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(r["text"].split())
        assert r["text"] == texts[r["doc_id"]] and r["n_chars"] == len(r["text"]) and r["TEXT"] == "other"
    assert words == {d: p["taken"] for d, p in plan.items() if p["taken"] or not p["size"]}
    assert sum(not r["text"] for r in out) == sum(not t for t in texts.values()) > 0  # wordless documents stay, once
    # exactly the planned copies, in the order of their positions
    left = {d: sorted(c["position"] for c in p["copies"]) for d, p in plan.items()}
    at = [left[r["doc_id"]].pop(0) for r in out]
    assert at == sorted(at) and not any(left.values())


def test_mixing_of_sources_without_words(spark):
    rows = [(1, "a b c d", "x"), (2, "a b", "x"), (3, "", "y"), (4, None, "y"), (5, "e f g", "z"), (6, " \n", None)]
    got = {r["doc_id"]: r for r in mixing.schedule(H.documents(spark, rows)).collect()}
    assert all((got[i]["size"], got[i]["target"], got[i]["taken"], got[i]["position"]) == (0, 0.0, 0, None) for i in (3, 4, 6))
    assert got[1]["taken"] and got[5]["taken"]
    mixed = sorted(r["doc_id"] for r in mixing.mix(H.documents(spark, rows)).collect())
    assert [i for i in mixed if i in (3, 4, 6)] == [3, 4, 6]
    blank = H.documents(spark, [(1, None, "x"), (2, "", None)])
    assert [r["target"] for r in mixing.schedule(blank).collect()] == [0.0, 0.0] and mixing.mix(blank).count() == 2


def test_mixing_of_many_sources(spark, monkeypatch):
    docs, _rows = _mixed_docs(spark, 4)
    few = sorted(map(repr, mixing.schedule(docs).collect()))
    monkeypatch.setattr(mixing, "FEW_SOURCES", 0)
    monkeypatch.setattr(mixing, "ROWS_PER_RANGE", 40)
    monkeypatch.setattr(mixing, "COPIES_PER_TASK", 40)
    assert sorted(map(repr, mixing.schedule(docs).collect())) == few
    assert mixing.mix(docs).count() > 0


def test_mixing_of_many_rows_of_one_id(spark):
    rows = [(None, f"w{i} x", "s") for i in range(50)] + [(7, "same text", "s")] * 40 + [(i, "a b c", "t") for i in range(30)]
    docs = H.documents(spark, rows)
    taken = [(r["doc_id"], r["taken"]) for r in mixing.schedule(docs).collect()]
    assert len(taken) == 120
    mixed = mixing.mix(docs).collect()
    assert sum(len(r["text"].split()) for r in mixed) == sum(n for _d, n in taken)


def test_mixing_edges(spark):
    rows = mixing.schedule(H.messy(spark)).collect()
    assert len(rows) == 11 and sorted(r["size"] for r in rows)[:4] == [0, 0, 0, 0]
    mixed = mixing.mix(H.messy(spark))
    assert mixed.columns == H.messy(spark).columns
    assert mixed.count() > 0
    assert mixing.schedule(H.empty(spark)).count() == 0 and mixing.mix(H.empty(spark)).count() == 0


# ---- operator 9


def test_ids_equal_those_of_the_named_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    named = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode, rng = packing.encoder(), random.Random(0)
    points = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    texts = ["a%s1 %s%sb  %s ." % ((chr(c),) * 4) for c in rng.sample(points, 20_000)]
    texts += ["", " ", "it's 'S don't", "<|endoftext|> a<|endoftext|>", "\r\n \t x", " " * 3000, "x" * 5000, "\n" * 3000 + "y"]
    for text, other in zip(texts, named.encode_batch_fast(texts, add_special_tokens=False)):
        assert encode(text).tolist() == other.ids, text[:50]
    assert len(encode(" " * 200_000)) == len(named.encode(" " * 200_000, add_special_tokens=False).ids)


def check_packing(rows, size):
    """Every sequence is gapless from 0 and at most ``size`` long."""
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(sequences)


def test_packing_pieces_and_sequences(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = packing.pack_documents(docs).collect()
    encode, pieces = packing.encoder(), {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert pieces.keys() == texts.keys()
    for d, text in texts.items():
        ids = np.append(encode(text or ""), 2).astype("<u4")
        at = 0
        for k, (piece, start, length, crc) in enumerate(sorted(pieces[d])):
            assert (piece, start) == (k, at) and crc == zlib.crc32(ids[at : at + length].tobytes())
            assert length == 1024 or k == 0
            at += length
        assert at == len(ids)
    n, total = check_packing(rows, 1024), sum(r["length"] for r in rows)
    assert n <= -(-total // 1024) * 1.03 + 1


def test_packing_in_many_tasks_reopens_bad_sequences(spark):
    rng = random.Random(2)
    rows = [(d, 0, 0, rng.randrange(1, 65), d) for d in range(1500)]
    pieces = spark.createDataFrame(rows, packing._PIECES)
    total = sum(r[3] for r in rows)
    packed = packing.pack(pieces, size=64, per_task=100, open_gap=2).collect()
    assert sorted(r["doc_id"] for r in packed) == list(range(1500))
    assert check_packing(packed, 64) <= -(-total // 64) * 1.03


def test_sum_of_squares_chooses_the_smallest_sum():
    rng = random.Random(3)
    lengths = sorted((rng.randrange(1, 30) for _ in range(200)), reverse=True)
    sequence, offset, gaps = packing.sum_of_squares(lengths, 30)
    left = {}
    for n, s, o in zip(lengths, sequence, offset):
        before = dict(left)
        counts = lambda x: sum(v * v for v in np.bincount([g for g in x.values() if g]).tolist()) if x else 0
        left[s] = left.get(s, 30) - n
        assert o == 30 - n - left[s] and left[s] >= 0
        fits = [b for b, g in before.items() if g >= n]
        assert (s in before) == bool(fits)
        if fits:
            assert counts(left) == min(counts({**before, b: before[b] - n}) for b in fits)
    assert gaps.tolist() == [left[i] for i in range(len(left))]


def test_packing_edges(spark):
    rows = packing.pack_documents(H.messy(spark)).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
    check_packing(rows, 1024)
    assert sum(r["length"] == 1 and r["doc_id"] in (2, 3) for r in rows) == 2
    assert packing.pack_documents(H.empty(spark)).count() == 0
    assert packing.cut(2500, 1024) == [(0, 452), (452, 1024), (1476, 1024)] and packing.cut(1024, 1024) == [(0, 1024)]


# ---- operator 10

PAGES = "page_id long, url string, html string, owner string, sha int"


def _pages(spark):
    rng = random.Random(0)
    rows = [(i, f"http://h/{i}", rng.choice(["<p>a</p>", "é" * 50, "x" * 3000, f"own {i}", "", "a\r\n\r\nWARC/1.1\r\n"]), "o", 1) for i in range(80)]
    rows += [(None, None, "x" * 3000, None, None), (500, "u\nrl", None, None, None), rows[0], rows[7]]
    return spark.createDataFrame(rows, PAGES), rows


def pages_brute(rows, min_bytes):
    import base64

    out = []
    for i, _u, html, *_ in rows:
        body = (html or "").encode()
        same = [j for j, _v, h, *_ in rows if (h or "").encode() == body and len(body) >= min_bytes and j is not None]
        owner = min(same, default=None)
        revisit = len(body) >= min_bytes and len([1 for _j, _v, h, *_ in rows if (h or "").encode() == body]) > 1 and owner != i
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", owner if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("min_bytes", [0, 100])
def test_warc_round_trip(spark, min_bytes):
    pages, rows = _pages(spark)
    manifest = warc.write_archives(pages, min_bytes, archive_bytes=20_000)
    normal = warc.normalise(manifest)
    back = warc.read_archives(normal).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in back), key=str) == pages_brute(rows, min_bytes)
    texts = {(i, (h or "").encode()) for i, _u, h, *_ in rows}
    assert all((r["page_id"], bytes(r["payload"])) in texts for r in back if r["record_type"] == "response")
    assert {r["url"] for r in back if r["page_id"] == 500} == {"u\nrl"}  # escaped in the archive, read as it was
    # every index entry is a gzip member of its own; together they are the file
    entry = normal.first()
    fs, path = warc.filesystem(entry["archive"])
    with fs.open_input_file(path) as f:
        data = f.read()
    with fs.open_input_stream(warc.filesystem(entry["index"])[1]) as f:
        index = [json.loads(x) for x in f.read().splitlines()]
    assert [e["offset"] for e in index] == np.cumsum([0] + [e["length"] for e in index])[:-1].tolist() and sum(e["length"] for e in index) == len(data)


def test_normaliser_streams_one_or_many_members():
    records = [warc.record(i, None, bytes([97 + i]) * (10 ** (i + 1)), None) for i in range(6)]
    gz = zlib.compressobj(6, zlib.DEFLATED, warc.GZIP)
    single = gz.compress(b"".join(records)) + gz.flush()
    many = b""
    for part in (b"".join(records[:2]) + records[2][:50], records[2][50:], b"".join(records[3:])):
        gz = zlib.compressobj(6, zlib.DEFLATED, warc.GZIP)
        many += gz.compress(part) + gz.flush()
    for source in (single, many):
        target, index = io.BytesIO(), io.BytesIO()
        assert warc.normalise_file(io.BytesIO(source), target, index) == 6
        for e, expected in zip(map(json.loads, index.getvalue().splitlines()), records):
            assert zlib.decompress(target.getvalue()[e["offset"] : e["offset"] + e["length"]], warc.GZIP) == expected
    with pytest.raises(ValueError):
        warc.normalise_file(io.BytesIO(single[: len(single) // 2]), io.BytesIO(), io.BytesIO())


def test_warc_edges(spark):
    none = spark.createDataFrame([], PAGES)
    assert warc.read_archives(warc.normalise(warc.write_archives(none))).count() == 0


# ---- pipeline


def test_pipeline_stages_match_brute_force(spark):
    import corpus_pipeline as P

    assert [n for n, _f in P.STAGES] == ["quality_classifier", "exact_dedup", "near_duplicates", "mixing", "packing"]
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns, kept = docs.columns, {}
    state = docs
    for name, stage in P.STAGES:
        state = stage(spark, state, SF_SMALL)
        if name != "packing":
            assert state.columns == columns
        kept[name] = state.collect()
        state = spark.createDataFrame(kept[name], state.schema)
    rows = {r["doc_id"]: r for r in docs.collect()}
    model = quality_crf.train(docs, spark.read.parquet(f"{SF_SMALL}/labels.parquet"))
    ids = lambda name: sorted(r["doc_id"] for r in kept[name])
    scores = quality_crf.score_texts(model, [r["text"] for r in rows.values()])
    good = sorted(d for d, s in zip(rows, scores) if s >= 0.3)
    assert ids("quality_classifier") == good
    groups = {}
    for d in good:
        groups.setdefault(rows[d]["text"], []).append(d)
    unique = sorted(max(g) for g in groups.values())
    assert ids("exact_dedup") == unique
    brute = components_brute([(d, rows[d]["text"]) for d in unique], 5, 80)
    assert ids("near_duplicates") == sorted(d for d, (_n, c) in brute.items() if c == d)
    size = lambda r: len((r["text"] or "").encode().split())
    total = sum(map(size, kept["near_duplicates"]))
    # copies are whole: each of the sources is off by at most half of its longest document
    longest = {}
    for r in kept["near_duplicates"]:
        longest[r["source"]] = max(longest.get(r["source"], 0), size(r))
    assert abs(sum(map(size, kept["mixing"])) - 1.5 * total) <= sum(longest.values()) / 2 + len(longest)
    assert check_packing(kept["packing"], 1024) > 0
    encode = packing.encoder()
    assert sum(r["length"] for r in kept["packing"]) == sum(len(encode(r["text"])) + 1 for r in kept["mixing"])


def test_pipeline_stages_in_a_row_on_messy_rows(spark):
    import corpus_pipeline as P

    for state in (H.messy(spark), H.empty(spark)):
        for name, stage in P.STAGES:
            state = stage(spark, state, SF_SMALL)
            rows = state.collect()
            state = spark.createDataFrame(rows, state.schema)
        assert state.columns[:2] == ["doc_id", "piece"]


def test_registered_queries():
    import __spark_entry__ as E

    names = list(E.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names
    assert {k.split("_")[0] for k in E.oracle_sql() if k.startswith("op")} == {"op2", "op3", "op5", "op6", "op7", "op8", "op10", "op11"}


def test_texts_reach_the_packer_in_small_batches(spark, monkeypatch):
    """Pipeline, packing: a batch sent to a worker holds a few MB of texts, not 10,000 of them."""
    from ledgerkit.llm import packing

    docs = spark.range(0, 4000, 1, 1).selectExpr("id AS doc_id", "repeat(concat('word', id, ' '), 400) AS text")
    sizes = spark.sparkContext.accumulator(0)
    made = packing.map_rows

    def spy(df, make, schema):
        def count(batches):
            for batch in batches:
                sizes.add(int(batch.nbytes > 6 << 20))
                yield batch

        return made(df.mapInArrow(count, df.schema), make, schema)

    monkeypatch.setattr(packing, "map_rows", spy)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    assert packing.pack_documents(docs).select("doc_id").distinct().count() == 4000
    assert sizes.value == 0 and spark.conf.get(key) == before
