import hashlib
import random
import re
from collections import Counter
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pytest

from folioscan.llm import bagminhash, chunks, suffixes
from folioscan.llm.bytetext import packed, sliced
from folioscan.llm.graph import components

DOCS = "doc_id long, text string, kept string, n_bytes int"


def frame(spark, docs):
    return spark.createDataFrame([(*d, "clash", 1) for d in docs], DOCS)


def prose(r, n):
    return " ".join("".join(r.choice("abcdeiou") for _ in range(r.randrange(2, 8))) for _ in range(n))


def brute_removed(docs):
    """Byte removal by the definition: windows of 50 bytes that start in a document with a smaller id."""
    first, out = {}, {}
    for d, t in docs:
        b = (t or "").encode()
        for s in range(len(b) - 49):
            w = b[s : s + 50]
            if d is not None:
                first[w] = min(d, first.get(w, d))
    for d, t in docs:
        b = (t or "").encode()
        keep = bytearray(b"\1" * len(b))
        for s in range(len(b) - 49):
            if d is not None and first[b[s : s + 50]] < d:
                keep[s : s + 50] = bytes(50)
        kept = bytes(x for x, k in zip(b, keep, strict=True) if k)
        spans = len(re.findall(rb"\0+", bytes(keep)))
        out[d] = (len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return out


def repeating_docs(seed):
    r = random.Random(seed)
    passages = [prose(r, 30) for _ in range(4)]
    docs = []
    for i in range(60):
        parts = [prose(r, r.randrange(30))]
        for _ in range(r.randrange(3)):
            p = r.choice(passages)
            a = r.randrange(len(p) // 2)
            parts += [p[a : a + r.randrange(40, 160)], prose(r, r.randrange(6))]
        docs.append((i * 3 % 61, "ä ".join(parts)))
    docs += [(100, docs[5][1]), (101, docs[5][1] + "x"), (102, "y" + docs[5][1]), (103, "z" * 400), (104, "z" * 90), (2000, "ab" * 200), (105, None), (106, ""), (107, "w" * 49), (None, docs[5][1])]
    return docs


@pytest.mark.parametrize("seed", range(3))
def test_suffix_dedup_equals_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE", 300)
    docs = repeating_docs(seed)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.op4_suffix_merge(frame(spark, docs).repartition(5)).collect()}
    assert got == brute_removed(docs)


def test_suffix_dedup_keeps_texts(spark):
    text = "the same long passage that is certainly more than fifty bytes long"
    got = {r["doc_id"]: r["kept"] for r in suffixes.deduplicate(frame(spark, [(1, text), (2, "A " + text), (1, text)])).select("doc_id", "kept").distinct().collect()}
    assert got == {1: text, 2: "A "}
    assert suffixes.op4_suffix_merge(frame(spark, [])).count() == 0


def test_loser_tree_merges_front_coded_runs():
    r = random.Random(1)
    for _ in range(60):
        runs = [sorted({bytes(r.choice(b"ab\0") for _ in range(r.randrange(1, 9))) for _ in range(r.randrange(20))}) for _ in range(r.randrange(1, 9))]
        coded = [suffixes.Run(*suffixes.front_coded(x)) if x else suffixes.Run(*(np.zeros(0, np.uint8),) * 3) for x in runs]
        out = list(suffixes.merge(coded))
        assert [e for e, *_ in out] == sorted(x for run in runs for x in run)
        assert all(runs[k][i] == e for e, _, k, i in out)
        for (a, *_), (b, shared, *_) in zip(out, out[1:], strict=False):
            assert shared == len(a) if a == b else a[:shared] == b[:shared] and a[: shared + 1] != b[: shared + 1]


def bag(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()


def brute_classes(docs, threshold=0.8):
    parent = {d: d for d, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    bags = {d: bag(t) for d, t in docs}
    for a in bags:
        for b in bags:
            if a < b and bags[a] and sum((bags[a] & bags[b]).values()) >= threshold * sum((bags[a] | bags[b]).values()):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in bags}


def near_docs():
    r = random.Random(4)
    base = [prose(r, 90).split() for _ in range(6)]
    docs = []
    for i in range(150):
        w = list(base[i % 6]) if i % 3 else prose(r, 60).split()
        for _ in range(r.randrange(5)):
            w[r.randrange(len(w))] = prose(r, 1)
        docs.append((i, " ".join(w)))
    again = " ".join(["one two three four five six"] * 20)
    return docs + [(200, docs[7][1].upper()), (201, again), (202, again + " one two"), (203, "few words"), (204, "Few, words!"), (205, ""), (206, None), (207, "..."), (208, "...")]


def test_near_duplicates_equal_brute_force(spark):
    docs = near_docs()
    rows = bagminhash.op5_bagminhash(frame(spark, [*docs, (7, docs[7][1]), (None, "no id")])).collect()
    assert len(rows) == len(docs) + 2
    got = {r["doc_id"]: r["class_id"] for r in rows}
    assert got.pop(None) is None
    assert got == brute_classes(docs)
    kept = bagminhash.deduplicated(frame(spark, docs))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(got.values())) and kept.columns == ["doc_id", "text", "kept", "n_bytes"]
    assert bagminhash.op5_bagminhash(frame(spark, [])).count() == 0


def test_registers_agree_as_weighted_jaccard_says():
    rng = np.random.default_rng(9)
    item = np.arange(300, dtype=np.uint64) * np.uint64(977) + np.uint64(5)
    a, b = rng.integers(0, 9, 300), rng.integers(0, 9, 300)
    b[:200] = a[:200]
    rows = [(np.flatnonzero(w), w[w > 0]) for w in (a, b)]
    text = np.concatenate([np.full(len(i), k) for k, (i, _) in enumerate(rows)])
    sig = bagminhash.signatures(text, item[np.concatenate([i for i, _ in rows])], np.concatenate([w for _, w in rows]), 2, 4096)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((sig[0] == sig[1]).mean() - want) < 0.035


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(20, 60)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 161)} == {100} and {got[i] for i in [7, *range(20, 60)]} == {7}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_gear_hash_depends_on_its_window_alone():
    raw = np.random.default_rng(1).integers(0, 256, 500).astype(np.uint8)
    want = [sum(int(chunks.GEAR[raw[i - j]]) << j for j in range(32)) % (1 << 32) for i in range(31, 500)]
    assert chunks.gear_hashes(raw)[31:].tolist() == want


def test_chunks_cover_the_text_and_resist_insertions(spark):
    r = random.Random(8)
    text = prose(r, 3000)
    table = lambda t: [(x["begin"], x["end"], x["a"], x["b"]) for x in chunks.chunk_table(frame(spark, [(1, t)])).orderBy("begin").collect()]
    plain, moved = table(text), table("inserted " + text)
    assert plain[0][0] == 0 and plain[-1][1] == len(text.encode()) and all(x[1] == y[0] for x, y in zip(plain, plain[1:], strict=False))
    assert all(b - a <= chunks.MOST + chunks.LEAST for a, b, *_ in plain)
    assert len({x[2:] for x in plain} - {x[2:] for x in moved}) <= 3


def test_repeated_passages_go_and_the_rest_stays(spark):
    r = random.Random(12)
    passage = prose(r, 80)
    docs = [(i, prose(r, 40)) for i in range(20)] + [(50, prose(r, 30) + " " + passage + " " + prose(r, 30)), (51, prose(r, 9) + passage), (52, passage + " end"), (60, docs_text := prose(r, 50)), (61, docs_text), (70, None), (71, ""), (72, "tiny"), (73, "tiny"), (None, docs_text)]
    got = {x["doc_id"]: x for x in chunks.op8_gear_chunks(frame(spark, docs)).collect()}
    assert all(got[i]["n_removed"] == 0 for i in [*range(20), 50, 60, 70, 71, 72, None])
    assert got[51]["n_removed"] > 150 and got[52]["n_removed"] > 150
    assert got[61]["n_removed"] == got[61]["n_bytes"] and got[73]["n_removed"] == 4
    kept = {x["doc_id"]: x["text"] for x in chunks.remove_repeats(frame(spark, docs)).collect()}
    assert hashlib.sha256(kept[51].encode()).hexdigest() == got[51]["kept_sha256"] and kept[61] == ""
    assert chunks.op8_gear_chunks(frame(spark, [])).count() == 0


def test_every_repeated_chunk_goes_however_short(spark):
    r = random.Random(21)
    line = prose(r, 400)
    line = line[slice(*next((b, e) for b, e in pairwise([0, *chunks.boundaries((np.flatnonzero((chunks.gear_hashes(np.frombuffer(line.encode(), np.uint8)) & chunks._MASK) == 0) + 1).tolist(), len(line))]) if 0 < b and e - b < 90))]
    docs = [(i, line + prose(r, 40)) for i in range(12)]
    got = {x["doc_id"]: x for x in chunks.op8_gear_chunks(frame(spark, docs)).collect()}
    table = chunks.chunk_table(frame(spark, docs)).collect()
    first = {}
    for x in table:
        first[x["a"], x["b"]] = min(x["doc_id"], first.get((x["a"], x["b"]), x["doc_id"]))
    want = {i: sum(x["end"] - x["begin"] for x in table if x["doc_id"] == i and first[x["a"], x["b"]] < i) for i, _ in docs}
    assert {i: got[i]["n_removed"] for i in got} == want and want[0] == 0 and all(want[i] == len(line) for i in range(1, 12))


def test_suffix_dedup_with_an_id_on_both_sides_of_another(spark):
    r = random.Random(3)
    passage = prose(r, 40)
    docs = [(1, passage), (2, prose(r, 9) + " " + passage), (1, passage)]
    rows = spark.createDataFrame([(*d, "clash", 1) for d in docs], DOCS).coalesce(1)
    got = {(x["doc_id"], x["n_removed"] >= len(passage)) for x in suffixes.op4_suffix_merge(rows).collect()}
    assert got == {(1, False), (2, True)}


def test_rows_that_share_an_id_lose_their_own_repeats_only(spark):
    r = random.Random(17)
    passage, other = prose(r, 90), prose(r, 70)
    docs = [(1, passage), (2, "x y " + passage), (2, other), (3, other), (None, passage), (None, other)]
    rows = [(x["doc_id"], x["n_bytes"], x["n_removed"]) for x in chunks.op8_gear_chunks(frame(spark, docs)).collect()]
    assert len(rows) == len(docs)
    removed = {(d, n): gone for d, n, gone in rows}
    assert removed[1, len(passage)] == removed[2, len(other)] == removed[None, len(passage)] == removed[None, len(other)] == 0
    assert removed[2, len(passage) + 4] > 300 and removed[3, len(other)] == len(other)


def brute_chunks(text):
    """Chunk ends by the rule, byte by byte."""
    out, at = [], 0
    for i in range(len(text)):
        h = sum(int(chunks.GEAR[text[i - j]]) << j for j in range(min(32, i + 1))) % (1 << 32)
        size = i + 1 - at
        if size >= chunks.LEAST and h & int(chunks._MASK) == 0 or size == chunks.MOST and i + 1 < len(text):
            out.append(i + 1)
            at = i + 1
    if len(text) > at:
        if out and len(text) - at < chunks.LEAST:
            out[-1] = len(text)
        else:
            out.append(len(text))
    return out


def brute_chunk_removal(docs):
    pieces = []
    for d, t in docs:
        body = (t or "").encode()
        ends = brute_chunks(body) if d is not None else []
        pieces.append([body[a:b] for a, b in zip([0, *ends], ends, strict=False)])
    first = {}
    for (d, _), own in zip(docs, pieces, strict=True):
        for x in own:
            first[x] = min(d, first.get(x, d))
    out = []
    for (d, t), own in zip(docs, pieces, strict=True):
        goes = [first[x] < d for x in own]
        kept = b"".join(x for x, g in zip(own, goes, strict=True) if not g) if own else (t or "").encode()
        spans = sum(g and not before for g, before in zip(goes, [False, *goes], strict=False))
        size = len((t or "").encode())
        out.append((d, size, size - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(3))
def test_chunk_removal_equals_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(chunks, "PIECE", 700)
    docs = [*repeating_docs(seed), (31, "y" * 700), (32, "y" * 700), (31, "another text of a shared id"), (33, None)]
    rows = frame(spark, docs).repartition(3).withColumnRenamed("kept", "spans")
    got = [(x["doc_id"], x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in chunks.op8_gear_chunks(rows).collect()]
    assert sorted(got, key=str) == brute_chunk_removal(docs)


def test_long_texts_and_small_slices(spark, monkeypatch):
    r = random.Random(23)
    long = prose(r, 60000)
    docs = [(1, long), (2, prose(r, 20) + long[1000:200000]), (3, "short"), (4, long[:30])]
    for module in (chunks, suffixes):
        monkeypatch.setattr(module, "SLICE", 3000)
    got = {x["doc_id"]: x for x in chunks.op8_gear_chunks(frame(spark, docs)).collect()}
    assert got[1]["n_removed"] == 0 and got[2]["n_removed"] > 198000
    got = {x["doc_id"]: x for x in suffixes.op4_suffix_merge(frame(spark, docs)).collect()}
    assert got[1]["n_removed"] == 0 and 0 <= got[2]["n_removed"] - 199000 < 8 and got[2]["n_spans"] == 1


def test_suffix_starts_do_not_depend_on_the_step(monkeypatch):
    r = random.Random(29)
    texts = [prose(r, r.randrange(0, 400)).encode() for _ in range(12)] + [b"", b"z" * 900, b"q" * 49, b"q" * 50]
    raw, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)

    def windows():
        """Suffix start and prefix hash of every window, whatever run of windows it is in."""
        return {w: (int(s), int(h)) for f, last, s, h in zip(*suffixes.suffix_starts(raw, offsets), strict=True) for w in range(f, last + 1)}

    whole = windows()
    inside = {w for a, b in pairwise(offsets.tolist()) for w in range(a, b - suffixes.MATCH + 1)}
    assert set(whole) == inside and all(w <= s <= w + suffixes.SPREAD - 1 for w, (s, _) in whole.items())
    for step in (64, 101, 1000):
        monkeypatch.setattr(suffixes, "PIECE", step)
        assert windows() == whole


@pytest.mark.parametrize("seed", range(2))
def test_suffix_dedup_with_a_hot_prefix_equals_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(suffixes, "SLICE", 4000)
    r = random.Random(40 + seed)
    passage = prose(r, 12)
    told = []
    docs = [(i, prose(r, r.randrange(1, 6)) + " " + passage + prose(r, r.randrange(1, 9))) for i in range(90)]
    docs += [(i, t + "!") for i, t in enumerate([t for _, t in docs[:20]], 100)]
    blobs = []
    for number, size, *arrays in sliced([pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs]), pa.array([t for _, t in docs])], ["doc_id", "text"])], 0, 4000):
        assert size <= 4000
        blobs.append((number, packed(*arrays)))
    assert len(blobs) > 2
    monkeypatch.setattr(suffixes, "HOT", 40)
    prints = pa.Table.from_batches(list(suffixes._fingerprinted(1)([pa.RecordBatch.from_arrays([pa.array([n for n, _ in blobs]), pa.array([b for _, b in blobs])], ["slice", "blob"])])))
    bits = suffixes._shared_prefixes(prints).to_pylist()
    assert sum(b["n_hot"] for b in bits) > 0
    marked = [suffixes._apart(b, [x for x in bits if x["slice"] == n]) for n, b in blobs]
    assert all(len(x.window) for x in marked)
    parts = pa.Table.from_batches([suffixes._by_part(n, x.window_fingerprints()[0], 1, x.window_fingerprints()[1]) for (n, _), x in zip(blobs, marked, strict=True)])
    windows = suffixes._shared_windows(parts).to_pylist()
    runs = pa.Table.from_batches(list(suffixes._runs(1)([pa.RecordBatch.from_pylist([{"slice": n, "blob": b, "bits": [x for x in bits if x["slice"] == n], "windows": [x for x in windows if x["slice"] == n]} for n, b in blobs])])))
    answers = suffixes._settled(runs).to_pylist()
    for n, b in blobs:
        own = suffixes._kept(b, [x for x in bits if x["slice"] == n], [x for x in windows if x["slice"] == n])
        told.append((own, suffixes.removed_bytes(own, [a for a in answers if a["slice"] == n], 1)))
    want = brute_removed(docs)
    for own, gone in told:
        for i, d in enumerate(own.ids.tolist()):
            assert gone[own.offsets[i] : own.offsets[i + 1]].sum() == want[d][1]


def test_near_duplicates_of_rows_with_shared_or_no_ids(spark):
    r = random.Random(31)
    one, two, three = (prose(r, 60) for _ in range(3))
    docs = [(1, one), (2, two), (2, one + " end"), (5, three), (5, two), (None, three), (None, one), (None, "alone without an id here"), (None, "alone without an id here"), (9, None), (9, "")]
    rows = spark.createDataFrame([(d, t, i, "x") for i, (d, t) in enumerate(docs)], "doc_id long, text string, row int, node string")
    kept = bagminhash.deduplicated(rows)
    assert kept.columns == rows.columns
    places = sorted(x["row"] for x in kept.collect())
    assert len(places) == 6 and places[:2] == [0, 1] and 3 in places and len({7, 8} & set(places)) == 1 and places[-2:] == [9, 10]
    told = sorted((x["n_shingles"], x["doc_id"] or 0, x["class_id"] or 0, x["is_kept"]) for x in bagminhash.op5_bagminhash(rows).collect())
    want = [(0, 9, 9, True)] * 2 + [(1, 0, 0, False), (1, 0, 0, True)] + [(56, 0, 1, False), (56, 0, 5, False), (56, 1, 1, True), (56, 2, 2, True), (56, 5, 2, False), (56, 5, 5, True), (57, 2, 1, False)]
    assert told == sorted(want)


def test_a_hub_of_many_is_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(bagminhash, "BLOCK", 3)
    r = random.Random(37)
    words = prose(r, 120).split()
    docs = []
    for i in range(60):
        own = list(words)
        own[r.randrange(len(own))] = prose(r, 1)
        docs.append((i, " ".join(own)))
    docs += [(100 + i, prose(r, 50)) for i in range(10)]
    got = {x["doc_id"]: x["class_id"] for x in bagminhash.op5_bagminhash(frame(spark, docs)).collect()}
    assert got == brute_classes(docs)
