import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscan.llm import mixing, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard int"


def brute_capacity(sizes, shards):
    best = [[0] + [10**18] * len(sizes)]
    for _ in range(shards):
        row = []
        for end in range(len(sizes) + 1):
            row.append(min(max(best[-1][start], sum(sizes[start:end])) for start in range(end + 1)))
        best.append(row)
    return best[-1][-1]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=9), st.integers(1, 4))
def test_the_capacity_is_the_smallest(sizes, shards):
    cuts = sharding.cut_points(np.array(sizes, np.int64), shards)
    assert len(cuts) == shards and cuts == sorted(cuts)
    held = [sum(sizes[a:b]) for a, b in zip(cuts, [*cuts[1:], len(sizes)], strict=True)]
    assert sum(held) == sum(sizes)
    assert max(held) == brute_capacity(sizes, shards)


def test_shards_hold_groups_and_slots_have_no_gaps(spark):
    texts = ["", None, "same", "same", "ä" * 40] + [f"text {i % 50}" for i in range(200)]
    rows = [(i, t, "en", "s", 0, 9) for i, t in enumerate(texts)] + [(3, "same", "en", "s", 0, 9), (None, "x", None, None, None, None)]
    got = sharding.op7_minimax_shards(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    where = {}
    for r in got:
        where.setdefault(r["shard"], []).append(r)
    for own in where.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[0]["size"] == by_id[1]["size"] == 1 and by_id[0]["shard"] == by_id[1]["shard"]
    assert by_id[4]["size"] == 81 and by_id[4]["text_crc32"] == zlib.crc32(("ä" * 40).encode())
    assert len({r["shard"] for r in got if r["text_crc32"] == zlib.crc32(b"same")}) == 1
    totals = [sum(r["size"] for r in own) for own in where.values()]
    assert max(totals) <= sum(totals) / 8 + max(81, max(4 * len("same") + 4, 4 * 8))


def test_a_giant_group_leaves_the_other_shards_even(spark):
    rows = [(i, "giant " * 50) for i in range(100)] + [(1000 + i, f"small {i} " * 9) for i in range(700)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    totals = np.bincount([r["shard"] for r in got], weights=[r["size"] for r in got], minlength=8)
    assert sorted(totals)[0] > 0.5 * sorted(totals)[-2]


def test_empty_table(spark):
    empty = spark.createDataFrame([], DOCS)
    assert sharding.op7_minimax_shards(empty).count() == 0
    assert mixing.op9_sainte_lague(empty).count() == 0
    assert mixing.mixed_documents(empty).count() == 0


def test_sainte_lague_gives_seats_to_the_highest_quotients():
    assert mixing.apportion([53, 24, 23], 7, [99] * 3) == [3, 2, 2]
    assert mixing.apportion([53, 24, 23], 7, [1, 99, 99]) == [1, 3, 3]
    assert mixing.apportion([1, 1], 9, [2, 3]) == [2, 3]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 100), min_size=1, max_size=8))
def test_targets_share_everything_within_their_limits(sizes):
    weights = [mixing.WEIGHTS[i % 3] for i in range(len(sizes))]
    goal = mixing.targets(sizes, weights)
    assert all(g <= 3 * s + 1e-6 for g, s in zip(goal, sizes, strict=True))
    assert abs(sum(goal) - sum(sizes)) < 1e-6 * (1 + sum(sizes))


def test_mix_comes_near_its_targets_and_repeats(spark):
    rows = []
    for i in range(900):
        source = "big" if i % 3 == 0 else f"s{i % 7}" if i % 11 else None
        rows.append((i, " ".join(f"w{j}" for j in range(i % 37)) if i % 50 else None, "en", source, 0, 1))
    rows += [(5000, "tiny source", "en", "a-tiny", 0, 1), (7, rows[7][1], "en", rows[7][3], 0, 1)]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.op9_sainte_lague(docs).toPandas()
    assert len(got) == len(rows)
    assert (got.taken <= 3 * got["size"]).all() and (got.taken >= 0).all()
    source = {r[0]: r[3] or "" for r in rows}
    for name, own in got.groupby(got.doc_id.map(source)):
        assert own.source_size.nunique() == 1 and own.source_size.iloc[0] == own["size"].sum(), name
        assert abs(own.taken.sum() - own.target.iloc[0]) <= 0.02 * own.target.iloc[0] + 5, name
    assert got[got.doc_id == 5000].taken.iloc[0] == 6
    again = mixing.op9_sainte_lague(docs.repartition(7)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert got[key].sort_values(key).values.tolist() == again[key].sort_values(key).values.tolist()


def test_mixed_documents_repeat_up_to_three_times(spark):
    rows = [(i, "a b c d", "en", "small" if i < 5 else "z-large", 0, 1) for i in range(100)]
    docs = spark.createDataFrame(rows, DOCS)
    counts = mixing.mixed_documents(docs).groupBy("doc_id").count().collect()
    assert {r["count"] for r in counts if r["doc_id"] < 5} == {3}
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_sources_smaller_than_a_block_meet_their_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCKS", 16)
    rows = []
    for i in range(4000):
        source = "a" if i % 100 < 60 else "b" if i % 100 < 90 else "c" if i % 100 < 95 else "d"
        rows.append((i, "w " * (1 + i % 23), "en", source, 0, 1))
    rows += [(9000 + i, "x y z", "en", f"e{i}", 0, 1) for i in range(6)]
    got = mixing.op9_sainte_lague(spark.createDataFrame(rows, DOCS)).toPandas()
    assert (got.taken <= 3 * got["size"]).all() and (got.taken >= 0).all() and got.taken.sum() == got["size"].sum()
    source = {r[0]: r[3] for r in rows}
    for name, own in got.groupby(got.doc_id.map(source)):
        assert abs(own.taken.sum() - own.target.iloc[0]) < 1, name


def test_many_seats_are_dealt_as_one_by_one():
    def slowly(weights, seats, limits):
        held = [0] * len(weights)
        for _ in range(seats):
            open_ = [i for i, w in enumerate(weights) if w > 0 and held[i] < limits[i]]
            if open_:
                held[max(open_, key=lambda i: (weights[i] / (2 * held[i] + 1), -i))] += 1
        return held

    r = np.random.default_rng(5)
    for _ in range(40):
        weights, limits, seats = r.integers(0, 60, 6).tolist(), r.integers(0, 200, 6).tolist(), int(r.integers(0, 700))
        assert mixing.apportion(weights, seats, limits) == slowly(weights, seats, limits)


def reference_shards(rows, n_shards=8, buckets=sharding.BUCKETS):
    """Shard of each row of (size, bucket): capacity by dynamic programming over groups in order, cut by hand."""
    weight = {}
    for size, b in rows:
        weight[b] = weight.get(b, 0) + size
    order = sorted(weight, key=lambda b: (-weight[b], b))
    where, at = {}, 0
    for left in range(n_shards, 0, -1):
        sizes = [weight[b] for b in order[at:]]
        low = next((c for c in range(max([*sizes, 0]), sum(sizes) + 1) if fits_by_hand(sizes, left, c)), 0)
        held = 0
        while at < len(order) and held + weight[order[at]] <= low:
            held += weight[order[at]]
            where[order[at]] = n_shards - left
            at += 1
    return where


def fits_by_hand(sizes, shards, capacity):
    used, held = 1, 0
    for s in sizes:
        if held + s > capacity:
            used, held = used + 1, 0
        held += s
    return used <= shards


def test_placement_equals_a_plain_version(spark):
    r = np.random.default_rng(7)
    rows = [(i % 30, "w " * int(r.integers(0, 30)) + str(i % 40), "en", "s", 0, 9) for i in range(120)]
    rows += [(None, "null id", "en", "s", 0, 9), (None, "null id", "en", "s", 0, 9), (None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    got = sharding.op7_minimax_shards(docs).collect()
    keys = docs.selectExpr("doc_id", "crc32(coalesce(text, '')) as crc", f"cast(pmod(xxhash64(coalesce(text, '')), {sharding.BUCKETS}) as int) as bucket", "octet_length(coalesce(text, '')) + 1 as size").collect()
    where = reference_shards([(k["size"], k["bucket"]) for k in keys])
    bucket = {k["crc"]: k["bucket"] for k in keys}
    assert len(got) == len(rows) and all(g["shard"] == where[bucket[g["text_crc32"]]] for g in got)
    for k in range(8):
        assert sorted(g["slot"] for g in got if g["shard"] == k) == list(range(sum(g["shard"] == k for g in got)))


def test_columns_of_any_name_stay(spark):
    names = ["_at", "_cell", "_bucket", "_from", "_taken", "_times", "_size", "_order", "row", "times", "cell", "bucket", "start", "digest", "base", "full"]
    rows = [(i, f"text {i % 9} of some words", f"s{i % 3}", *range(len(names))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names))
    for got, more in ((sharding.shard_documents(docs), ["size", "text_crc32", "shard", "slot"]), (mixing.mixed_documents(docs), [])):
        assert got.columns == [*docs.columns, *more]
        assert {tuple(x[n] for n in names) for x in got.collect()} == {tuple(range(len(names)))}


def plain_mix(rows, blocks):
    """taken of each row by word, from the streams' order: quotas seat by seat, blocks one after the other."""
    sizes = {}
    for source, _, size in rows:
        sizes[source] = sizes.get(source, 0) + size
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weights = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    goal = dict(zip(names, mixing.targets([sizes[s] for s in names], [weights[s] for s in names]), strict=True))
    capped = {s for s in names if goal[s] >= 3 * sizes[s]}
    open_ = [s for s in names if s not in capped]
    quota = dict.fromkeys(names, 0)
    for _ in range(round(sum(goal[s] for s in open_))):
        free = [s for s in open_ if quota[s] < 3 * sizes[s]]
        best = max(free, key=lambda s: (goal[s] / (2 * quota[s] + 1), -names.index(s)))
        quota[best] += 1
    block = max(1, sum(sizes.values()) // blocks)
    out = []
    for k, source in enumerate(names):
        stream = [i for i, (s, _, size) in sorted(enumerate(rows), key=lambda x: x[1][1]) if s == source for _ in range(size)]
        words = [3 if source in capped else 0] * len(stream)
        left = 0 if source in capped else quota[source]
        while stream and left >= len(stream):
            words = [w + 1 for w in words]
            left -= len(stream)
        n = max(1, -(-len(stream) // block))
        step = mixing._step(n, mixing.SEED + 7919 * k)
        place = (mixing.SEED + k) % n
        turns = sorted(range(n), key=lambda j: (j * step + place) % n)
        for j in turns:
            for w in range(j * block, min(len(stream), (j + 1) * block)):
                if left:
                    words[w] += 1
                    left -= 1
        taken = {}
        for i, w in zip(stream, words, strict=True):
            taken[i] = taken.get(i, 0) + w
        out += [(i, taken.get(i, 0)) for i, (s, _, _) in enumerate(rows) if s == source]
    return [t for _, t in sorted(out)]


@pytest.mark.parametrize("blocks", [7, 64, 1 << 18])
def test_mix_equals_a_plain_version(spark, monkeypatch, blocks):
    monkeypatch.setattr(mixing, "BLOCKS", blocks)
    r = np.random.default_rng(blocks)
    rows = [(i, " ".join(["w"] * int(r.integers(0, 25))) + f" {i}", "en", [None, "a", "b", "c", "d"][int(r.integers(5)) if i % 4 else 1], 0, 1) for i in range(150)]
    rows = [(i, t.strip(), *more) for i, t, *more in rows]
    docs = spark.createDataFrame(rows, DOCS)
    got = {x["doc_id"]: (x["size"], x["taken"]) for x in mixing.op9_sainte_lague(docs).collect()}
    shards = max(1, min(len(rows) // 200, mixing.CELLS))
    assert shards == 1
    order = {x["doc_id"]: x["h"] for x in docs.select("doc_id", F.xxhash64(F.lit(mixing.SEED), "doc_id", F.size(F.split("text", " ")).cast("long"), F.xxhash64("text")).alias("h")).collect()}
    want = plain_mix([(s, order[i], got[i][0]) for i, _, _, s, _, _ in rows], blocks)
    assert [got[i][1] for i in range(len(rows))] == want


def test_rows_that_share_an_id_are_mixed_one_by_one(spark):
    rows = [(None, f"words of a row without an id {i}", "en", "big" if i % 5 else "a", i, 1) for i in range(400)] + [(1, f"shared id {i} " * 3, "en", "b", 1000 + i, 1) for i in range(40)]
    docs = spark.createDataFrame(rows, DOCS)
    told = mixing.op9_sainte_lague(docs).toPandas()
    mixed = mixing.mixed_documents(docs).groupBy("n_chars", "source").count().toPandas()
    for source, own in (("a", [r for r in rows if r[3] == "a"]), ("big", [r for r in rows if r[3] == "big"]), ("b", [r for r in rows if r[3] == "b"])):
        size = sum(len(r[1].split()) for r in own)
        ratio = told[told.source_size == size].target.iloc[0] / size
        counts = mixed[mixed.source == source]["count"]
        assert abs(counts.sum() - ratio * len(own)) < 0.2 * ratio * len(own) + 4 and counts.max() <= int(ratio) + 1
    again = mixing.mixed_documents(docs.repartition(5)).groupBy("n_chars").count().collect()
    assert sorted(map(tuple, again)) == sorted((r.n_chars, r["count"]) for _, r in mixed.iterrows())
