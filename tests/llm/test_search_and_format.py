import hashlib
import math
import random
import re
import time
from collections import defaultdict

import numpy as np
import pytest

from folioscan.llm import decontaminate, preference, topk


def brute_top(vectors, k=5):
    ints = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v in vectors.items()}
    out = set()
    for q in ints:
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(ints[q], v, strict=False)), i) for i, v in ints.items() if i != q)
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])}
    return out


EMBEDDINGS = "vec_id long, embedding array<float>, label int, score double"


def test_top_k_equals_brute_force(spark):
    r = random.Random(3)
    vectors = {i: [r.gauss(0, 1) * (1 + i % 5) for _ in range(12)] for i in range(400)}
    for i in range(100, 140):
        vectors[i] = vectors[100]  # ties
    rows = [(i, v, 0, 0.0) for i, v in vectors.items()] + [(7, vectors[7], 1, 1.0)]
    rows += [(900, None, 0, 0.0), (950, [1.0, None], 0, 0.0), (1000, [float("nan")] * 12, 0, 0.0), (1050, [float("inf")] * 12, 0, 0.0), (None, vectors[1], 0, 0.0)]
    got = {tuple(x) for x in topk.op1_norm_sorted_topk(spark.createDataFrame(rows, EMBEDDINGS)).select("query_id", "rank", "vec_id", "score").collect()}
    assert got == brute_top(vectors)


def test_top_k_with_few_or_no_rows(spark):
    rows = [(50, [1.0, 2.0], 0, 0.0), (1, [3.0], 0, 0.0)]
    got = topk.op1_norm_sorted_topk(spark.createDataFrame(rows, EMBEDDINGS)).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(50, 1, 1, 256 * 768)]
    assert topk.op1_norm_sorted_topk(spark.createDataFrame([], EMBEDDINGS)).count() == 0


def test_search_prunes_and_stays_exact():
    rng = np.random.default_rng(5)
    c = rng.integers(-300, 300, (3000, 32)) * rng.integers(1, 9, (3000, 1))
    q = rng.integers(-300, 300, (20, 32))
    basis = np.linalg.svd(c, full_matrices=False)[2].T
    queries = topk.Vectors(np.arange(20) + 10_000, np.arange(20), q, basis)
    best = topk._Best.of(20, 5)
    topk.search(queries, topk.Vectors(np.arange(3000), np.arange(3000), c, basis), best)
    exact = q @ c.T
    for i, rows in zip(queries.ids, best.rows, strict=True):
        assert [-s for s, _ in rows] == sorted(exact[i].tolist(), reverse=True)[:5]


@pytest.mark.parametrize("group_bytes", [1, 12 * 8 * 3, 1 << 20])
def test_top_k_in_groups_of_queries(spark, group_bytes):
    r = random.Random(13)
    vectors = {i: [r.gauss(0, 1) * (1 + i % 7) ** 2 for _ in range(12)] for i in range(0, 900, 3)}
    rows = spark.createDataFrame([(i, v, 0, 0.0) for i, v in vectors.items()], EMBEDDINGS)
    got = topk.top_k(rows, group_bytes=group_bytes).collect()
    assert {tuple(x) for x in got} == brute_top(vectors) and len(got) == 5 * len([i for i in vectors if i % 50 == 0])


def test_top_k_of_rows_that_share_an_id(spark):
    rows = [(50, [1.0, 0.0], 0, 0.0), (50, [0.0, 2.0], 0, 0.0), (7, [3.0, 0.0], 0, 0.0), (7, [0.0, 1.0], 0, 0.0), (7, [0.0, 1.0], 1, 1.0)]
    got = [tuple(x) for x in topk.op1_norm_sorted_topk(spark.createDataFrame(rows, EMBEDDINGS)).collect()]
    unit = 256 * 256
    first = [(50, 1, 7, 3 * unit), (50, 2, 7, 0), (50, 3, 50, 0)]
    second = [(50, 1, 7, 2 * unit), (50, 2, 7, 0), (50, 3, 50, 0)]
    assert sorted(got) == sorted(first + second)
    with pytest.raises(ArithmeticError):
        topk.op1_norm_sorted_topk(spark.createDataFrame([(50, [1e300], 0, 0.0)], "vec_id long, embedding array<double>, label int, score double"))


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(docs, items):
    fold = lambda t: WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for i, t in items:
        w = fold(t)
        for k in range(max(1, len(w) - 9)) if w and i is not None else ():
            windows[tuple(w[k : k + 10])].add(str(i))
    out = []
    for d, t in docs:
        w, hit, met = fold(t), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if own := windows.get(tuple(w[k : k + size])):
                    hit |= set(range(k, k + size))
                    met |= own
        out.append((d, len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("part_bytes", [1 << 20, 700])
def test_decontamination_equals_brute_force(spark, part_bytes):
    r = random.Random(11)
    vocabulary = [a + b for a in ("ka", "lo", "Ém", "x9", "b") for b in ("", "ti", "rö", "S")]
    text = lambda n: "".join(r.choice(vocabulary) + r.choice([" ", ", ", "\n", "  ", "-"]) for _ in range(n))
    items = [(i, text(r.choice([0, 1, 3, 9, 10, 11, 25]))) for i in range(25)] + [(3, "ka lo"), (None, "b b"), (30, None), (100, "Kaputt kaputt")]
    docs = [(i, text(r.randrange(60)) + (r.choice(items)[1] or "") + text(r.randrange(9))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "..."), (103, (items[4][1] or "ka") * 900), (5, docs[5][1])]
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n_hit int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(x) for x in decontaminate.hits(frame, bench, part_bytes).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()]
    assert sorted(got, key=str) == brute_hits(docs, items)


@pytest.mark.parametrize("part_bytes", [1 << 20, 300])
def test_decontamination_keeps_columns_of_any_name(spark, part_bytes):
    rows = [(1, "one two three", 5, "a", True), (1, "four", 6, "b", False), (None, "two three four", 7, "c", None), (None, None, 8, "d", True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row int, row string, contaminated boolean")
    bench = spark.createDataFrame([(i, f"word{i} " * 11) for i in range(9)] + [(50, "Two, THREE")], "item_id long, text string")
    told = decontaminate.hits(docs, bench, part_bytes)
    assert told.columns == ["doc_id", "text", "_row", "row", *decontaminate.FIELDS]
    assert sorted((x["_row"], x["row"], x["n_words"], x["n_hit"]) for x in told.collect()) == [(5, "a", 3, 2), (6, "b", 1, 0), (7, "c", 3, 2), (8, "d", 0, 0)]
    clean = decontaminate.decontaminated(docs, bench)
    assert clean.columns == docs.columns and sorted(map(str, clean.collect())) == sorted(map(str, docs.filter("_row in (6, 8)").collect()))


def test_a_long_text_of_hits_takes_linear_time(spark):
    item = " ".join(f"w{i}" for i in range(24))
    docs = spark.createDataFrame([(1, (item + " ") * 8000)], "doc_id long, text string")  # 688 kB
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    start = time.time()
    row = decontaminate.op10_wu_manber(docs, bench).first()
    assert row["n_hit"] == row["n_words"] == 24 * 8000 and time.time() - start < 8


def test_decontamination_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.op10_wu_manber(docs, none).first()["contaminated"] is False
    assert decontaminate.op10_wu_manber(docs.filter("doc_id > 1"), none).count() == 0
    assert decontaminate.decontaminated(docs, spark.createDataFrame([(1, "B")], "item_id long, text string")).count() == 0


def test_wu_manber_finds_every_occurrence():
    r = random.Random(2)
    for _ in range(50):
        text = bytes(r.choice(b"ab ") for _ in range(9000))
        patterns = list({bytes(r.choice(b"ab ") for _ in range(r.randrange(1, 14))) for _ in range(12)})
        found = {(i, patterns[p]) for i, p in decontaminate.WuManber(patterns).find(text)}
        assert found == {(i, p) for p in patterns for i in range(len(text)) if text.startswith(p, i)}


TURNS = "conv_id long, turn long, role string, text string, prompt string"


def formatted(spark, rows):
    return {r["conv_id"]: r for r in preference.op6_preference_pairs(spark.createDataFrame([(*x, "clash") for x in rows], TURNS)).collect()}


def test_preference_pairs(spark):
    a = [(0, 0, "system", "be kind"), (0, 1, "user", "hi"), (0, 2, "assistant", "good one"), (0, 3, "user", "bye")]
    b = [(1, 0, "user", "yo"), (1, 1, "assistant", "bad öne")]
    got = formatted(spark, a + b)
    row = got[0]
    assert row["prompt"] == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>user\nhi<|im_end|>\n"
    assert row["chosen_completion"] == "<|im_start|>assistant\ngood one<|im_end|>\n<|im_start|>user\nbye<|im_end|>\n"
    assert row["rejected_completion"] == "<|im_start|>assistant\nbad öne<|im_end|>\n"
    begin, end = map(int, row["rejected_mask"].split("-"))
    assert row["rejected_completion"][begin:end] == "bad öne<|im_end|>\n" and row["rejected_trained"] == end - begin
    assert row["chosen_trained"] == len("good one<|im_end|>\n")


def test_preference_edge_cases(spark):
    got = formatted(spark, [(2, None, None, None), (2, 1, "assistant", ""), (3, 0, "user", "q"), (None, 0, "user", "x"), (9, 0, "assistant", "a"), (9, 0, "assistant", "a")])
    assert set(got) == {2, 3, 9}
    assert got[2]["prompt"] == "<|im_start|>unknown\n<|im_end|>\n" and got[2]["rejected_completion"] == ""
    assert got[3]["n_shared"] == 1 and got[3]["chosen_completion"] == got[3]["rejected_completion"] == ""
    assert got[9]["n_shared"] == 1 and got[9]["chosen_trained"] == len("a<|im_end|>\n")
    assert formatted(spark, []) == {}


def test_equal_replies_are_all_prompt(spark):
    rows = [(c, i, role, text) for c in (4, 5) for i, (role, text) in enumerate([("user", "q"), ("assistant", "a")])]
    assert formatted(spark, rows)[4]["n_shared"] == 2


def test_long_conversations_and_long_turns(spark):
    rows = [(20, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(5000)] + [(21, 0, "user", "x" * 300_000), (21, 1, "assistant", "y" * 300_000)]
    start = time.time()
    got = formatted(spark, rows)
    assert time.time() - start < 20
    row = got[20]
    assert row["n_shared"] == 4999 and row["chosen_completion"] == "<|im_start|>assistant\nturn 4999<|im_end|>\n" and row["rejected_trained"] == 300_000 + len("<|im_end|>\n")


def test_ranges_of_many_turns_equal_a_plain_version(spark):
    turns = [("assistant" if i % 3 else "user", "t" * (i % 7)) for i in range(300)]
    pairs = spark.createDataFrame([(1, "kept", turns, []), (2, "kept", [], turns[:64]), (3, "kept", turns[:65], turns)], "conv_id long, shared string, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>")
    for r in preference.format_pairs(pairs).collect():
        assert r["shared"] == "kept"
        for side, own in (("chosen", turns if r["conv_id"] == 1 else []), ("rejected", {1: [], 2: turns[:64], 3: turns[65:]}[r["conv_id"]])):
            at, ranges = 0, []
            for role, text in own:
                at += len(f"<|im_start|>{role}\n")
                end = at + len(f"{text}<|im_end|>\n")
                ranges += [f"{at}-{end}"] if role == "assistant" else []
                at = end
            assert r[f"{side}_mask"] == ",".join(ranges) and len(r[f"{side}_completion"]) == at
