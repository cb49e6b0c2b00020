import hashlib
import math

from pyspark.sql import functions as F

from folioscan.functions import tokens, vectors
from folioscan.operators import retrieve


def test_words_fold_case_and_pair_ideographs(spark):
    row = spark.createDataFrame([("Annual LEAVE: 年假制度 x 年",)], "t string").select(tokens.words(F.col("t")).alias("w")).first()
    assert row["w"] == ["annual", "leave", "年假", "假制", "制度", "x", "年"]


def test_keywords_count_then_come_first(spark):
    rows = spark.createDataFrame([(1, "bb aa bb cc aa dd"), (2, "a b"), (3, ""), (4, None)], "id int, t string")
    got = {}
    for r in tokens.keywords(rows, "id", "t", 2).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append((r["keyword"], r["freq"]))
    assert got == {1: [("bb", 2), ("aa", 2)], 2: [("a", 1), ("b", 1)]}


def test_stop_words_alone_are_kept(spark):
    rows = spark.createDataFrame([(1, "没有")], "id int, t string")
    assert [r["keyword"] for r in tokens.keywords(rows, "id", "t").collect()] == ["没有"]


def test_hashed_vectors_have_unit_length(spark):
    rows = spark.createDataFrame([(1, "aa aa bb"), (2, "")], "id int, t string")
    got = vectors.hashed_vectors(rows, "id", "t", 64).collect()
    assert len(got) == 1
    bucket = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 64
    want = {bucket("aa"): 2 / math.sqrt(5), bucket("bb"): 1 / math.sqrt(5)}
    assert dict(zip(got[0]["buckets"], (round(x, 12) for x in got[0]["weights"]), strict=True)) == {k: round(v, 12) for k, v in want.items()}


def test_zero_vectors_stay_zero(spark):
    row = spark.createDataFrame([([0.0, 0.0],)], "v array<double>").select(vectors.normalised(F.col("v")).alias("u"), vectors.cosine(F.col("v"), F.col("v")).alias("c")).first()
    assert row["u"] == [0.0, 0.0] and row["c"] == 0.0


def _index(spark, rows):
    return retrieve.dense_as_sparse(spark.createDataFrame(rows, "item long, v array<double>"), "item", "v")


def test_knn_ranks_ties_by_item_and_keeps_the_threshold(spark):
    index = _index(spark, [(i, v) for i, v in [(3, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (4, [1.0, 1.0])]])
    asked = _index(spark, [(9, [1.0, 0.0])]).withColumnRenamed("item", "query")
    got = [(r["item"], r["rank"]) for r in retrieve.knn(asked, index, 3, 2).orderBy("rank").collect()]
    assert got == [(1, 1), (3, 2), (4, 3)]
    assert retrieve.knn(asked, index, 3, 2, 0.8).count() == 2


def test_knn_works_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieve, "BLOCK_CELLS", 4)
    index = _index(spark, [(i, [math.cos(i), math.sin(i)]) for i in range(20)])
    asked = index.withColumnRenamed("item", "query")
    assert [r["item"] for r in retrieve.knn(asked, index, 1, 2).orderBy("query").collect()] == list(range(20))
    assert retrieve.knn(asked.filter("query < 0"), index, 1, 2).count() == 0


def test_best_by_item_equals_limit_before_deduplication(spark):
    hits = spark.createDataFrame([(1, "a", 0.5), (1, "a", 0.9), (1, "b", 0.7), (1, None, 0.6), (1, None, 0.1)], "query_id int, item string, score double")
    got = [(r["item"], r["score"]) for r in retrieve.best_by_item(hits, 2).orderBy("rank").collect()]
    assert got == [("a", 0.9), ("b", 0.7)]
    assert retrieve.best_by_item(hits, 9).count() == 3
