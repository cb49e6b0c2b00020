"""The search within buckets against a plain version: hashes by Spark's model, every pair that shares a bucket scored."""

import numpy as np
import pytest
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.linalg import Vectors

from folioscan.operators import buckets, retrieve
from folioscan.plans import catalogue

K, STEP, DIM = 5, 50, 8
SHAPE = "vec_id long, embedding array<float>"


def drawn(n, seed=1):
    return np.random.default_rng(seed).standard_normal((n, DIM)).astype(np.float32)


def plain(spark, rows):
    """{query: [(item, score)]} of rows whose ids differ, and the questions that share a bucket with fewer than K rows."""
    ids = [i for i, _ in rows]
    v = np.array([[*x, *[0] * (DIM - len(x))] for _, x in rows], float)
    unit = v / np.maximum(np.linalg.norm(v, axis=1), 1e-10)[:, None]
    frame = spark.createDataFrame([(i, Vectors.dense(x)) for i, x in zip(ids, unit.tolist(), strict=True)], ["id", "features"])
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=1.0, numHashTables=4, seed=7).fit(frame)
    found = {r["id"]: [h[0] for h in r["hashes"]] for r in model.transform(frame).select("id", "hashes").collect()}
    hashes = np.array([found[i] for i in ids])
    out, alone = {}, set()
    for q, i in enumerate(ids):
        if i % STEP == 0:
            share = (hashes == hashes[q]).any(axis=1)
            if share.sum() < K:
                alone.add(i)
                share[:] = True
            score = np.round(unit @ unit[q], 9) + 0.0
            best = sorted((-score[j], ids[j]) for j in np.flatnonzero(share))[:K]
            out[i] = [(item, pytest.approx(-s, abs=2e-9)) for s, item in best]
    return out, alone


def searched(spark, rows):
    got = {}
    near = buckets.near(spark.createDataFrame(rows, SHAPE).repartition(3), "vec_id", "embedding", STEP, K).collect()
    for r in sorted(near, key=lambda r: (r["query"], r["rank"])):
        got.setdefault(r["query"], []).append((r["item"], r["score"]))
        assert r["rank"] == len(got[r["query"]])
    return got


def table(spark, tmp_path, rows):
    spark.createDataFrame(rows, SHAPE).write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


@pytest.mark.parametrize(("cells", "tile"), [(None, None), (DIM * 3, 7)])
def test_equals_the_plain_version(spark, monkeypatch, cells, tile):
    rows = [(i, x.tolist()) for i, x in enumerate(drawn(400))]
    rows += [(1000 + i, rows[50][1]) for i in range(120)]  # copies of a question, among them questions
    rows += [(2000, [0.0] * DIM), (2001, [0.0] * DIM), (2050, rows[3][1][:5]), (-50, rows[4][1]), (2051, [])]
    want, _ = plain(spark, rows)
    if cells:
        monkeypatch.setattr(retrieve, "BLOCK_CELLS", cells)
        monkeypatch.setattr(buckets, "TILE", tile)
    assert searched(spark, rows) == want


def test_questions_that_share_a_bucket_with_few_rows_meet_all(spark):
    x = drawn(1, 3)[0]
    rows = [(0, x.tolist()), *((i, (-x * i).tolist()) for i in range(1, 5)), (5, (-x).tolist()), (6, x.tolist())]
    want, alone = plain(spark, rows)
    assert alone == {0}
    assert searched(spark, rows) == want and [item for item, _ in want[0]] == [0, 6, 1, 2, 3]


def test_rows_that_take_no_part(spark):
    fine = [(i, x.tolist()) for i, x in enumerate(drawn(80))]
    bad = [(100, None), (101, [float("nan")] * DIM), (150, [float("inf"), *[1.0] * (DIM - 1)]), (102, [None, *[1.0] * (DIM - 1)]), (None, fine[0][1])]
    assert searched(spark, fine + bad) == plain(spark, fine)[0]
    assert searched(spark, bad) == {} and searched(spark, []) == {}


def test_repeated_rows_count_as_in_the_exact_search(spark, tmp_path):
    data = table(spark, tmp_path, [(i % 3, [1.0, 0.5]) for i in range(9)])
    got = [sorted(map(tuple, f(spark, data).select("query_id", "rank", "vec_id").collect())) for f in (catalogue.lsh_topk, catalogue.knn_topk)]
    assert got[0] == got[1] and len(got[0]) == K


def test_vectors_of_zeros_score_zero(spark, tmp_path):
    data = table(spark, tmp_path, [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [0.8, 0.6])])
    got = {(r["vec_id"], r["score"]) for r in catalogue.lsh_topk(spark, data).collect()}
    assert got == {(0, 1.0), (2, 0.8), (1, 0.0)}


def test_no_row_for_each_pair(spark, tmp_path):
    """Only the k best of each question and task leave a task, however many rows share a bucket."""
    data = table(spark, tmp_path, [(i, [1.0, 0.25 * (i % 2)]) for i in range(5000)])
    found = catalogue.lsh_topk(spark, data)
    assert found.count() == 100 * K
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan and "MapInArrow" in plan
