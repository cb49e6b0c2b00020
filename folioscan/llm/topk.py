"""Exact top-k inner products by norm order, SVD rotation and Cauchy-Schwarz bounds.

Components become integers, floor(256 * x). The vectors are rotated by the right singular vectors
of the whole table, whose Gram matrix is summed over all rows, so that a few leading coordinates
carry most of a product. Candidates lie in parts of falling length; a part is read block by block.
A block is given up when its longest vector times the query's length can't reach the query's k-th
best score. Inside a block, the leading coordinates give a partial product, and the lengths of the
rests bound what is missing (Cauchy-Schwarz); where few candidates fall out, half of all coordinates
bound them closer. Only candidates whose bound reaches the k-th best are multiplied out, in integers;
a step in which most do is multiplied out as a matrix, in doubles that hold these integers exactly. The first k-th best scores come from the longest vectors.

Search. Every query first meets one blob of the longest vectors, which gives its k-th best score so
far, and so the length that a vector must have to be of use to it. Queries are put in the order of
that need and taken in groups of ``GROUP_BYTES``. A group is broadcast, and the parts of candidates
long enough for one of its queries are read, once, where they lie; nothing is shuffled but the k best
of each query and task. A task raises its queries' k-th best scores from part to part. This is the
stated query set against all rows, in blocks.

Defined cases: vectors that are null or hold a null, NaN or infinity take no part; shorter vectors
count as filled up with zeros; rows equal in id and vector count once; of rows that share an id but
not the vector each is a candidate and, where the id is a query's, a query with ranks of its own, for
which the other ones are candidates; rows with a null id take no part; fewer than k candidates give
fewer ranks; ties go to the smaller id; an empty table gives no rows; other columns are ignored.
Vectors so long that a product could leave 64 bits raise an error before anything is searched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, partitions, staged

K = 5
SCALE = 256
QUERY_STEP = 50
#: Queries in one step of the search, and bytes of the vectors of one broadcast group.
QUERY_BLOCK = 2048
GROUP_BYTES = 32 << 20
#: Candidates in one blob, and in one step of the search.
PART = 4096
STEP = 512
#: Leading coordinates of the first partial product, and allowance for rounding in the bounds.
LEAD = 16
SLACK = 1e-6
#: Share of a step's pairs from which on the bounds are drawn closer, and then all its pairs multiplied out.
MANY = 0.02


def whole_vectors(rows: DataFrame) -> DataFrame:
    """vec_id, v array<long>, norm of the vectors that take part."""
    fine = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("x")).filter("vec_id is not null and x is not null")
    fine = fine.filter(F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    v = F.transform("x", lambda x: F.floor(x * SCALE).cast("long"))
    return fine.distinct().select("vec_id", v.alias("v")).withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)))


def _stack(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), dim), np.int64)
    out[np.repeat(np.arange(len(column)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _grams(dim: int):
    """Rows of this task's Gram matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            x = _stack(batch.column("v"), dim).astype(np.float64)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), pa.array([row.tobytes() for row in total], pa.binary())], ["i", "g"])

    return run


def _summed(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(g.as_py()) for g in table.column("g"))
    return pa.table({"i": table.column("i").slice(0, 1), "g": pa.array([total.tobytes()], pa.binary())})


def rotation(vectors: DataFrame, dim: int) -> np.ndarray:
    """The right singular vectors of the table, strongest first; dim x dim numbers reach the driver."""
    gram = np.zeros((dim, dim))
    for r in vectors.select("v").mapInArrow(_grams(dim), "i int, g binary").groupBy("i").applyInArrow(_summed, "i int, g binary").collect():
        gram[r["i"]] = np.frombuffer(r["g"])
    _, basis = np.linalg.eigh((gram + gram.T) / 2)
    return np.ascontiguousarray(basis[:, ::-1])


class _Best:
    """The k best (score, id) of each query so far, and what a candidate has to reach: a higher score, or the same and a smaller id."""

    def __init__(self, floor: np.ndarray, limit: np.ndarray, k: int) -> None:
        self.k, self.rows, self.floor, self.limit = k, [[] for _ in floor], floor.copy(), limit.copy()

    @classmethod
    def of(cls, n: int, k: int) -> _Best:
        return cls(np.full(n, -np.inf), np.full(n, np.iinfo(np.int64).max), k)

    def offer(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        rows = self.rows[q]
        rows += zip((-scores).tolist(), ids.tolist(), strict=True)
        rows.sort()
        del rows[self.k :]
        if len(rows) == self.k and (-rows[-1][0], -rows[-1][1]) > (self.floor[q], -self.limit[q]):
            self.floor[q], self.limit[q] = -rows[-1][0], rows[-1][1]


class Vectors:
    """Rows, ids, integer vectors and their rotated form, by falling length."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, v: np.ndarray, basis: np.ndarray) -> None:
        turned = v @ basis
        length = np.sqrt((turned**2).sum(axis=1))
        order = np.argsort(-length, kind="stable")
        self.rows, self.ids, self.v, self.turned, self.length = rows[order], ids[order], v[order], turned[order], length[order]
        self.exact = self.v.astype(np.float64)
        self.leads = sorted({min(LEAD, v.shape[1]), v.shape[1] // 2} - {0})
        self.rests = [np.sqrt((self.turned[:, lead:] ** 2).sum(axis=1)) for lead in self.leads]


def _may_reach(q: Vectors, open_: np.ndarray, c: Vectors, own: slice, need: np.ndarray) -> np.ndarray:
    """Which pairs' partial products and bounds of the rests reach ``need``; more coordinates where few pairs fall out."""
    partial, done, fits = 0.0, 0, None
    for lead, q_rest, c_rest in zip(q.leads, q.rests, c.rests, strict=True):
        partial = partial + q.turned[open_, done:lead] @ c.turned[own, done:lead].T
        bound = np.multiply.outer(q_rest[open_], c_rest[own])
        bound += partial
        fits, done = bound >= need[:, None], lead
        if np.count_nonzero(fits) <= MANY * fits.size:
            break
    return fits


def search(queries: Vectors, candidates: Vectors, best: _Best) -> None:
    """Offer ``best`` every candidate that may be among the k best of a query."""
    q, c = queries, candidates
    for block in range(0, len(q.ids), QUERY_BLOCK):
        asked = np.arange(block, min(len(q.ids), block + QUERY_BLOCK))
        for at in range(0, len(c.ids), STEP):
            own = slice(at, min(len(c.ids), at + STEP))
            reach = q.length[asked] * c.length[at]
            open_ = asked[reach + SLACK * (1 + reach) >= best.floor[asked]]
            if not len(open_):
                break
            reach = q.length[open_] * c.length[at]
            fits = _may_reach(q, open_, c, own, best.floor[open_] - SLACK * (1 + reach))
            if np.count_nonzero(fits) > MANY * fits.size and reach.max() < 1 << 52:
                whole = q.exact[open_] @ c.exact[own].T  # integers that doubles hold
                row, col = np.nonzero(fits & (whole >= best.floor[open_][:, None]))
                score = whole[row, col].astype(np.int64)
            else:
                row, col = np.nonzero(fits)
                score = np.einsum("ij,ij->i", q.v[open_[row]], c.v[at + col])
            ids, floor = c.ids[at + col], best.floor[open_[row]]
            good = (score > floor) | ((score == floor) & (ids <= best.limit[open_[row]]))  # rows that share an id and a score are told apart by none
            good &= q.rows[open_[row]] != c.rows[at + col]
            row, score, ids = row[good], score[good], ids[good]
            edge = np.searchsorted(row, np.arange(len(open_) + 1))
            for i in np.flatnonzero(edge[1:] > edge[:-1]).tolist():
                part = slice(edge[i], edge[i + 1])
                best.offer(int(open_[i]), ids[part], score[part])


BLOB = "rows binary, ids binary, vectors binary, longest double"


def _blobs(dim: int, size: int):
    """Rows of row, vec_id, v, norm gathered to blobs of ``size`` rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), size):
                part = batch.slice(at, size)
                rows, ids = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("row", "vec_id"))
                longest = float(np.max(part.column("norm").to_numpy(zero_copy_only=False), initial=0.0))
                yield pa.RecordBatch.from_arrays([*(pa.array([x.tobytes()], pa.binary()) for x in (rows, ids, _stack(part.column("v"), dim))), pa.array([longest])], ["rows", "ids", "vectors", "longest"])

    return run


def _unblob(rows: bytes, ids: bytes, vectors: bytes, basis: np.ndarray) -> Vectors:
    rows, ids = np.frombuffer(rows, np.int64), np.frombuffer(ids, np.int64)
    return Vectors(rows, ids, np.frombuffer(vectors, np.int64).reshape(len(ids), -1), basis)


def _needs(held, basis: np.ndarray, dim: int, k: int):
    """Queries with their k-th best score among the longest vectors, and the length that a better one has at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longest = _unblob(*held.value, basis)
        for batch in batches:
            n = len(batch)
            queries = Vectors(batch.column("row").to_numpy(), np.arange(n), _stack(batch.column("v"), dim), basis)
            best = _Best.of(n, k)
            search(queries, longest, best)
            floor, need, limit = np.empty(n), np.empty(n), np.empty(n, np.int64)
            floor[queries.ids], limit[queries.ids] = best.floor, best.limit
            need[queries.ids] = np.where(best.floor > 0, best.floor / np.maximum(queries.length, 1e-300), 0.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "vec_id", "v", "norm")), pa.array(floor), pa.array(limit), pa.array(need)], ["row", "vec_id", "v", "norm", "floor", "limit", "need"])

    return run


def _searched(held, basis: np.ndarray, k: int):
    """The k best of this task's parts for each query of a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, ids, v, floor, limit = held.value
        queries = Vectors(rows, ids, v, basis)
        order = np.argsort(rows)
        own = order[np.searchsorted(rows[order], queries.rows)]
        best = _Best(floor[own], limit[own], k)
        for batch in batches:
            for i in range(len(batch)):
                search(queries, _unblob(*(batch.column(c)[i].as_py() for c in ("rows", "ids", "vectors")), basis), best)
        flat = [(int(r), int(q), i, -s) for r, q, own in zip(queries.rows, queries.ids, best.rows, strict=True) for s, i in own]
        yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in flat], pa.int64()) for n in range(4)], ["row", "query_id", "vec_id", "score"])

    return run


def top_k(rows: DataFrame, k: int = K, query_step: int = QUERY_STEP, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each row whose id ``query_step`` divides."""
    spark = rows.sparkSession
    vectors = numbered(whole_vectors(rows), "row", "vectors")
    dim, norm = vectors.agg(F.max(F.size("v")), F.max("norm")).first()
    if norm is not None and norm * norm >= float(1 << 62):
        raise ArithmeticError(f"a vector of length {norm:.3g} in steps of 1/{SCALE} has products that may leave 64 bits")
    dim = max(1, dim or 1)
    basis = rotation(vectors, dim)
    ordered = vectors.repartitionByRange(partitions(spark), F.desc("norm"), "row")  # rows spread equal lengths
    parts = staged(ordered.select("row", "vec_id", "v", "norm").mapInArrow(_blobs(dim, PART), BLOB), "parts")
    longest = parts.orderBy(F.desc("longest"), "rows").select("rows", "ids", "vectors").first()  # one blob, PART rows at most
    found = []
    if longest:
        held = spark.sparkContext.broadcast(tuple(map(bytes, longest)))
        asked = vectors.filter(F.col("vec_id") % query_step == 0).select("row", "vec_id", "v", "norm")
        asked = staged(asked.mapInArrow(_needs(held, basis, dim, k), "row long, vec_id long, v array<long>, norm double, floor double, limit long, need double"), "asked")
        held.unpersist()
        room = max(1, group_bytes // (8 * dim))
        ranged = asked.repartitionByRange(max(1, -(-asked.count() * 2 // room)), "need", "row")  # ranges of half a group, about
        asked = staged(ranged.withColumn("range", F.spark_partition_id()), "ranges")
        for first, last, need in _groups(asked, room):
            own = asked.filter(F.col("range").between(first, last)).toPandas()
            v = np.zeros((len(own), dim), np.int64)
            for i, x in enumerate(own["v"]):
                v[i, : len(x)] = x
            group = spark.sparkContext.broadcast((own["row"].to_numpy(), own["vec_id"].to_numpy(), v, own["floor"].to_numpy(), own["limit"].to_numpy()))
            reached = parts.filter(F.col("longest") * (1 + SLACK) + SLACK >= F.lit(need))
            found.append(staged(reached.mapInArrow(_searched(group, basis, k), "row long, query_id long, vec_id long, score long"), "found"))
            group.unpersist()
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    united = found[0]
    for other in found[1:]:
        united = united.union(other)
    window = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return united.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _groups(asked: DataFrame, room: int) -> list[tuple[int, int, float]]:
    """(first range, last range, least need) of runs of ranges with about ``room`` queries; the driver holds a row for each range."""
    out: list[list] = []
    held = 0
    for r in asked.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.min("need").alias("need")).orderBy("range").collect():
        if out and held + r["n"] <= room:
            out[-1][1], held = r["range"], held + r["n"]
        else:
            out.append([r["range"], r["range"], r["need"]])
            held = r["n"]
    return [tuple(x) for x in out]


def op1_norm_sorted_topk(embeddings: DataFrame) -> DataFrame:
    return top_k(embeddings)


ORACLE = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), w AS (SELECT row_number() OVER (ORDER BY vec_id, x) AS r, vec_id, list_transform(x, lambda e: floor(256 * e)::BIGINT) AS v FROM v),
p AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id AS vec_id,
         list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM w q JOIN w c ON q.r <> c.r
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM p
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
