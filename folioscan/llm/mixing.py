"""Mixing sources to target weights by Sainte-Lague apportionment.

Every source has a target in words. The words of the mix are given to the sources one by one, each
to the highest quotient weight / (2 * words + 1), so every quota is an integer and quotas sum to
what is shared. A source's documents in seeded order are one stream of words, cut into equal blocks
(the last one may be shorter); its quota is met by reading the stream in full as often as the quota
allows, then taking blocks in an order given by the seed and the beginning of one block more.

Sizes: a document's size is its number of words. A source's target stops at ``epochs`` times its
size, and what it can't take is shared among the others by weight. A source that stops takes
everything it has ``epochs`` times. Otherwise a word is read ``epochs`` times at most, and so is
a document.

A stream is summed up in shards, and a shard begins where the one before it ends; blocks take no
notice of shards. The driver holds one row per source and shard; the number of shards falls as the
number of sources rises, to ``CELLS`` rows in all (one per source at least).

A stream's order is a hash of the seed and a row's doc_id, size and text, so reruns agree however rows
are dealt.

Defined cases: a null text has no words; null is a source of its own, the last in order; documents
without words take nothing; rows that share a doc_id, and rows without one, are rows of their own,
each with its own place in the stream; rows equal in doc_id and text are interchangeable; a text of any
length is one document, cut by blocks anywhere; an empty table gives no rows; all-empty texts give
targets of 0; other columns are ignored, and ``mixed_documents`` keeps them, whatever their names.
"""

from __future__ import annotations

import heapq
from math import gcd

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, numbered, staged

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code point order, repeated.
WEIGHTS = (5, 2, 1)
EPOCHS = 3
#: Blocks in the whole mix, which set how finely a stream is read, and rows that the driver may hold.
BLOCKS = 1 << 18
CELLS = 1 << 17
SEED = 20240611


def targets(sizes: list[int], weights: list[float], epochs: int = EPOCHS) -> list[float]:
    """Shares of sum(sizes) by weight, none above ``epochs`` times its size."""
    total, out, open_ = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        unit = total / sum(weights[i] for i in open_)
        over = [i for i in open_ if unit * weights[i] > epochs * sizes[i]]
        for i in over:
            out[i] = float(epochs * sizes[i])
            total -= out[i]
            open_.discard(i)
        if not over:
            for i in open_:
                out[i] = unit * weights[i]
            break
    return out


def apportion(weights: list[float], seats: int, limits: list[int]) -> list[int]:
    """Sainte-Lague: each seat to the highest weight / (2 * held + 1) that is below its limit; ties to the earlier."""
    held = _sure(weights, seats, limits)
    heap = [(-w / (2 * held[i] + 1), i) for i, w in enumerate(weights) if w > 0 and held[i] < limits[i]]
    heapq.heapify(heap)
    for _ in range(seats - sum(held)):
        if not heap:
            break
        _, i = heap[0]
        held[i] += 1
        if held[i] < limits[i]:
            heapq.heapreplace(heap, (-weights[i] / (2 * held[i] + 1), i))
        else:
            heapq.heappop(heap)
    return held


def _sure(weights: list[float], seats: int, limits: list[int]) -> list[int]:
    """Seats that each one has in any case: those above a quotient that at most ``seats`` reach, less two for rounding."""
    w, most = np.array(weights, np.float64), np.array(limits, np.int64)
    if not (w > 0).any():
        return [0] * len(weights)

    def above(quotient: float) -> np.ndarray:
        return np.minimum(np.floor((w / quotient + 1) / 2), most).astype(np.int64)

    low, high = float(w.max()) / (2 * seats + 3), 2 * float(w.max())
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (low, middle) if above(middle).sum() <= seats else (middle, high)
    return np.maximum(above(high) - 2, 0).tolist()


def _step(blocks: int, seed: int) -> int:
    """A step that walks through all of 0..blocks-1."""
    step = seed % max(1, blocks) or 1
    while gcd(step, blocks) != 1:
        step += 1
    return step


def _plan(cells: list[tuple], names: list, goal: dict, sizes: dict, seed: int) -> tuple[list[tuple], int]:
    """A row per cell: source, cell, its place in the source's stream, and for the source full readings, blocks of the stream, blocks to take, words of one block more, step, start."""
    block = max(1, sum(sizes.values()) // BLOCKS)
    capped = {s for s in names if goal[s] >= EPOCHS * sizes[s]}
    shared = [s for s in names if s not in capped]
    quota = dict(zip(shared, apportion([goal[s] for s in shared], round(sum(goal[s] for s in shared)), [EPOCHS * sizes[s] for s in shared]), strict=True))
    how = {}
    for k, source in enumerate(names):
        full, rest = (EPOCHS, 0) if source in capped else divmod(quota[source], sizes[source])
        blocks = max(1, -(-sizes[source] // block))
        step, start = _step(blocks, seed + 7919 * k), (seed + k) % blocks
        short = blocks * block - sizes[source]  # what the last block lacks
        turn = ((blocks - 1) * step + start) % blocks
        how[source] = (full, blocks, *divmod(rest if rest < (turn + 1) * block - short else rest + short, block), step, start)
    by_source: dict = {s: [] for s in names}
    for source, cell, words in cells:
        by_source[source].append((cell, words))
    rows = []
    for source, own in by_source.items():
        base = 0
        for cell, words in sorted(own):
            rows.append((source, cell, base, *how[source]))
            base += words
    return rows, block


def _size():
    return F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))).cast("long")


def mix_sources(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken for each document."""
    narrow = staged(docs.select("doc_id", "source", _size().alias("size"), F.xxhash64("text").alias("digest")), "mix")
    return mixed(narrow, seed).drop("source", "digest")


def mixed(narrow: DataFrame, seed: int = SEED) -> DataFrame:
    """Rows of doc_id, source, size, digest (and others) with source_size, target and taken."""
    spark = narrow.sparkSession
    totals = {r["source"]: (r["size"], r["n"]) for r in narrow.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()}
    names = sorted((s for s in totals if s is not None)) + [None] * (None in totals)
    sizes = {s: totals[s][0] for s in names}
    goal = dict(zip(names, targets([sizes[s] for s in names], [WEIGHTS[i % len(WEIGHTS)] for i in range(len(names))]), strict=True))
    rows = sum(n for _, n in totals.values())
    shards = max(1, min(rows // 200, CELLS // max(1, len(names))))
    keyed = narrow.withColumn("_order", F.xxhash64(F.lit(seed), "doc_id", "size", "digest")).withColumn("_cell", F.pmod("_order", F.lit(shards)).cast("int"))
    cells = [(r["source"], r["_cell"], r["size"]) for r in keyed.groupBy("source", "_cell").agg(F.sum("size").alias("size")).collect()]
    plan, block = _plan(cells, names, goal, sizes, seed)
    quotas = spark.createDataFrame([(*row, sizes[row[0]], goal[row[0]]) for row in plan], "q_source string, q_cell int, base long, full long, blocks long, extra long, part long, step long, start long, source_size long, target double")
    window = Window.partitionBy("source", "_cell").orderBy("_order", "doc_id", "size", "digest").rowsBetween(Window.unboundedPreceding, 0)
    streamed = keyed.withColumn("_end", F.sum("size").over(window)).join(quotas, F.col("source").eqNullSafe(F.col("q_source")) & (F.col("_cell") == F.col("q_cell")))
    end = F.col("base") + F.col("_end")
    begin = end - F.col("size")
    first, last = F.floor(begin / block).cast("long"), F.floor((end - 1) / block).cast("long")

    def read(total, j):
        turn = F.pmod(j * F.col("step") + F.col("start"), F.col("blocks"))
        words = F.when(turn < F.col("extra"), F.lit(block)).when(turn == F.col("extra"), F.col("part")).otherwise(0)
        return total + F.greatest(F.lit(0), F.least(end, j * block + words) - F.greatest(begin, j * block))

    picked = F.when((F.col("size") > 0) & (F.col("extra") + F.col("part") > 0), F.aggregate(F.sequence(first, last), F.lit(0).cast("long"), read)).otherwise(F.lit(0))
    taken = (F.col("full") * F.col("size") + picked).cast("long")
    return streamed.select(*narrow.columns, "source_size", "target", taken.alias("taken"))


def op9_sainte_lague(docs: DataFrame) -> DataFrame:
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``docs`` as the mix has them: whole documents, repeated up to ``EPOCHS`` times.

    A row appears floor(taken / size) times, once more with the probability of the remainder,
    drawn from the seed and the row's doc_id and text. Rows without words are not mixed and go.
    """
    row, times = fresh(docs.columns, "row", "times")
    rows = numbered(docs, row, "rows")
    narrow = staged(rows.select(F.col(row).alias("row"), "doc_id", "source", _size().alias("size"), F.xxhash64("text").alias("digest")), "mix")
    draw = F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "digest"), F.lit(1 << 20)) / F.lit(1 << 20)
    often = F.floor(F.col("taken") / F.col("size") + draw).cast("int")
    told = mixed(narrow, seed).filter("taken > 0").select(F.col("row").alias(row), often.alias(times)).filter(F.col(times) > 0)
    return rows.join(told, row).withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).select(docs.columns)
