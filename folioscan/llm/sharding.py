"""Sharding by a minimax contiguous partition.

Texts are dealt to hash buckets (equal texts always to one bucket). The buckets are the atomic groups,
ordered by falling size, then by number. The smallest shard capacity that fits them into ``n_shards``
contiguous runs is found by binary search with a greedy check, and the runs are cut there. What
is left after each cut is solved again for the shards that remain, so that a group larger than an
even share leaves the other shards even; it comes first in the order, and the smallest groups, which
make up the differences, come last.

The driver holds one size per bucket, at most ``buckets`` rows whatever the input, and sends one shard
per bucket back. A shard is off its even share by one bucket at most, or by the largest group of equal
texts.

Defined cases: a null text has no bytes, its size is 1 and it goes with the empty texts; a text of any
length counts as a whole; rows that are repeated or share a doc_id get slots of their own; a null
doc_id is a value like any other; an empty table gives no rows; other columns are kept, whatever their
names, but one named as an output is replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, staged

#: Rows that the driver may hold, and how finely shards can be cut.
BUCKETS = 1 << 16


def fits(prefix: np.ndarray, start: int, shards: int, capacity: int) -> bool:
    """Greedy check: do the groups from ``start`` on fit into ``shards`` runs of ``capacity``?"""
    at = start
    for _ in range(shards):
        at = int(np.searchsorted(prefix, prefix[at] + capacity, "right")) - 1
        if at >= len(prefix) - 1:
            return True
    return False


def smallest_capacity(prefix: np.ndarray, start: int, shards: int) -> int:
    sizes = np.diff(prefix[start:])
    if len(sizes) == 0:
        return 0
    rest = int(prefix[-1] - prefix[start])
    low, high = max(int(sizes.max()), -(-rest // shards)), rest
    while low < high:
        middle = (low + high) // 2
        if fits(prefix, start, shards, middle):
            high = middle
        else:
            low = middle + 1
    return low


def cut_points(sizes: np.ndarray, shards: int) -> list[int]:
    """The first group of each shard; groups of ``sizes`` in order, each whole in one shard."""
    prefix = np.concatenate([[0], np.cumsum(np.asarray(sizes, dtype=np.int64))])
    at, cuts = 0, []
    for left in range(shards, 0, -1):
        cuts.append(at)
        capacity = smallest_capacity(prefix, at, left)
        at = max(at, int(np.searchsorted(prefix, prefix[at] + capacity, "right")) - 1)
    return cuts


def shard_of_bucket(weight: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each bucket."""
    order = np.argsort(-weight, kind="stable")
    cuts = np.array(cut_points(weight[order], shards))
    out = np.zeros(len(weight), np.int64)
    out[order] = np.searchsorted(cuts, np.arange(len(order)), "right") - 1
    return out


def placed(rows: DataFrame, names: list[str], n_shards: int, buckets: int = BUCKETS, cells: int = 1024) -> DataFrame:
    """``rows`` with the columns ``names`` (size, text_crc32, bucket, cell of a row; shard and slot, which are added).

    Slots number a shard's rows from 0 without gaps: rows are numbered inside cells of the shard
    dealt by a hash, and each cell starts where the cells before it end.
    """
    spark = rows.sparkSession
    size, crc, bucket, cell, shard, slot, start = names
    weight = np.zeros(buckets, np.int64)
    for r in rows.groupBy(bucket).agg(F.sum(size).alias("n")).collect():
        weight[r[bucket]] = r["n"]
    where = shard_of_bucket(weight, n_shards).tolist()
    met = [(b, where[b]) for b in np.flatnonzero(weight).tolist()]
    rows = rows.join(F.broadcast(spark.createDataFrame(met, f"`{bucket}` int, `{shard}` int")), bucket)  # `buckets` rows at most
    starts, taken = [], [0] * n_shards
    for s, c, n in sorted(tuple(r) for r in rows.groupBy(shard, cell).agg(F.count(F.lit(1)).alias("n")).collect()):
        starts.append((s, c, taken[s]))
        taken[s] += n
    offsets = F.broadcast(spark.createDataFrame(starts, f"`{shard}` int, `{cell}` int, `{start}` long"))  # n_shards x cells rows at most
    window = Window.partitionBy(shard, cell).orderBy("doc_id", crc, size)
    return rows.withColumn(slot, (F.row_number().over(window) - 1).cast("long")).join(offsets, [shard, cell]).withColumn(slot, F.col(start) + F.col(slot))


def keyed(size: Column, crc: Column, buckets: int = BUCKETS, cells: int = 1024) -> tuple[Column, Column]:
    """The bucket, by the text alone, and the cell of a row."""
    return F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(buckets)).cast("int"), F.pmod(F.xxhash64("doc_id", size, crc), F.lit(cells)).cast("int")


def shard_documents(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """The columns of ``docs`` with size, text_crc32, shard and slot."""
    own = [c for c in docs.columns if c not in ("shard", "slot", "size", "text_crc32")]
    docs = docs.select(own)
    names = fresh(own, "size", "text_crc32", "bucket", "cell", "shard", "slot", "start")
    body = F.coalesce(F.col("text"), F.lit(""))
    size, crc = F.octet_length(body).cast("long") + 1, F.crc32(body)
    rows = docs.withColumns(dict(zip(names[:4], (size, crc, *keyed(size, crc)), strict=True)))
    got = placed(rows, names, n_shards)
    return got.select(*own, *(F.col(names[i]).alias(name) for i, name in ((0, "size"), (1, "text_crc32"), (4, "shard"), (5, "slot"))))


def op7_minimax_shards(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, law (``bytes``), shard, slot, grown_shard (null under this law)."""
    names = ["size", "text_crc32", "bucket", "cell", "shard", "slot", "start"]
    body = F.coalesce(F.col("text"), F.lit(""))
    size, crc = F.octet_length(body).cast("long") + 1, F.crc32(body)
    bucket, cell = keyed(size, crc)
    narrow = staged(docs.select("doc_id", size.alias("size"), crc.alias("text_crc32"), bucket.alias("bucket"), cell.alias("cell")), "shards")
    return placed(narrow, names, 8).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
