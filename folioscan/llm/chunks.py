"""Substring deduplication by content-defined chunks.

A gear hash rolls over a text's UTF-8 bytes; its value at a byte depends on the ``WINDOW`` bytes up
to it alone. A chunk ends where ``BITS`` bits of the hash are zero, not before ``LEAST`` bytes and
not after ``MOST``, so an insertion moves the ends near it only and equal passages fall into equal
chunks again. A chunk is known by a 128-bit digest. A chunk that also occurs in a document with a
smaller doc_id is a repeat, and every repeat is removed. A repeated passage goes as far as it is cut
into whole chunks: what lies before its first and behind its last chunk end stays.

A digest's first document is found by a pre-aggregated minimum; occurrences meet the repeated
digests in a join whose hot keys Spark splits, as only one row stands on the other side.

Defined cases: null and empty texts have no chunks; rows with one doc_id are one document, whose rows
don't remove from each other, and each row loses its own repeats only; rows with a null doc_id are
left whole and remove nothing; a text shorter than ``LEAST`` is one chunk; a text of any length is
cut as a whole; repeated rows are cut alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spans as cut
from .bytetext import U64, mix
from .common import staged

WINDOW = 32
LEAST, MOST = 32, 256
BITS = 5
#: Text in a slice, and in one step of hashing.
SLICE, PIECE = 4 << 20, 1 << 20
#: Pseudo-random 32-bit numbers, one for each byte.
GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * U64(0x9E3779B97F4A7C15)) >> U64(32)).astype(np.uint32)
_MASK = np.uint32(((1 << BITS) - 1) << 24)


def gear_hashes(raw: np.ndarray) -> np.ndarray:
    """The gear hash at each byte: sum of GEAR[byte j back] << j over 32 bytes, in five doublings."""
    h = GEAR[raw]
    span = 1
    while span < WINDOW:
        h[span:] = h[span:] + (h[:-span] << np.uint32(span))
        span *= 2
    return h


def boundaries(ends: list[int], size: int) -> list[int]:
    """Chunk ends of a text of ``size`` bytes whose hash allows an end at each of ``ends``."""
    out, at = [], 0
    for end in ends:
        while end - at > MOST:
            at += MOST
            out.append(at)
        if end - at >= LEAST:
            out.append(end)
            at = end
    while size - at > MOST:
        at += MOST
        out.append(at)
    if size > at:
        if out and size - at < LEAST:
            out[-1] = size  # a short rest belongs to the chunk before it
        else:
            out.append(size)
    return out


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for number, blob in zip(batch.column("slice").to_pylist(), batch.column("blob"), strict=True):
            ids, named, offsets, raw = cut.opened(blob.as_py())
            body = raw.tobytes()
            allowed = np.concatenate([np.zeros(0, np.int64), *(np.flatnonzero((gear_hashes(raw[max(0, at - WINDOW) : at + PIECE]) & _MASK)[at - max(0, at - WINDOW) :] == 0) + 1 + at for at in range(0, len(raw), PIECE))])
            edge = np.searchsorted(allowed, offsets, "right")
            owner, begins, ends, digests = [], [], [], []
            for i in np.flatnonzero(named).tolist():
                base, size = int(offsets[i]), int(offsets[i + 1] - offsets[i])
                at = 0
                for e in boundaries((allowed[edge[i] : edge[i + 1]] - base).tolist(), size):
                    owner.append(ids[i])
                    begins.append(base + at)
                    ends.append(base + e)
                    digests.append(hashlib.blake2b(body[base + at : base + e], digest_size=16).digest())
                    at = e
            pairs = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            places = (np.array(begins, np.int64) << 10) | (np.array(ends, np.int64) - np.array(begins, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(owner), number, np.int64)), pa.array(places), pa.array(owner, pa.int64()), pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["slice", "place", "doc_id", "a", "b"])


def _chunk_rows(slices: DataFrame) -> DataFrame:
    """slice, place, doc_id, a, b: the chunks and their digests; a place is begin * 1024 + size, in bytes of the slice."""
    return slices.select("slice", "blob").mapInArrow(_chunked, "slice long, place long, doc_id long, a long, b long")


def chunk_table(docs: DataFrame) -> DataFrame:
    """doc_id, begin, end, a, b: the chunks of each text, as bytes of its slice, and their digests."""
    begin, size = F.shiftright("place", 10), F.col("place").bitwiseAND(1023)
    return _chunk_rows(cut.slice_table(docs, SLICE)).select("doc_id", begin.alias("begin"), (begin + size).alias("end"), "a", "b")


def repeated_spans(chunks: DataFrame) -> DataFrame:
    """slice, place: what is removed."""
    known = chunks.groupBy("a", "b").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("a", "b", "first")
    return chunks.join(known, ["a", "b"]).filter("doc_id > first").select("slice", "place")


def _gone(row: dict):
    whole = cut.opened(row["blob"])
    change = np.zeros(len(whole[3]) + 1, np.int8)  # at most one chunk begins or ends at a byte
    if row["spans"] is not None:
        place = row["spans"].field("place").to_numpy()
        np.add.at(change, place >> 10, 1)
        np.add.at(change, (place >> 10) + (place & 1023), -1)
    return whole, np.cumsum(change[:-1], dtype=np.int32) > 0


def deduplicate(docs: DataFrame, whole_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept: the remaining text, or the SHA-256 of its bytes."""
    slices = cut.slice_table(docs, SLICE)
    spans = repeated_spans(staged(_chunk_rows(slices), "chunks"))
    return cut.reports(cut.by_slice(slices.select("slice", "blob"), spans=spans), _gone, whole_text)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, text of each document without its repeated chunks."""
    return deduplicate(docs).select("doc_id", F.col("kept").alias("text"))


def op8_gear_chunks(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return deduplicate(docs, whole_text=False).withColumnRenamed("kept", "kept_sha256")
