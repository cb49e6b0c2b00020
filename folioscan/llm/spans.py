"""Texts in numbered slices, and cutting byte spans out of them; shared by the substring operators.

A slice is a run of rows: their doc_ids and texts, packed. A row is known by its slice and its place
in it, so rows that share a doc_id, and rows without one, stay apart. What is to be cut is gathered by
slice, whose size is bounded, and never by doc_id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import packed, sliced, unpacked
from .common import staged, tasks

REPORT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept string"


def slice_table(docs: DataFrame, budget: int) -> DataFrame:
    """slice, size, blob: the rows of ``docs`` in slices of about ``budget`` bytes of text, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, size, *arrays in sliced(batches, TaskContext.get().partitionId() << 32, budget):
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([size], pa.int64()), pa.array([packed(*arrays)], pa.binary())], ["slice", "size", "blob"])

    return staged(docs.select("doc_id", "text").mapInArrow(run, "slice long, size long, blob binary"), "slices")


def opened(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, whether an id is there, offsets, raw) of a slice."""
    return tuple(unpacked(blob, np.int64, np.bool_, np.int64, np.uint8))


def by_slice(slices: DataFrame, **rows: DataFrame) -> DataFrame:
    """``slices`` with a list for each of ``rows`` (slice, other columns): its rows of the slice, as structs.

    The number of tasks follows the number of slices.
    """
    n = tasks(slices.count())
    out = slices.repartition(n, "slice")
    for name, own in rows.items():
        fields = F.struct(*(c for c in own.columns if c != "slice"))
        out = out.join(own.repartition(n, "slice").groupBy("slice").agg(F.collect_list(fields).alias(name)), "slice", "left")
    return out


def kept_bytes(text: bytes, spans) -> bytes:
    at, parts = 0, []
    for begin, end in spans:
        parts.append(text[at:begin])
        at = end
    parts.append(text[at:])
    return b"".join(parts)


def _value(cell: pa.Scalar):
    return cell.values if isinstance(cell, pa.ListScalar) else cell.as_py()


def reports(rows: DataFrame, gone: Callable, whole_text: bool) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept of every row of the slices.

    ``gone`` gives for a row of ``rows`` (a dict with the slice's blob, arrays as Arrow arrays) the
    opened slice and a mask of the bytes that go. kept is the remaining text, with U+FFFD for bytes that no longer form a
    character, or the SHA-256 of the remaining bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                (ids, named, offsets, raw), mask = gone({name: _value(column[k]) for name, column in zip(batch.schema.names, batch.columns, strict=True)})
                body, out = raw.tobytes(), []
                for i in range(len(ids)):
                    a, b = int(offsets[i]), int(offsets[i + 1])
                    edge = np.flatnonzero(np.diff(mask[a:b].view(np.int8), prepend=0, append=0)).tolist() if b > a else []
                    cuts = list(zip(edge[::2], edge[1::2], strict=True))
                    kept = kept_bytes(body[a:b], cuts)
                    out.append((int(ids[i]) if named[i] else None, b - a, b - a - len(kept), len(cuts), kept.decode("utf-8", "replace") if whole_text else hashlib.sha256(kept).hexdigest()))
                columns = list(zip(*out, strict=True)) or [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return rows.mapInArrow(run, REPORT)
