"""Splitting texts into chunks.

``fixed_windows`` and ``line_blocks`` are column expressions. ``recursive_chunks`` follows the full
rule: split at the strongest separator that occurs, go on with weaker ones inside pieces that are
too long, and join short neighbours up to the size with an overlap made of whole pieces. It keeps
state from piece to piece, so it runs in Python, a batch of texts at a time.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Separators from strong to weak; the empty one splits to characters.
SEPARATORS = ("\n\n", "\n", "。", "！", "？", "；", " ", "")


def fixed_windows(text: Column, size: int = 512, overlap: int = 100) -> Column:
    """array<string> of windows of ``size`` characters that start every ``size - overlap``; empty for an empty text."""
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length(text) - size) / step)).cast("int")
    windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * step + 1, F.lit(size)))
    return F.when(F.length(text) > 0, windows).otherwise(F.array().cast("array<string>"))


def line_blocks(text: Column, size: int = 512) -> Column:
    """array<string> of runs of whole lines, joined greedily while they stay within ``size`` characters."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def add(state: Column, line: Column) -> Column:
        joined = F.concat(state["open"], F.lit("\n"), line)
        fits = state["open"].isNotNull() & (F.length(joined) <= size)
        done = F.when(fits | state["open"].isNull(), state["done"]).otherwise(F.concat(state["done"], F.array(state["open"])))
        return F.struct(done.alias("done"), F.when(fits, joined).otherwise(line).alias("open"))

    blocks = F.aggregate(F.split(text, "\n", -1), start, add, lambda s: F.concat(s["done"], F.array(s["open"])))
    return F.filter(blocks, lambda b: F.length(F.trim(b)) > 0)


def _pieces(text: str, separators: tuple[str, ...]) -> tuple[list[str], tuple[str, ...]]:
    """Pieces at the first separator that occurs, which opens the piece behind it, and the separators left."""
    for i, mark in enumerate(separators):
        if mark == "":
            return list(text), ()
        if mark in text:
            head, *tail = text.split(mark)
            return [p for p in (head, *(mark + t for t in tail)) if p], separators[i + 1 :]
    return [text], ()


class _Joiner:
    """Joins pieces to chunks of ``size`` characters at most, each opening with up to ``overlap`` of the one before."""

    def __init__(self, size: int, overlap: int) -> None:
        self.size, self.overlap = size, overlap
        self.held: deque[str] = deque()
        self.length = 0

    def add(self, piece: str) -> Iterator[str]:
        if self.length + len(piece) > self.size and self.held:
            yield "".join(self.held)
            while self.length > self.overlap or (self.length and self.length + len(piece) > self.size):
                self.length -= len(self.held.popleft())
        self.held.append(piece)
        self.length += len(piece)

    def flush(self) -> Iterator[str]:
        if self.held:
            yield "".join(self.held)
        self.held.clear()
        self.length = 0


def split_text(text: str, size: int = 512, overlap: int = 100, separators: tuple[str, ...] = SEPARATORS) -> Iterator[str]:
    """The chunks of a text, stripped, without empty ones."""
    yield from (c for c in (chunk.strip() for chunk in _split(text, size, overlap, separators)) if c)


def _split(text: str, size: int, overlap: int, separators: tuple[str, ...]) -> Iterator[str]:
    pieces, weaker = _pieces(text, separators)
    joiner = _Joiner(size, overlap)
    for piece in pieces:
        if len(piece) < size:
            yield from joiner.add(piece)
            continue
        yield from joiner.flush()
        if weaker:
            yield from _split(piece, size, overlap, weaker)
        else:
            yield piece
    yield from joiner.flush()


def recursive_chunks(rows: DataFrame, keys: list[str], text: str = "text", size: int = 512, overlap: int = 100) -> DataFrame:
    """``keys``, chunk_index, content: a row for each chunk of each text."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, index, content = [], [], []
            for i, t in enumerate(batch.column(text).to_pylist()):
                for k, chunk in enumerate(split_text(t or "", size, overlap)):
                    at.append(i)
                    index.append(k)
                    content.append(chunk)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(take) for k in keys), pa.array(index, pa.int32()), pa.array(content, pa.string())], [*keys, "chunk_index", "content"])

    return rows.select(*keys, text).mapInArrow(run, f"{kinds}, chunk_index int, content string")


def chunk_rows(rows: DataFrame, keys: list[str], chunks: Column) -> DataFrame:
    """``keys``, chunk_index, content from an array of chunks."""
    return rows.select(*keys, F.posexplode(chunks).alias("chunk_index", "content"))


def with_chunk_ids(chunks: DataFrame) -> DataFrame:
    """chunk_id = source, underscore, chunk_index."""
    return chunks.withColumn("chunk_id", F.concat_ws("_", F.col("source").cast("string"), F.col("chunk_index").cast("string")))
