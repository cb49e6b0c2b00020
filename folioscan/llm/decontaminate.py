"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts and benchmark items are folded alike (A-Z lower-cased, words of [0-9a-z] and non-ASCII
characters, one space between words), so that a window of words occurs in a text where its string,
with a space at either end, occurs. The windows of the items are the patterns. A table of shifts,
indexed by a hash of the last ``BLOCK`` bytes before the cursor, tells how far the cursor may jump;
at shift 0, the bucket of that block's hash holds the patterns that may end there, and a direct
comparison decides. Cursors of many text segments move in step, as NumPy arrays.

The benchmark is broadcast in parts of ``PART_BYTES`` of pattern text at most, so that no broadcast
grows with it. A benchmark of one part is met in one pass over the documents, without a shuffle. Of
several parts, each is a pass over the documents, which are numbered once; a pass writes rows for
documents with hits only, and a document's marks meet by its number before anything is counted. Both
ways give the same rows and columns.

Defined cases: null texts have no words; a text of any length is searched as a whole, in time linear
in it and its hits; an item without words has no window; items with a null id take no part; repeated
items count once; repeated documents, and rows that share a doc_id or have none, give a row each, by
their own text; an empty benchmark leaves all documents clean; an empty table gives no rows; other
columns are kept, whatever their names, but ``hits`` replaces one named as one of its outputs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .bytetext import SLICE_BYTES, text_parts
from .common import fresh, numbered, staged

WINDOW = 10
#: Bytes of the block that indexes the shift table; patterns that are shorter use a shorter block.
BLOCK = 8
SHIFT_BITS = 20
#: Pattern text in one broadcast.
PART_BYTES = 32 << 20
SEGMENT = 4096


def _folding() -> bytes:
    table = bytearray(range(256))
    for b in range(128):
        c = chr(b)
        table[b] = ord(c.lower()) if c.isalnum() else 32
    return bytes(table)


FOLDING = _folding()


def folded_words(text: bytes) -> list[bytes]:
    return text.translate(FOLDING).split()


def windows(words: list[bytes], size: int = WINDOW) -> list[bytes]:
    if not words:
        return []
    return [b" " + b" ".join(words[i : i + size]) + b" " for i in range(max(1, len(words) - size + 1))]


class WuManber:
    """Search for byte strings; ``patterns`` are distinct and not empty."""

    def __init__(self, patterns: list[bytes]) -> None:
        self.patterns = patterns
        self.shortest = min(map(len, patterns))
        self.block = min(BLOCK, self.shortest)
        self.shift = np.full(1 << SHIFT_BITS, self.shortest - self.block + 1, np.uint16 if self.shortest < 60000 else np.int64)
        ends = np.cumsum([len(p) for p in patterns])
        body = np.frombuffer(b"".join(patterns) + bytes(8), np.uint8)
        starts = ends - [len(p) for p in patterns]
        # the blocks of each pattern's first `shortest` bytes, the last one at shift 0
        for j in range(self.shortest - self.block + 1):
            np.minimum.at(self.shift, self._key(body, starts + j), self.shortest - self.block - j)
        last = self._key(body, starts + self.shortest - self.block)
        order = np.argsort(last, kind="stable")
        self.bucket_keys, first = np.unique(last[order], return_index=True)
        bounds = np.append(first, len(order))
        self.buckets = {int(k): order[bounds[i] : bounds[i + 1]].tolist() for i, k in enumerate(self.bucket_keys)}

    def _key(self, body: np.ndarray, at: np.ndarray) -> np.ndarray:
        """A hash of the block that starts at each place; ``body`` has 8 spare bytes."""
        view = np.ndarray((len(body) - 7,), "<u8", buffer=body.data if body.flags.c_contiguous else np.ascontiguousarray(body).data, strides=(1,))
        x = view[at] & np.uint64((1 << (8 * self.block)) - 1)
        return ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SHIFT_BITS)).astype(np.int64)

    def find(self, text: bytes) -> Iterator[tuple[int, int]]:
        """(start byte, pattern number) of each occurrence in ``text``."""
        n = len(text)
        if n < self.shortest:
            return
        body = np.frombuffer(text + bytes(8), np.uint8)
        # segment k looks for occurrences whose first `shortest` bytes start in [k, k + 1) segments
        at = np.arange(0, n - self.shortest + 1, SEGMENT, dtype=np.int64)
        stop = np.minimum(at + SEGMENT, n - self.shortest + 1)
        back = self.shortest - self.block
        while len(at):
            key = self._key(body, at + back)
            shift = self.shift[key]
            hit = np.flatnonzero(shift == 0)
            for i, k in zip(at[hit].tolist(), key[hit].tolist(), strict=True):
                for p in self.buckets.get(k, ()):
                    if text.startswith(self.patterns[p], i):
                        yield i, p
            at = at + np.maximum(shift, 1)
            going = at < stop
            at, stop = at[going], stop[going]


def _part(rows: list[tuple[bytes, list[str]]]) -> list[tuple[WuManber, list[list[str]], np.ndarray]]:
    """Searchers with their patterns' items and sizes in words; short patterns apart, so that they don't shorten all jumps."""
    machines = []
    for wanted in (lambda p: len(p) >= 24, lambda p: len(p) < 24):
        own = [(p, ids) for p, ids in rows if wanted(p)]
        if own:
            machines.append((WuManber([p for p, _ in own]), [ids for _, ids in own], np.array([p.count(b" ") - 1 for p, _ in own], np.int64)))
    return machines


def _scan(batches: Iterator[pa.RecordBatch], rows: list[tuple[bytes, list[str]]]) -> Iterator[tuple[pa.RecordBatch, list]]:
    """For each batch: per text its number of words, the marked word runs and the items met."""
    machines = _part(rows)
    for batch in batches:
        raw, offsets = text_parts(batch.column("text"))
        out, first = [], 0
        while first < len(batch):
            end = min(len(batch), max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, "right")) - 1))
            body = raw[offsets[first] : offsets[end]].tobytes()
            parts, counts = [], []
            for i in range(first, end):
                own = folded_words(body[offsets[i] - offsets[first] : offsets[i + 1] - offsets[first]])
                counts.append(len(own))
                parts.append(b" " + b" ".join(own) + b" " if own else b"")
            text = b"\n".join(parts)
            starts = np.cumsum([0] + [len(p) + 1 for p in parts])
            spaces = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)  # one before each word, one at the end
            before = np.searchsorted(spaces, starts[:-1])
            marks: list[list] = [[] for _ in parts]
            items: list[set] = [set() for _ in parts]
            for machine, own, sizes in machines:
                found = list(machine.find(text))
                at, which = np.array([f[0] for f in found], np.int64), np.array([f[1] for f in found], np.int64)
                text_of = np.searchsorted(starts, at, "right") - 1
                begin = np.searchsorted(spaces, at) - before[text_of]
                for k, a, b in zip(text_of.tolist(), begin.tolist(), (begin + sizes[which]).tolist(), strict=True):
                    marks[k].append((a, b))
                for k, p in set(zip(text_of.tolist(), which.tolist(), strict=True)):
                    items[k].update(own[p])
            out += zip(counts, marks, items, strict=True)
            first = end
        yield batch, out


def _runs(marks) -> list[list[int]]:
    runs: list[list[int]] = []
    for a, b in sorted(marks):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    return runs


FIELDS = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
SCHEMA = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _reported(batch: pa.RecordBatch, columns: list, rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    """A batch of some columns with the report on each row's (number of words, runs, items)."""
    told = list(zip(*(_report(*r) for r in rows), strict=True)) or [()] * len(FIELDS)
    return pa.RecordBatch.from_arrays([*columns, *(pa.array(list(c), k) for c, k in zip(told, KINDS, strict=True))], names)


def _report(n: int, runs: list[list[int]], items) -> tuple:
    names = sorted(items)
    return n, sum(b - a for a, b in runs), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(runs)


def pattern_table(benchmark: DataFrame) -> DataFrame:
    """Distinct patterns with their items' ids as strings, sorted: pattern binary, items array<string>."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, patterns = [], []
            for i, t in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for w in windows(folded_words((t or "").encode())):
                    ids.append(i)
                    patterns.append(w)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(patterns, pa.binary())], ["item", "pattern"])

    own = benchmark.filter("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    return own.mapInArrow(cut, "item string, pattern binary").groupBy("pattern").agg(F.sort_array(F.collect_set("item")).alias("items"))


def hits(docs: DataFrame, benchmark: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """The columns of ``docs`` (doc_id, text at least) with n_words, n_hit, n_items, items_sha256, contaminated."""
    spark = docs.sparkSession
    table = staged(pattern_table(benchmark), "patterns")
    total = table.agg(F.sum(F.octet_length("pattern") + F.lit(16) * F.size("items"))).first()[0] or 0
    own = [c for c in docs.columns if c not in FIELDS]
    docs = docs.select(own)
    n_parts = max(1, -(-total // part_bytes))

    def held(k: int):
        part = table.filter(F.pmod(F.xxhash64("pattern"), F.lit(n_parts)) == k)  # about ``part_bytes``
        return spark.sparkContext.broadcast([(bytes(r["pattern"]), r["items"]) for r in part.collect()])

    shape = StructType([*docs.schema.fields, *StructType.fromDDL(SCHEMA).fields])
    if n_parts == 1:
        patterns = held(0)

        def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, found in _scan(batches, patterns.value):
                yield _reported(batch, batch.columns, [(n, _runs(m), i) for n, m, i in found], [*own, *FIELDS])

        return docs.mapInArrow(report, shape)

    row, marks, items = fresh(own, "row", "marks", "items")
    docs = numbered(docs, row, "rows")
    narrow = docs.select(F.col(row).alias("row"), "text")
    passes = []
    for k in range(n_parts):
        patterns = held(k)

        def met(batches: Iterator[pa.RecordBatch], patterns=patterns) -> Iterator[pa.RecordBatch]:
            for batch, found in _scan(batches, patterns.value):
                hit = [(r, _runs(m), sorted(i)) for r, (_, m, i) in zip(batch.column("row").to_pylist(), found, strict=True) if m]
                yield pa.RecordBatch.from_arrays([pa.array([r for r, _, _ in hit], pa.int64()), pa.array([m for _, m, _ in hit], pa.list_(pa.list_(pa.int64()))), pa.array([i for *_, i in hit], pa.list_(pa.string()))], ["row", "marks", "items"])

        passes.append(staged(narrow.mapInArrow(met, "row long, marks array<array<long>>, items array<string>"), "marks"))
        patterns.unpersist()
    united = passes[0]
    for other in passes[1:]:
        united = united.union(other)
    united = united.groupBy(F.col("row").alias(row)).agg(F.flatten(F.collect_list("marks")).alias(marks), F.array_distinct(F.flatten(F.collect_list("items"))).alias(items))
    told = docs.join(united, row, "left").select(*own, marks, items)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_parts(batch.column(own.index("text")))
            body = raw.tobytes()
            sizes = [len(folded_words(body[a:b])) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            columns = batch.columns
            found = zip(sizes, columns[-2].to_pylist(), columns[-1].to_pylist(), strict=True)
            yield _reported(batch, columns[:-2], [(n, _runs(map(tuple, m or ())), i or ()) for n, m, i in found], [*own, *FIELDS])

    return told.mapInArrow(finish, shape)


def op10_wu_manber(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return hits(docs.select("doc_id", "text"), benchmark).drop("text")


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a hit."""
    names = [c if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)]  # the outputs' names are free for them
    clean = hits(docs.toDF(*names), benchmark).filter(~F.col("contaminated"))
    return clean.select(names).toDF(*docs.columns)
