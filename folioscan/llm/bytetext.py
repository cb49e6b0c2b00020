"""Vectorised kernels over the UTF-8 bytes of an Arrow string column.

A batch's texts lie one after another in one buffer, so words, hashes and shingles of thousands of
texts come from a few NumPy passes. Work goes in slices of a few MB of text, which bounds memory
whatever a batch holds; one text longer than a slice is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

SLICE_BYTES = 2 << 20

U64 = np.uint64
_GOLD = 0x9E3779B97F4A7C15
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _word_bytes() -> np.ndarray:
    """Byte -> its folded word byte: a-z, 0-9, bytes of non-ASCII characters; 0 elsewhere."""
    fold = np.arange(256, dtype=np.uint8)
    fold[ord("A") : ord("Z") + 1] += 32
    keep = np.zeros(256, bool)
    keep[ord("a") : ord("z") + 1] = keep[ord("A") : ord("Z") + 1] = keep[ord("0") : ord("9") + 1] = True
    keep[128:] = True
    fold[~keep] = 0
    return fold


FOLD = _word_bytes()
_BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * U64(_GOLD))


def text_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str = "text", budget: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about ``budget`` bytes of text."""
    raw, offsets = text_parts(batch.column(batch.schema.get_field_index(column)))
    n, first = len(offsets) - 1, 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + budget, "right")) - 1
        end = min(n, max(end, first + 1))
        yield first, end, raw[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers as one compressed string."""
    bodies = [a.tobytes() for a in arrays]
    return zstandard.compress(np.array([len(b) for b in bodies], np.int64).tobytes() + b"".join(bodies), 1)


def unpacked(blob: bytes, *kinds) -> list[np.ndarray]:
    raw = zstandard.decompress(blob)
    out, at = [], 8 * len(kinds)
    for kind, size in zip(kinds, np.frombuffer(raw, np.int64, len(kinds)).tolist(), strict=True):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def sliced(batches: Iterator[pa.RecordBatch], first_number: int, budget: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(number, bytes, ids, whether an id is there, offsets, raw) of runs of rows (doc_id, text) with about ``budget`` bytes of text.

    Rows are gathered across batches; one text longer than the budget is a run of its own.
    """
    held: list[tuple] = []
    size = rows = 0

    def run():
        raw = np.concatenate([h[3] for h in held])
        sizes = np.concatenate([np.diff(h[2]) for h in held])
        return len(raw), np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), raw

    number = first_number
    for batch in batches:
        column = batch.column("doc_id")
        named = column.is_valid().to_numpy(zero_copy_only=False)
        ids = column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for first, end, raw, offsets in slices(batch, budget=budget // 4):
            if held and (size + len(raw) > budget or rows > budget // 64):
                yield number, *run()
                number += 1
                held, size, rows = [], 0, 0
            held.append((ids[first:end], named[first:end], offsets, raw.copy()))
            size += len(raw)
            rows += end - first
    if held:
        yield number, *run()


def _powers(base: int, n: int) -> np.ndarray:
    def run(factor: int, length: int) -> np.ndarray:
        out = np.full(length, factor, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    return (run(pow(base, 4096, 1 << 64), n // 4096 + 1)[:, None] * run(base, 4096)[None, :]).ravel()[:n]


_cache: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    if base not in _cache or len(_cache[base]) < n:
        _cache[base] = _powers(base, 1 << max(16, n.bit_length()))
    return _cache[base][:n]


def span_hashes(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of codes[start:end] for each span, whatever its place."""
    n = len(codes)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(codes * powers(_BASE, n), out=total[1:])
    back = powers(_INVERSE, n + 1)[start]
    length = (end - start).astype(np.uint64)
    return mix((total[end] - total[start]) * back + length * U64(_GOLD))


def edges(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true bytes that stay inside one text: (text index, start, end)."""
    n = len(member)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    first, last = member.copy(), member.copy()
    first[1:] &= ~member[:-1]
    last[:-1] &= ~member[1:]
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[begins] = member[begins]
    last[begins[1:] - 1] = member[begins[1:] - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return np.searchsorted(offsets, start, "right") - 1, start, end


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Folded words of each text: (text index, start byte, end byte, 64-bit hash)."""
    folded = FOLD[raw]
    text, start, end = edges(folded != 0, offsets)
    return text, start, end, span_hashes(_BYTE_CODE[folded], start, end)


def shingles(raw: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text index, 64-bit hash) of each window of ``size`` words; a text of fewer, but not none, is one window."""
    text, _, _, hashes = words(raw, offsets)
    n = len(text)
    count = np.bincount(text, minlength=len(offsets) - 1) if n else np.zeros(len(offsets) - 1, np.int64)
    if n == 0:
        return text, hashes
    acc = np.zeros(n, np.uint64)
    factor = 1
    short = count[text] < size
    room = np.cumsum(count)[text] - np.arange(n)  # words from here to the text's end
    for k in range(size):
        term = np.zeros(n, np.uint64)
        term[: n - k] = hashes[k:]
        term[room <= k] = 0
        acc += term * U64(factor)
        factor = factor * _BASE % (1 << 64)
    first = np.zeros(n, bool)
    first[np.cumsum(count)[count > 0] - count[count > 0]] = True
    keep = (room >= size) | (short & first)
    return text[keep], mix(acc[keep] + U64(_GOLD))


def expanded(text: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct (text, hash) with multiplicities."""
    order = np.lexsort((hashes, text))
    text, hashes = text[order], hashes[order]
    if len(text) == 0:
        return text, hashes, np.zeros(0, np.int64)
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(new)
    return text[at], hashes[at], np.diff(np.append(at, len(text)))
