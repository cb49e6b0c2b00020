"""Substring deduplication by a distributed, common-prefix-aware merge sort of suffixes.

A byte goes if a ``MATCH``-byte string that covers it also starts in a document with a smaller
doc_id. Equal strings have to be brought together, and sorting suffixes does that.

Which suffixes. Every window of ``MATCH`` bytes is assigned to the suffix that starts at its
smallest hashed ``PREFIX``-byte string (the leftmost on ties), so equal windows are assigned to
equal suffixes at equal places; one suffix stands for about 14 windows. Its entry holds the bytes
from the suffix's start to the end of its last window, then the bytes before it that its windows
cover. Suffixes whose first ``PREFIX`` bytes occur in one document only can't match and are not
exchanged: slices of the corpus exchange 4-byte fingerprints of their prefixes, dealt by hash, and
get one bit back for each.

Common prefixes. A suffix start that has many entries with different surroundings (over ``HOT``, told
from the numbers and a few bits that come with the fingerprints) would make one huge group. Its
windows go as entries of their own instead, dealt by the hash of the whole window, after a second
exchange of fingerprints has dropped those of one document. So no group grows with the corpus but by
windows that are equal, which each slice sends once.

Merge sort. Each slice sorts its distinct entries and sends each part of the hash space one run,
front-coded (length of the prefix shared with the entry before, and the rest). A loser tree merges
the runs of a part; it compares lengths of known common prefixes first and bytes only behind them.
Neighbours with the same suffix start are then settled: entries that are equal as a whole share
their smallest doc_id; where a suffix start has several entries, window by window. The answers go
back to the slices, one number for each entry and more only where its windows differ.

A slice sends an entry once, however often it occurs there, so a passage that very many documents
share costs a row for each slice. Parts are even since they are dealt by hash, and a part is a task.
Slices are written to the shared folder; all later steps read them, so a lost executor repeats only
its own step.

Defined cases: null texts are empty; texts under ``MATCH`` bytes lose nothing; a text longer than a
slice is a slice of its own; rows with one doc_id are one document, none of them removes from another;
rows with a null doc_id are left whole and remove nothing; repeated rows are cut alike; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from .bytetext import _BASE, _BYTE_CODE, U64, mix, packed, unpacked
from .common import staged, tasks
from .spans import by_slice, opened, reports, slice_table

MATCH = 50
PREFIX = 24
SPREAD = MATCH - PREFIX + 1  # prefixes in a window
PIECE = 1 << 16
#: Text in a slice; each slice sorts its own suffixes and sends a run to each part.
SLICE = 8 << 20
#: Prefixes in a part, about, up to a GB of text; parts grow with the root of the text beyond, so that runs don't get too short, up to the other number.
PART_PREFIXES, MOST_PREFIXES = 250_000, 4_000_000
#: Entries of one suffix start, from which on its windows go one by one.
HOT = 1 << 15
_PLACE = U64((1 << 24) - 1)


def prefix_hashes(raw: np.ndarray) -> np.ndarray:
    """The hash of the PREFIX bytes from each place, by doubling."""
    h, size, eight = _BYTE_CODE[raw], 1, None
    while size < 16:
        h = h[:-size] * U64(pow(_BASE, size, 1 << 64)) + h[size:]
        size *= 2
        if size == 8:
            eight = h
    return mix(h[: len(raw) - PREFIX + 1] * U64(pow(_BASE, 8, 1 << 64)) + eight[16:])


def suffix_starts(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, suffix start, prefix hash) of each suffix that windows are assigned to."""
    found: list[list[np.ndarray]] = [[], [], [], []]
    long_texts = np.flatnonzero(np.diff(offsets) >= MATCH)
    opens, closes = offsets[long_texts], offsets[long_texts + 1] - MATCH + 1  # windows that lie in one text
    for base in range(0, max(0, len(raw) - MATCH + 1), PIECE):
        part = raw[base : base + PIECE + MATCH - 1]
        n = len(part) - MATCH + 1
        own = slice(np.searchsorted(closes, base, "right"), np.searchsorted(opens, base + n))
        inside = np.zeros(n + 1, np.int32)
        np.add.at(inside, np.maximum(opens[own] - base, 0), 1)
        np.add.at(inside, np.minimum(closes[own] - base, n), -1)
        valid = np.cumsum(inside[:-1]) > 0
        last_of_text = np.zeros(n, bool)
        ends = closes[own] - 1 - base
        last_of_text[ends[ends < n]] = True
        h = prefix_hashes(part)
        key = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        low, size = key, 1
        while size < 16:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        low = np.minimum(low[: len(key) - SPREAD + 1], low[SPREAD - 16 :])
        place = (low & _PLACE).astype(np.int64)
        first = valid.copy()
        first[1:] &= (place[1:] != place[:-1]) | ~valid[:-1] | last_of_text[:-1]
        begin = np.flatnonzero(first)
        if not len(begin):
            continue
        # a run of windows ends before the next run or at its text's last window
        stop = np.append(begin[1:], len(place)) - 1
        dead = np.flatnonzero(~valid)
        if len(dead):
            k = np.searchsorted(dead, begin)
            stop = np.where(k < len(dead), np.minimum(stop, dead[np.minimum(k, len(dead) - 1)] - 1), stop)
        at = place[begin]
        for rows, x in zip(found, (begin + base, stop + base, at + base, h[at]), strict=True):
            rows.append(x)
    if not found[0]:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in found)


def parts_for(size: int) -> int:
    """Parts for so many bytes of text, of which every SPREAD + 1 have two prefixes."""
    room = min(MOST_PREFIXES, PART_PREFIXES * max(1.0, (size / (1 << 30)) ** 0.5))
    return max(1, ceil(size * 2 / (SPREAD + 1) / room))


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return (((hashes >> U64(32)) * U64(parts)) >> U64(32)).astype(np.int64)


def window_hashes(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of the MATCH bytes from each place."""
    out = np.zeros(len(at), np.uint64)
    for k in range(MATCH):
        out = out * U64(_BASE) + _BYTE_CODE[raw[at + k]]
    return mix(out)


def _several(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether a group of rows holds several ids; groups begin at ``starts``."""
    return np.minimum.reduceat(ids, starts) != np.maximum.reduceat(ids, starts) if len(starts) else np.zeros(0, bool)


class Slice:
    """Some texts with their suffixes in the order of their prefix hashes."""

    def __init__(self, blob: bytes) -> None:
        self.ids, self.named, self.offsets, self.raw = opened(blob)
        first, last, at, hashes = suffix_starts(self.raw, self.offsets)
        text = np.searchsorted(self.offsets, first, "right") - 1
        own = self.named[text]
        first, last, at, hashes, text = first[own], last[own], at[own], hashes[own], text[own]
        order = np.argsort(hashes, kind="stable")
        self.first, self.last, self.at, self.hashes, self.text = first[order], last[order], at[order], hashes[order], text[order]
        new = np.ones(len(order), bool)
        new[1:] = self.hashes[1:] != self.hashes[:-1]
        self.group = np.cumsum(new) - 1
        self.starts = np.flatnonzero(new)

    def fingerprints(self) -> tuple[np.ndarray, ...]:
        """Of the distinct prefixes: hash, whether several documents of the slice have it, how often it is here (255 at most), which of 8 kinds of surroundings."""
        h = self.hashes[self.starts]
        if not len(h):
            return h, np.zeros(0, bool), np.zeros(0, np.uint8), np.zeros(0, np.uint8)
        spare = np.concatenate([self.raw, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(self.raw) + 1,), "<u8", buffer=spare.data, strides=(1,))
        around = mix(eight[self.first] ^ mix(eight[self.last + MATCH - 8] + (self.at - self.first).astype(np.uint64)))
        kinds = np.bitwise_or.reduceat(np.uint8(1) << (around >> U64(61)).astype(np.uint8), self.starts)
        often = np.minimum(np.diff(np.append(self.starts, len(self.hashes))), 255).astype(np.uint8)
        return h, _several(self.ids[self.text], self.starts), often, kinds

    def keep(self, shared: np.ndarray, hot: np.ndarray) -> None:
        """Go on with the suffixes whose distinct prefix is marked in ``shared``; windows of those marked in ``hot`` are set apart."""
        own, apart = (x[self.group] if len(self.group) else np.zeros(0, bool) for x in (shared & ~hot, hot))
        count = (self.last - self.first + 1)[apart]
        window = np.repeat(self.first[apart] - np.cumsum(count) + count, count) + np.arange(count.sum())
        text, hashes = np.repeat(self.text[apart], count), window_hashes(self.raw, window)
        order = np.argsort(hashes, kind="stable")
        self.window, self.window_text, self.window_hashes = window[order], text[order], hashes[order]
        self.window_starts = np.flatnonzero(np.diff(self.window_hashes, prepend=~self.window_hashes[:1]))
        self.first, self.last, self.at, self.hashes, self.text = self.first[own], self.last[own], self.at[own], self.hashes[own], self.text[own]

    def window_fingerprints(self) -> tuple[np.ndarray, np.ndarray]:
        """Of the distinct windows set apart: hash, whether several documents of the slice have it."""
        return self.window_hashes[self.window_starts], _several(self.ids[self.window_text], self.window_starts)

    def add_windows(self, shared: np.ndarray) -> None:
        """Go on with the windows set apart that are marked in ``shared`` too, as suffixes of one window."""
        own = np.repeat(shared, np.diff(np.append(self.window_starts, len(self.window))))
        window, text, hashes = self.window[own], self.window_text[own], self.window_hashes[own]
        order = np.argsort(np.concatenate([self.hashes, hashes]), kind="stable")
        self.first, self.last, self.at = (np.concatenate([x, window])[order] for x in (self.first, self.last, self.at))
        self.text, self.hashes = np.concatenate([self.text, text])[order], np.concatenate([self.hashes, hashes])[order]

    def entries(self, parts: int) -> Iterator[tuple[int, list[bytes], np.ndarray, np.ndarray]]:
        """For each part: its number, the sorted distinct entries, and places of its suffixes with their entry."""
        body = memoryview(self.raw.tobytes())
        part = part_of(self.hashes, parts)
        edge = np.flatnonzero(np.diff(part, prepend=-1, append=-1)) if len(part) else np.zeros(0, np.int64)
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            texts = [b"".join((body[s : e + MATCH], body[f:s], bytes((s - f,)))) for f, e, s in zip(self.first[a:b].tolist(), self.last[a:b].tolist(), self.at[a:b].tolist(), strict=True)]
            names = sorted(set(texts))
            number = {name: i for i, name in enumerate(names)}
            yield int(part[a]), names, np.arange(a, b), np.array([number[t] for t in texts], np.int64)


def front_coded(names: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shared prefix with the entry before, length, remaining bytes) of sorted entries."""
    sizes = np.array([len(x) for x in names], np.int64)
    table = np.array(names, dtype=f"S{MATCH + SPREAD + 1}").view(np.uint8).reshape(len(names), -1)
    shared = np.zeros(len(names), np.int64)
    if len(names) > 1:
        differs = table[1:] != table[:-1]
        shared[1:] = np.where(differs.any(axis=1), differs.argmax(axis=1), MATCH + SPREAD + 1)
        shared[1:] = np.minimum(shared[1:], np.minimum(sizes[1:], sizes[:-1]))
    rest = b"".join(x[k:] for x, k in zip(names, shared.tolist(), strict=True))
    return shared.astype(np.uint8), sizes.astype(np.uint8), np.frombuffer(rest, np.uint8)


class Run:
    """A front-coded sorted run, read entry by entry."""

    def __init__(self, shared: np.ndarray, sizes: np.ndarray, rest: np.ndarray) -> None:
        self.shared, self.sizes, self.rest = shared.tobytes(), sizes.tobytes(), rest.tobytes()
        self.next, self.at, self.entry = 0, 0, b""

    def advance(self) -> int:
        """Read the next entry; what it shares with the one before, or -1 at the end."""
        if self.next == len(self.sizes):
            return -1
        known = self.shared[self.next]
        end = self.at + self.sizes[self.next] - known
        self.entry = self.entry[:known] + self.rest[self.at : end]
        self.at = end
        self.next += 1
        return known


def common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes need no look."""
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most
    at = known
    while a[at : at + 8] == b[at : at + 8]:
        at += 8
    while a[at] == b[at]:
        at += 1
    return at


def merge(runs: list[Run]) -> Iterator[tuple[bytes, int, int, int]]:
    """(entry, what it shares with the entry before, run, number in the run) in sorted order.

    A loser tree. Each head knows what it shares with the entry that went out last on its way; a
    head that shares more is the smaller one, without a look at any byte.
    """
    k = 1
    while k < len(runs):
        k *= 2
    shares = [run.advance() for run in runs] + [-1] * (k - len(runs))
    losers = [0] * k

    def play(one: int, other: int) -> tuple[int, int]:
        """(winner, loser)."""
        s, t = shares[one], shares[other]
        if s != t:
            return (one, other) if s > t else (other, one)
        if s < 0:
            return one, other
        a, b = runs[one].entry, runs[other].entry
        both = common(a, b, s)
        if a <= b:
            shares[other] = both
            return one, other
        shares[one] = both
        return other, one

    winners = [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    top = winners[1] if k > 1 else 0
    while shares[top] >= 0:
        run = runs[top]
        yield run.entry, shares[top], top, run.next - 1
        shares[top] = run.advance()
        node = (top + k) // 2
        while node:
            other = losers[node]
            s, t = shares[top], shares[other]
            if s < t:
                losers[node], top = top, other
            elif s == t and s >= 0:
                top, losers[node] = play(top, other)
            node //= 2


def windows_of(entry: bytes) -> tuple[int, bytes]:
    """Place of the suffix start in an entry's first window, and the bytes from that window's start to the last one's end."""
    before = entry[-1]
    right = len(entry) - 1 - before
    return before, entry[right:-1] + entry[:right]


class Answers:
    """For each entry of each run the smallest document of its windows.

    Where an entry's windows differ, ``odd`` has (entry, window, smallest document) for the first
    window and for each window whose document is not that of the window before it.
    """

    def __init__(self, sizes: list[int]) -> None:
        self.low = [np.zeros(n, np.int64) for n in sizes]
        self.odd = [(array("i"), array("B"), array("q")) for _ in sizes]

    def settle(self, entries: list[list]) -> None:
        """The entries of one suffix start: bytes, smallest document, who holds them."""
        if all(e[1] == entries[0][1] for e in entries):
            for _, low, holders in entries:
                for run, i in holders:
                    self.low[run][i] = low
            return
        spans = [windows_of(e[0]) for e in entries]
        lows: list[list[int]] = [[] for _ in entries]
        # windows with the suffix start at one place after the other, so that one place's windows are held at a time
        for place in range(max(b for b, _ in spans), min(b - len(w) for b, w in spans) + MATCH - 1, -1):
            own = [(k, w[b - place : b - place + MATCH]) for k, (b, w) in enumerate(spans) if 0 <= b - place <= len(w) - MATCH]
            least: dict[bytes, int] = {}
            for k, window in own:
                low = entries[k][1]
                if least.get(window, low) >= low:
                    least[window] = low
            for k, window in own:
                lows[k].append(least[window])
        for (_, _, holders), found in zip(entries, lows, strict=True):
            steps = [t for t in range(len(found)) if t == 0 or found[t] != found[t - 1]]
            for run, i in holders:
                self.low[run][i] = found[0]
                if len(steps) > 1:
                    for column, values in zip(self.odd[run], ([i] * len(steps), steps, [found[t] for t in steps]), strict=True):
                        column.extend(values)


def settle_part(runs: list[tuple[np.ndarray, ...]]) -> Answers:
    """Merge runs of (shared, sizes, rest, smallest documents) and settle every suffix start."""
    answers = Answers([len(r[1]) for r in runs])
    documents = [array("q", r[3].tobytes()) for r in runs]
    group: list = []
    for entry, shared, run, i in merge([Run(*r[:3]) for r in runs]):
        document = documents[run][i]
        if group and shared == len(entry) and entry == group[-1][0]:
            group[-1][1] = min(group[-1][1], document)
            group[-1][2].append((run, i))
            continue
        if group and shared < PREFIX:
            answers.settle(group)
            group = []
        group.append([entry, document, [(run, i)]])
    if group:
        answers.settle(group)
    return answers


def _by_part(number: int, hashes: np.ndarray, parts: int, *columns: np.ndarray) -> pa.RecordBatch:
    """slice, part, keys and the packed other columns of sorted hashes, a row for each part."""
    edge = np.searchsorted(part_of(hashes, parts), np.arange(parts + 1))
    own = np.flatnonzero(np.diff(edge)).tolist()
    keys = (hashes & U64(0xFFFFFFFF)).astype(np.uint32)
    blobs = [packed(keys[edge[p] : edge[p + 1]], *(c[edge[p] : edge[p + 1]] for c in columns)) for p in own]
    return pa.RecordBatch.from_arrays([pa.array([number] * len(own), pa.int64()), pa.array(own, pa.int32()), pa.array(blobs, pa.binary())], ["slice", "part", "keys"])


def _fingerprinted(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, blob in zip(batch.column("slice").to_pylist(), batch.column("blob"), strict=True):
                h, several, often, kinds = Slice(blob.as_py()).fingerprints()
                yield _by_part(number, h, parts, several, often, kinds)

    return run


def _shared(keys: list[np.ndarray], several: list[np.ndarray], often: list[np.ndarray] | None = None, kinds: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of all fingerprints of a part: whether two slices or two documents have it, and whether it is hot."""
    everything = np.concatenate([*keys, np.zeros(0, np.uint32)])
    order = np.argsort(everything, kind="stable")
    ranked = everything[order]
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    starts = np.flatnonzero(new)
    count = np.diff(np.append(starts, len(ranked)))
    marked, hot = np.zeros(len(ranked), bool), np.zeros(len(ranked), bool)
    marked[order] = np.repeat(count > 1, count)
    marked |= np.concatenate([*several, np.zeros(0, bool)])
    if often is not None and len(starts):
        total = np.add.reduceat(np.concatenate(often)[order].astype(np.int64), starts)
        ways = np.bitwise_or.reduceat(np.concatenate(kinds)[order], starts)
        hot[order] = np.repeat((total > HOT) & (np.unpackbits(ways[:, None], axis=1).sum(axis=1) >= 6), count)
    return marked, hot


def _told(table: pa.Table, keys: list[np.ndarray], marked: np.ndarray, hot: np.ndarray) -> pa.Table:
    edge = np.cumsum([0] + [len(k) for k in keys])
    bits = [[np.packbits(x[a:b]).tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)] for x in (marked, hot)]
    n_hot = [int(hot[a:b].sum()) for a, b in zip(edge[:-1], edge[1:], strict=True)]
    return pa.table({"slice": table.column("slice"), "part": table.column("part"), "bits": pa.array(bits[0], pa.binary()), "hot": pa.array(bits[1], pa.binary()), "n": pa.array([len(k) for k in keys], pa.int32()), "n_hot": pa.array(n_hot, pa.int32())})


def _shared_prefixes(table: pa.Table) -> pa.Table:
    """For the fingerprints of a part: a bit each, whether two slices or two documents have it, and whether it is hot."""
    found = [unpacked(k.as_py(), np.uint32, np.bool_, np.uint8, np.uint8) for k in table.column("keys")]
    columns = [list(c) for c in zip(*found, strict=True)] or [[]] * 4
    return _told(table, columns[0], *_shared(*columns))


def _shared_windows(table: pa.Table) -> pa.Table:
    found = [unpacked(k.as_py(), np.uint32, np.bool_) for k in table.column("keys")]
    columns = [list(c) for c in zip(*found, strict=True)] or [[]] * 2
    return _told(table, columns[0], *_shared(*columns))


BITS = "slice long, part int, bits binary, hot binary, n int, n_hot int"


def _marks(rows: list[dict] | None, column: str) -> np.ndarray:
    """The bits of a slice's fingerprints, in their order."""
    marks = [np.unpackbits(np.frombuffer(b[column], np.uint8), count=b["n"]).astype(bool) for b in sorted(rows or [], key=lambda b: b["part"])]
    return np.concatenate([*marks, np.zeros(0, bool)])


def _apart(blob: bytes, bits: list[dict] | None) -> Slice:
    own = Slice(blob)
    own.keep(_marks(bits, "bits"), _marks(bits, "hot"))
    return own


def _kept(blob: bytes, bits: list[dict] | None, windows: list[dict] | None) -> Slice:
    own = _apart(blob, bits)
    if len(own.window):
        own.add_windows(_marks(windows, "bits"))
    return own


def _window_prints(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, blob, bits in zip(batch.column("slice").to_pylist(), batch.column("blob"), batch.column("bits").to_pylist(), strict=True):
                h, several = _apart(blob.as_py(), bits).window_fingerprints()
                yield _by_part(number, h, parts, several)

    return run


def _runs(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, blob, bits, windows in zip(*(batch.column(c).to_pylist() for c in ("slice", "blob", "bits", "windows")), strict=True):
                own = _kept(blob, bits, windows)
                numbers, blobs = [], []
                for part, names, rows, entry in own.entries(parts):
                    low = np.full(len(names), np.iinfo(np.int64).max)
                    np.minimum.at(low, entry, own.ids[own.text[rows]])
                    numbers.append(part)
                    blobs.append(packed(*front_coded(names), low))
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(numbers), pa.int64()), pa.array(numbers, pa.int32()), pa.array(blobs, pa.binary())], ["slice", "part", "run"])

    return run


def _settled(table: pa.Table) -> pa.Table:
    runs = [tuple(unpacked(r.as_py(), np.uint8, np.uint8, np.uint8, np.int64)) for r in table.column("run")]
    answers = settle_part(runs)
    blobs = []
    for low, odd in zip(answers.low, answers.odd, strict=True):
        blobs.append(packed(low, *(np.frombuffer(x, x.typecode) if len(x) else np.zeros(0, x.typecode) for x in odd)))
    return pa.table({"slice": table.column("slice"), "part": table.column("part"), "answer": pa.array(blobs, pa.binary())})


def removed_bytes(own: Slice, answers: list[dict], parts: int) -> np.ndarray:
    """Which bytes of the slice go."""
    change = np.zeros(len(own.raw) + 1, np.int8)  # at most one run of windows begins or ends at a byte, and one step
    by_part = {a["part"]: a["answer"] for a in answers or []}
    for part, _, rows, entry in own.entries(parts):
        low, odd, window, odd_low = unpacked(by_part[part], np.int64, np.int32, np.uint8, np.int64)
        document = own.ids[own.text[rows]]
        plain = np.ones(len(low), bool)
        plain[odd] = False
        goes = plain[entry] & (low[entry] < document)
        np.add.at(change, own.first[rows[goes]], 1)
        np.add.at(change, own.last[rows[goes]] + MATCH, -1)
        if len(odd):
            # entry numbers are not in order in odd: entries come in merged order, so sort the steps
            order = np.lexsort((window, odd))
            odd, window, odd_low = odd[order], window[order].astype(np.int64), odd_low[order]
            until = np.append(window[1:], 0)
            final = np.append(odd[1:] != odd[:-1], True)
            begin, end = np.searchsorted(odd, np.arange(len(low))), np.searchsorted(odd, np.arange(len(low)), "right")
            own_rows = np.flatnonzero(~plain[entry])
            count = (end - begin)[entry[own_rows]]
            row = np.repeat(own_rows, count)
            step = np.repeat(begin[entry[own_rows]], count) + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            goes = odd_low[step] < document[row]
            row, step = row[goes], step[goes]
            first = own.first[rows[row]]
            np.add.at(change, first + window[step], 1)
            np.add.at(change, np.where(final[step], own.last[rows[row]] + 1, first + until[step]) - 1 + MATCH, -1)
    return np.cumsum(change[:-1], dtype=np.int32) > 0


def _listed(rows) -> list[dict] | None:
    return None if rows is None else rows.to_pylist()


def _gone(parts: int):
    def run(row: dict):
        own = _kept(row["blob"], _listed(row["bits"]), _listed(row["windows"]))
        return (own.ids, own.named, own.offsets, own.raw), removed_bytes(own, _listed(row["answers"]), parts)

    return run


def deduplicate(docs: DataFrame, whole_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept: the remaining text, or the SHA-256 of its bytes."""
    cut = slice_table(docs, SLICE)
    parts = parts_for(cut.agg(F.sum("size")).first()[0] or 0)
    cut = cut.select("slice", "blob")

    def by_part(rows: DataFrame) -> GroupedData:
        return rows.repartition(tasks(parts), "part").groupBy("part")

    prints = cut.mapInArrow(_fingerprinted(parts), "slice long, part int, keys binary")
    shared = staged(by_part(prints).applyInArrow(_shared_prefixes, BITS), "bits")
    if shared.filter("n_hot > 0").isEmpty():  # nothing is set apart
        windows = docs.sparkSession.createDataFrame([], BITS)
    else:
        apart = by_slice(cut, bits=shared.drop("n_hot")).mapInArrow(_window_prints(parts), "slice long, part int, keys binary")
        windows = staged(by_part(apart).applyInArrow(_shared_windows, BITS), "windows")
    marked = {"bits": shared.drop("n_hot"), "windows": windows.drop("hot", "n_hot")}
    runs = by_slice(cut, **marked).mapInArrow(_runs(parts), "slice long, part int, run binary")
    answers = staged(by_part(runs).applyInArrow(_settled, "slice long, part int, answer binary"), "answers")
    return reports(by_slice(cut, **marked, answers=answers), _gone(parts), whole_text)


def op4_suffix_merge(docs: DataFrame) -> DataFrame:
    return deduplicate(docs, whole_text=False).withColumnRenamed("kept", "kept_sha256")
