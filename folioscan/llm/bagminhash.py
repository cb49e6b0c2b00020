"""Near-duplicates by BagMinHash signatures, banding and exact multiset overlap.

A text is the multiset of its windows of five folded words (a text of fewer, but not none, is one
window); two texts are linked when sum(min) / sum(max) of their counts is 0.8 or more.

Signatures. A window with count w owns the weight interval [0, w). That interval is covered by a
fixed hierarchy: [0, 1), [1, 2), [2, 4), [4, 8), ... Each piece is a Poisson process of points
(place in time, register) with a rate of its width, seeded by window and piece. A piece that ends
behind w is split: a point's level inside the piece is drawn as well, and only points below w
count. So two counts of one window share exactly the points below the smaller count, and a
register's earliest point agrees with the probability of the weighted Jaccard similarity. A
process is followed only until it is later than the latest register of its text, which ends most
windows at their first point.

Search. Rows are numbered once, and a row's number, not its doc_id, names it from then on. Rows with
equal multisets are one node, named by its first row. Nodes that agree in all registers of a band
share a bucket. Instead of all pairs of a bucket, each member meets the bucket's hub, the member that
meets most others over all its bands; links are verified exactly and united into components. Only
where a bucket's members lie in several components afterwards, the members outside of the bucket's
largest component are compared with those of other components, so no link found by the bands is
lost. Which of these comparisons are needed is told by prefix filtering: two bags of sizes a and b
have t / (1 + t) * (a + b) windows in common if their similarity is t, so that they share one
among the rarest a - t / (1 + t) * (a + b) + 1 of either, in one order for all. Sizes go in classes 5 % wide, and
only bags of fitting classes meet. With 24 bands of 4 registers, a pair at similarity 0.8 shares no bucket with probability
3e-6, at 0.9 with 1e-11.

A node that is in more than ``BLOCK`` pairs is a hub of many; its bag is sent once for each block of
its partners, so that no task verifies all of them.

Classes. A class is named by the smallest doc_id of its rows, and kept is the first row that has this
doc_id.

Defined cases: null texts and texts without words have no windows and are classes of their own, all
kept; each row is a document, rows with one doc_id too, by its own text (classes of such rows may
share their name); a row with a null doc_id is a document like any other, and a class without any
doc_id is named null; texts of any length count as a whole; repeated rows are one class; an empty
table gives no rows; other columns are ignored, and ``deduplicated`` keeps them, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import U64, expanded, mix, shingles, slices
from .common import fresh, numbered, staged
from .graph import components

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 4
#: Pairs of one node that one task verifies.
BLOCK = 128
_STEP = U64(0x9E3779B97F4A7C15)


def signatures(text: np.ndarray, item: np.ndarray, count: np.ndarray, n_texts: int, registers: int = BANDS * ROWS) -> np.ndarray:
    """The earliest time of each register of each text; infinite for a text without items."""
    earliest = np.full((n_texts, registers), np.inf)
    flat = earliest.ravel()
    owner, seed, width, room = [], [], [], []
    low = 0
    while True:
        own = np.flatnonzero(count > low)
        if not len(own):
            break
        step = max(1, low)
        owner.append(text[own])
        seed.append(mix(item[own] ^ mix(np.full(1, low + 1, np.uint64) * _STEP)))
        width.append(np.full(len(own), float(step)))
        room.append(np.minimum(count[own] - low, step).astype(np.float64))
        low += step
    if not owner:
        return earliest
    owner, seed, width, room = map(np.concatenate, (owner, seed, width, room))
    time = np.zeros(len(owner))
    turn = 0
    while len(owner):
        n = len(owner)
        k = int(np.clip(65536 // n, 1, 32))
        turns = (np.arange(turn + 1, turn + k + 1, dtype=np.uint64) * _STEP)[None, :]
        draw = mix((seed[:, None] + turns).ravel()).reshape(n, k)
        turn += k
        gap = -np.log(((draw >> U64(24)).astype(np.float64) + 0.5) / float(1 << 40)) / width[:, None]
        gap[:, 0] += time
        at = np.cumsum(gap, axis=1)
        register = ((draw & U64(0xFFFFFF)) * U64(registers) >> U64(24)).astype(np.int64)
        place = owner[:, None] * registers + register
        split = room < width
        if split.any():
            level = (mix(draw[split].ravel() ^ _STEP) >> U64(11)).astype(np.float64).reshape(-1, k) / float(1 << 53) * width[split][:, None]
            good = np.ones((n, k), bool)
            good[split] = level < room[split][:, None]
            np.minimum.at(flat, place[good], at[good])
        else:
            np.minimum.at(flat, place.ravel(), at.ravel())
        time = at[:, -1]
        going = time < earliest.max(axis=1)[owner]
        owner, seed, width, room, time = owner[going], seed[going], width[going], room[going], time[going]
    return earliest


def band_keys(earliest: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    bits = np.ascontiguousarray(earliest).view(np.uint64).reshape(-1, bands, rows)
    key = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * _STEP, (len(bits), 1))
    for r in range(rows):
        key = mix(key + bits[:, :, r])
    return key.view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, rows = batch.column("doc_id"), batch.column("row")
        for first, end, raw, offsets in slices(batch):
            n = end - first
            text, item, count = expanded(*shingles(raw, offsets, SHINGLE))
            keys = band_keys(signatures(text, item, count, n))
            sums = []
            for salt in (1, 2):
                code = mix(item * U64(2 * salt + 1) + mix(count.astype(np.uint64) * _STEP + U64(salt)))
                total = np.zeros(len(code) + 1, np.uint64)
                np.cumsum(code, out=total[1:])
                at = np.searchsorted(text, np.arange(n + 1))
                sums.append((total[at[1:]] - total[at[:-1]]).view(np.int64))
            size = np.bincount(text, weights=count, minlength=n).astype(np.int64) if len(text) else np.zeros(n, np.int64)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * BANDS, BANDS, dtype=np.int32)), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([rows.slice(first, n), ids.slice(first, n), pa.array(size), pa.array(sums[0]), pa.array(sums[1]), bands], ["row", "doc_id", "n_shingles", "digest_a", "digest_b", "bands"])


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sorted 64-bit codes of (window, how often before), so that sets of codes overlap as the multisets do."""
    for batch in batches:
        rows = batch.column("row")
        for first, end, raw, offsets in slices(batch):
            text, item, count = expanded(*shingles(raw, offsets, SHINGLE))
            many = np.repeat(np.arange(len(item)), count)
            before = np.arange(len(many)) - np.repeat(np.cumsum(count) - count, count)
            code = mix(item[many] + before.astype(np.uint64) * _STEP)
            text = text[many]
            order = np.lexsort((code, text))
            code, text = code[order], text[order]
            at = np.searchsorted(text, np.arange(end - first + 1))
            yield pa.RecordBatch.from_arrays([rows.slice(first, end - first), pa.array([code[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["node", "bag"])


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """|A and B| / |A or B| of sorted distinct codes."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common / max(1, len(both) - common)


def _verified(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, similar = [], []
            for i, (x, y) in enumerate(zip(batch.column("bag_a"), batch.column("bag_b"), strict=True)):
                s = overlap(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64))
                if s >= threshold:
                    rows.append(i)
                    similar.append(s)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(take), batch.column("b").take(take), pa.array(similar, pa.float64())], ["a", "b", "similarity"])

    return run


def _with_bag(pairs: DataFrame, side: str, other: str, bags: DataFrame) -> DataFrame:
    """``pairs`` with the bag of the node in column ``side``; nodes in many pairs are dealt in blocks of them."""
    often = pairs.groupBy(side).agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("blocks")).filter("blocks > 1")
    often = staged(often, "often")  # a small part of the pairs' nodes
    dealt = pairs.join(often, side, "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64(other), F.col("blocks")), F.lit(0)).cast("int")).drop("blocks")
    sent = bags.select(F.col("node").alias(side), F.col("bag").alias(f"bag_{side}")).join(often, side, "left")
    sent = sent.withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))).drop("blocks")
    return dealt.join(sent, [side, "block"]).drop("block")


def _links(pairs: DataFrame, bags: DataFrame, threshold: float, name: str) -> DataFrame:
    pairs = staged(pairs, f"{name}_pairs")
    # sizes first: the smaller of two bags has to have `threshold` of the larger one
    long_enough = F.least(F.octet_length("bag_a"), F.octet_length("bag_b")) >= threshold * F.greatest(F.octet_length("bag_a"), F.octet_length("bag_b"))
    both = _with_bag(_with_bag(pairs, "a", "b", bags), "b", "a", bags)
    both = both.filter(long_enough).select("a", "b", "bag_a", "bag_b")
    return staged(both.mapInArrow(_verified(threshold), "a long, b long, similarity double"), name)


def _classes(docs: DataFrame, threshold: float) -> DataFrame:
    """row, doc_id, n_shingles, label (a number for the class), class_id for rows of row, doc_id, text."""
    signed = staged(docs.mapInArrow(_signed, "row long, doc_id long, n_shingles long, digest_a long, digest_b long, bands array<long>"), "signed")
    named = signed.filter("n_shingles > 0")
    equal = named.groupBy("digest_a", "digest_b").agg(F.min("row").alias("node"), F.min("doc_id").alias("low"))
    equal = staged(equal, "equal")  # a join of plain tables, so that hot keys can be split
    members = staged(named.join(equal, ["digest_a", "digest_b"]).select("row", "doc_id", "n_shingles", "node", F.when(F.col("row") == F.col("node"), F.col("bands")).alias("bands")), "members")
    rows = members.filter("bands is not null").select("node", F.explode("bands").alias("key")).distinct()
    crowded = staged(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "crowded")
    shared = staged(rows.join(crowded, "key"), "shared")
    meets = shared.groupBy("node").agg(F.sum("n").alias("met"))
    known = staged(shared.join(meets, "node"), "known")
    hubs = known.groupBy("key").agg(F.max(F.struct("met", F.negative("node").alias("minus"))).alias("hub")).select("key", F.negative("hub.minus").alias("hub"))
    hubs = staged(hubs, "hubs")
    pairs = known.join(hubs, "key").filter("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    bags = staged(docs.join(shared.select(F.col("node").alias("row")).distinct(), "row", "left_semi").mapInArrow(_bags, "node long, bag binary"), "bags")
    links = _links(pairs, bags, threshold, "links")
    label = staged(_labelled(shared, components(links)), "labelled")
    links = links.union(_links(_across(label, bags, threshold), bags, threshold, "across"))
    label = equal.select("node", "low").join(components(links), "node", "left").select("node", "low", F.coalesce("label", "node").alias("label"))
    label = staged(label, "labels")
    lows = label.groupBy("label").agg(F.min("low").alias("class_id"))
    classes = staged(label.select("node", "label").join(lows, "label"), "classes")  # a row for each different bag
    told = members.select("row", "doc_id", "n_shingles", "node").join(classes, "node").select("row", "doc_id", "n_shingles", "label", "class_id")
    return told.union(signed.filter("n_shingles = 0").select("row", "doc_id", "n_shingles", F.col("row").alias("label"), F.col("doc_id").alias("class_id")))


def _kept(classes: DataFrame) -> DataFrame:
    """row: the first one of each class that has the class's name for its doc_id."""
    return classes.filter("doc_id <=> class_id").groupBy("label").agg(F.min("row").alias("row")).select("row")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its class), n_shingles, is_kept for each row of ``docs``."""
    classes = staged(_classes(numbered(docs.select("doc_id", "text"), "row", "rows"), threshold), "told")
    kept = _kept(classes).withColumn("is_kept", F.lit(True))
    return classes.join(kept, "row", "left").select("doc_id", "class_id", "n_shingles", F.coalesce("is_kept", F.lit(False)).alias("is_kept"))


def _labelled(shared: DataFrame, classes: DataFrame) -> DataFrame:
    """key, node, label of the members of buckets that hold several components."""
    own = staged(shared.select("key", "node").join(classes, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label")), "own")
    several = staged(own.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("key"), "several")
    return own.join(several, "key")


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for node, bag in zip(batch.column("node").to_pylist(), batch.column("bag"), strict=True):
            codes = np.frombuffer(bag.as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(np.full(len(codes), node, np.int64))], ["code", "node"])


def size_class(size: float) -> int:
    return int(np.floor(np.log(size) / np.log(1.05) + 1e-9))


def prefix_lengths(size: int, threshold: float) -> list[tuple[int, int]]:
    """(size class, how many of the rarest windows) for each class that a partner may have."""
    share, out = threshold / (1 + threshold), []
    for other in range(size_class(threshold * size), size_class(size / threshold) + 1):
        least = max(np.ceil(1.05**other - 1e-6), np.ceil(threshold * size - 1e-9))
        length = size - int(np.ceil(share * (size + least) - 1e-6)) + 1
        if length > 0:
            out.append((other, length))
    return out


def _prefixes(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, codes in zip(batch.column("node").to_pylist(), batch.column("codes"), strict=True):
                codes = codes.values.field("code").to_numpy(zero_copy_only=False)
                own = size_class(len(codes))
                found = prefix_lengths(len(codes), threshold)
                rows = np.concatenate([codes[:n] for _, n in found] + [codes[:0]])
                other = np.repeat(np.array([c for c, _ in found], np.int32), [n for _, n in found])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), node, np.int64)), pa.array(rows), pa.array(np.full(len(rows), own, np.int32)), pa.array(other)], ["node", "code", "own", "other"])

    return run


def _across(labelled: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """The pairs that the hubs left open and that may be links."""
    nodes = staged(labelled.select("node", "label").distinct(), "open_nodes")
    codes = staged(bags.join(nodes.select("node").distinct(), "node", "left_semi").mapInArrow(_codes, "code long, node long"), "codes")
    often = staged(codes.groupBy("code").agg(F.count(F.lit(1)).alias("n")), "often")
    listed = codes.join(often, "code").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "code"))).alias("codes"))
    prefixes = staged(listed.mapInArrow(_prefixes(threshold), "node long, code long, own int, other int").join(nodes, "node"), "prefixes")
    sizes = labelled.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    largest = staged(sizes.groupBy("key").agg(F.max(F.struct("n", "label")).alias("top")).select("key", F.col("top.label").alias("top")), "largest")
    few = labelled.join(largest, "key").filter("label <> top").select("node").distinct()
    asked = prefixes.join(few, "node", "left_semi").select(F.col("node").alias("a"), F.col("label").alias("label_a"), "code", F.col("own").alias("other"), F.col("other").alias("own"))
    met = asked.join(prefixes, ["code", "own", "other"]).filter("label <> label_a")
    return met.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()


def op5_bagminhash(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs)


def deduplicated(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of ``docs`` for each class of near-duplicates."""
    (row,) = fresh(docs.columns, "row")
    rows = numbered(docs, row, "rows")
    kept = _kept(_classes(rows.select(F.col(row).alias("row"), "doc_id", "text"), threshold)).withColumnRenamed("row", row)
    return rows.join(kept, row, "left_semi").select(docs.columns)
