"""Toxicity after noisy-channel deobfuscation.

Restoring. A suspicious piece of text is read as a noisy copy of plain words: letters replaced by
look-alike digits and signs, letters repeated, letters set apart by spaces or dots. Its lattice has
arcs for the letters that a sign may stand for, for a run of one character kept, cut to two or cut
to one (each run by itself; of runs of two only in pieces that hold a longer one), and for every
gap between letters set apart, dropped or kept as a word's end. The Viterbi algorithm finds the
reading of the highest channel times language-model probability, in time linear in the piece. The
language model is an interpolated trigram over folded characters; its counts come from all
documents. Pieces end at signs that stand for no letter and may have any length.

Scoring. Features of the restored text are its words and their first 4, 5 and 6 bytes. Log-odds of
a feature come from at most ``SAMPLE`` toxic and as many other labelled documents; features in
``LEAST_DOCUMENTS`` toxic ones or more that speak for toxicity with a z value of ``LEAST_Z`` or more
count, however many they are. A text's score is a logistic function of the sum of its distinct
features' log-odds; it is fitted on these rows, whose sums then come from the features of the other
half of them (halves by the texts' beginnings, so that copies stay together).

Defined cases: null and empty texts get the score of a text without evidence; contradicting or
null labels take no part; without a toxic label every score is next to 0; repeated rows are scored
alike; rows that share an id are scored by their own texts, and one of them serves for fitting; a
null doc_id is scored and is not held out; an empty table gives no rows; texts are read whole,
however long; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import _BYTE_CODE, FOLD, U64, edges, mix, slices, span_hashes
from .common import bounded_ids, held_out, staged
from .quality import trusted

SAMPLE = 8000
LEAST_Z = 3.0
LEAST_DOCUMENTS = 3
#: The letters that a sign may stand for.
LOOKALIKES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "+": "t", "|": "il"}
#: Channel: probability that a sign stands for a letter, of each dropped repeat, of each dropped separator.
SWAP, REPEAT, APART = 0.3, 0.3, 0.3
#: Characters of a piece whose reading is kept for the next time.
CACHED = 40
_APART = re.compile(r"[^ ._*-](?:[ ._*-]+[^ ._*-]){2,}")
_RUN = re.compile(r"(.)\1*", re.DOTALL)

_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = _LETTER[ord("A") : ord("Z") + 1] = True
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in LOOKALIKES]] = True
_OPENING = np.zeros(256, bool)
_OPENING[[ord(c) for c in "!|+"]] = True
_GAP = np.zeros(256, bool)
_GAP[[ord(c) for c in " ._-*"]] = True

#: Symbols of the model: 0 a boundary, 1-26 letters, 27-36 digits, 37 any byte of a non-ASCII character.
SYMBOLS = 38


def _symbols() -> np.ndarray:
    table = np.zeros(256, np.int64)
    for b in range(256):
        f = int(FOLD[b])
        table[b] = 0 if f == 0 else 37 if f >= 128 else f - 96 if f >= 97 else f - 48 + 27
    return table


SYMBOL = _symbols()


def trigram_counts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of symbol triples; texts are set apart by boundaries."""
    s = np.zeros(len(raw) + 2 * (len(offsets) - 1) + 2, np.int64)
    place = np.arange(len(raw)) + 2 * np.repeat(np.arange(1, len(offsets)), np.diff(offsets))
    s[place] = SYMBOL[raw]
    return np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)


class Model:
    """Interpolated trigram log-probabilities, and readings of noisy pieces under them."""

    def __init__(self, counts: np.ndarray) -> None:
        c3 = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(np.float64)
        c2 = c3.sum(axis=0)
        c1 = c2.sum(axis=0)
        p1 = (c1 + 1) / (c1.sum() + SYMBOLS)
        p2 = (c2 + 5 * p1) / (c2.sum(axis=1, keepdims=True) + 5)
        p3 = (c3 + 5 * p2) / (c3.sum(axis=2, keepdims=True) + 5)
        self.log = np.log(p3).tolist()
        self._cached = lru_cache(maxsize=200_000)(self._read)

    def read(self, piece: str) -> str:
        """The restored form of a piece of lower-case text."""
        return self._cached(piece) if len(piece) <= CACHED else self._read(piece)

    def _viterbi(self, word: str, joint: float | None = None) -> str:
        """The best reading of one piece, boundaries on either side.

        ``joint``: the letters are set apart; joining two costs so much, and a word may end between any two.
        """
        runs = [(m[1], len(m[0])) for m in _RUN.finditer(word)]
        stretched = any(n > 2 for _, n in runs)
        states: dict = {(0, 0): (0.0, None)}
        swap, plain, repeat = log(SWAP), log(1 - SWAP), log(REPEAT)
        for i, (ch, n) in enumerate(runs):
            if i and joint is not None:
                ended = max(((score + self.log[a][b][0], text) for (a, b), (score, text) in states.items()), key=lambda x: x[0])
                states = {k: (score + joint, text) for k, (score, text) in states.items()}
                states[0, 0] = ended[0], (ended[1], " ")
            options = [(ch, plain if ch in LOOKALIKES else 0.0)] + [(c, swap) for c in LOOKALIKES.get(ch, "")]
            after: dict = {}
            for c, cost in options:
                k = _symbol(c)
                for kept in {n, min(n, 2), 1} if stretched else {n}:
                    spent = cost * kept + repeat * (n - kept)
                    for (a, b), (score, text) in states.items():
                        s, x, y = score + spent, a, b
                        for _ in range(kept):
                            s += self.log[x][y][k]
                            x, y = y, k
                        if (x, y) not in after or s > after[x, y][0]:
                            after[x, y] = s, (text, c * kept)
            states = after
        return _spelled(max(((score + self.log[a][b][0], text) for (a, b), (score, text) in states.items()), key=lambda x: x[0])[1])

    def _read(self, piece: str) -> str:
        """The restored form of a piece of lower-case text."""
        if not _APART.fullmatch(piece):
            return self._viterbi(piece)
        form = self._viterbi("".join(c for c in piece if c not in " ._*-"), log(APART) * 0.2)
        return piece if all(len(w) == 1 for w in form.split(" ")) else form


def _spelled(text: tuple | None) -> str:
    """The characters of a chain of (chain before, character)."""
    out = []
    while text is not None:
        text, c = text
        out.append(c)
    return "".join(reversed(out))


def _symbol(c: str) -> int:
    return int(SYMBOL[ord(c)]) if ord(c) < 128 else 37


def _foreign_signs(raw: np.ndarray) -> np.ndarray:
    """Bytes of spaces, dashes, quotes and other punctuation outside ASCII; marks of no width aren't among them."""
    out = np.zeros(len(raw), bool)
    if len(raw) > 2 and (raw >= 128).any():
        a, b, c = raw[:-2], raw[1:-1], raw[2:]
        three = (a == 0xE2) & (((b == 0x80) & ((c < 0x8B) | (c > 0x8D))) | ((b == 0x81) & (c < 0xA0))) | (a == 0xE3) & (b == 0x80) & (c <= 0x83)
        two = (raw[:-1] == 0xC2) & ~np.isin(raw[1:], np.array([0xAA, 0xAD, 0xB5, 0xBA], np.uint8))
        for k, found in ((0, three), (1, three), (2, three), (0, two), (1, two)):
            out[k : k + len(found)] |= found
    return out


def suspicious(raw: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
    """(text index, start, end) of the pieces worth reading: look-alikes beside letters, runs, letters set apart."""
    n = len(raw)
    if n < 3:
        return []
    letter, sign = _LETTER[raw], _SIGN[raw]
    low = FOLD[raw]
    mark = np.zeros(n, bool)
    mark[:-1] |= sign[:-1] & letter[1:]
    closing = sign & ~_OPENING[raw]
    triple = np.zeros(n, bool)
    triple[:-2] = (raw[:-2] == raw[1:-1]) & (raw[1:-1] == raw[2:])
    mark[1:] |= closing[1:] & letter[:-1] & ~triple[1:]
    mark[:-2] |= letter[:-2] & (low[:-2] == low[1:-1]) & (low[1:-1] == low[2:])
    text, start, end = edges(((low != 0) | sign) & ~_foreign_signs(raw), offsets)
    out = []
    if len(text):
        marks = np.concatenate([[0], np.cumsum(mark)])
        for i in np.flatnonzero(marks[end] > marks[start]).tolist():
            out.append((int(text[i]), int(start[i]), int(end[i])))
    # single letters with nothing but separators between each two, three or more in a row
    single_text, s, e = edges(letter | sign | (raw >= 128), offsets)
    one = (e - s == 1) & (letter[s] | (sign[s] & ~_OPENING[raw[s]]))
    if len(s) > 1:
        gaps = np.concatenate([[0], np.cumsum(_GAP[raw])])
        joined = one[:-1] & one[1:] & (gaps[s[1:]] - gaps[e[:-1]] == s[1:] - e[:-1]) & (s[1:] > e[:-1]) & (single_text[1:] == single_text[:-1])
        change = np.flatnonzero(np.diff(joined.astype(np.int8), prepend=0, append=0)).tolist()
        out += [(int(single_text[a]), int(s[a]), int(e[b])) for a, b in zip(change[::2], change[1::2], strict=True) if b - a >= 2]
    return out


def _core(piece: str) -> str:
    core = piece.strip(".,;:?()[]{}\"'#%&*^~<>/\\=_- \t\n\r").rstrip("!|+")
    return core


def restored_words(model: Model, raw: np.ndarray, offsets: np.ndarray) -> tuple[list[tuple[int, int, int]], list[str]]:
    """The pieces that read differently, and their restored forms."""
    places, forms = [], []
    for text, start, end in suspicious(raw, offsets):
        piece = _core(raw[start:end].tobytes().decode("utf-8", "replace").lower())
        if any(c.isalpha() for c in piece):
            form = model.read(piece)
            if form != piece:
                places.append((text, start, end))
                forms.append(form)
    return places, forms


def _hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, feature) of the words and the word beginnings."""
    folded = np.where(_foreign_signs(raw), 0, FOLD[raw]).astype(np.uint8)
    text, start, end = edges(folded != 0, offsets)
    codes = _BYTE_CODE[folded]
    texts, starts, found = [text], [start], [span_hashes(codes, start, end)]
    for k in (4, 5, 6):
        own = np.flatnonzero(end - start > k)
        texts.append(text[own])
        starts.append(start[own])
        found.append(mix(span_hashes(codes, start[own], start[own] + k) + U64(k)))
    return np.concatenate(texts), np.concatenate(starts), np.concatenate(found)


def text_features(model: Model, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of the restored texts, with repeats."""
    text, start, feature = _hashes(raw, offsets)
    places, forms = restored_words(model, raw, offsets)
    if not places:
        return text, feature
    spans = sorted((s, e) for _, s, e in places)
    begin, end = np.array([s for s, _ in spans]), np.maximum.accumulate(np.array([e for _, e in spans]))
    k = np.searchsorted(begin, start, "right") - 1
    inside = (k >= 0) & (start < end[np.maximum(k, 0)])
    body = [f.encode() for f in forms]
    new_text, _, new = _hashes(np.frombuffer(b"".join(body), np.uint8), np.concatenate([[0], np.cumsum([len(b) for b in body])]).astype(np.int64))
    owner = np.array([p[0] for p in places])
    return np.concatenate([text[~inside], owner[new_text]]), np.concatenate([feature[~inside], new])


def restore(model: Model, text: str) -> str:
    """The text with its suspicious pieces replaced by their best readings."""
    raw = np.frombuffer(text.encode(), np.uint8)
    places, forms = restored_words(model, raw, np.array([0, len(raw)]))
    out, at = [], 0
    for (_, start, end), form in sorted(zip(places, forms, strict=True)):
        if start >= at:
            out += [raw[at:start].tobytes(), form.encode()]
            at = end
    return b"".join([*out, raw[at:].tobytes()]).decode("utf-8", "replace")


def fit_model(docs: DataFrame) -> Model:
    """The language model of all texts; at most SYMBOLS ** 3 counts reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for _, _, raw, offsets in slices(batch):
                total += trigram_counts(raw, offsets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["gram", "n"])

    counts = np.zeros(SYMBOLS**3, np.int64)
    for r in docs.select("text").mapInArrow(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        counts[r["gram"]] = r["n"]
    return Model(counts)


def _held_model(spark, counts_or_model: Model):
    return spark.sparkContext.broadcast(np.array(counts_or_model.log, np.float32))


def _model_of(held) -> Model:
    model = Model.__new__(Model)
    model.log = held.value.tolist()
    model._cached = lru_cache(maxsize=200_000)(model._read)
    return model


def _documents_with(held):
    """(feature, toxic_0, toxic_1, clean_0, clean_1): in how many texts of either label and half a feature occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model_of(held)
        for batch in batches:
            kind = 2 * (1 - batch.column("label").to_numpy()) + batch.column("half").to_numpy()
            for first, end, raw, offsets in slices(batch):
                text, feature = text_features(model, raw, offsets)
                order = np.lexsort((text, feature))
                text, feature = text[order], feature[order]
                new = np.ones(len(text), bool)
                new[1:] = (text[1:] != text[:-1]) | (feature[1:] != feature[:-1])
                names, at = np.unique(feature[new], return_inverse=True)
                counts = np.bincount(at * 4 + kind[first:end][text[new]], minlength=4 * len(names)).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), *(pa.array(counts[:, k].copy()) for k in range(4))], ["feature", *COUNTS])

    return run


COUNTS = ("toxic_0", "toxic_1", "clean_0", "clean_1")


def _odds(toxic, clean, n_toxic: int, n_clean: int):
    """A feature's log-odds where it speaks for toxicity, null elsewhere."""
    a, b = toxic + 0.5, clean + 0.5
    odds = F.log(a / (n_toxic + 1)) - F.log(b / (n_clean + 1))
    return F.when((toxic >= LEAST_DOCUMENTS) & (odds / F.sqrt(1 / a + 1 / b) >= LEAST_Z) & (odds >= log(4)), odds)


def _evidence(held, names: np.ndarray, weights: np.ndarray):
    """The columns of a batch but text, with the sum of the weights of each text's distinct features."""
    bits = 20
    sieve = np.zeros(1 << bits, bool)
    sieve[(names >> U64(64 - bits)).astype(np.int64)] = True

    def sums(model: Model, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        if not len(names):
            return np.zeros(n)
        text, feature = text_features(model, raw, offsets)
        near = sieve[(feature >> U64(64 - bits)).astype(np.int64)]
        text, feature = text[near], feature[near]
        at = np.minimum(np.searchsorted(names, feature), len(names) - 1)
        good = names[at] == feature
        pair = np.unique(text[good].astype(np.int64) * len(names) + at[good])
        return np.bincount(pair // len(names), weights=weights[pair % len(names)], minlength=n).astype(np.float64)  # of nothing it makes integers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model_of(held)
        for batch in batches:
            others = [c for c in batch.schema.names if c != "text"]
            for first, end, raw, offsets in slices(batch):
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(first, end - first) for c in others), pa.array(sums(model, raw, offsets))], [*others, "evidence"])

    return run


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of P(y) = 1 / (1 + exp(-(slope * x + shift))), lightly held back."""
    a, b = 0.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
        w = p * (1 - p) + 1e-6
        g = np.array([((p - y) * x).sum() + 0.1 * a, (p - y).sum() + 1e-3 * b])
        h = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -2, 2)), b - float(np.clip(step[1], -2, 2))
    return a, b


def _learned(docs: DataFrame, known: DataFrame, held, sample: int) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Features and their weights, slope and shift of the score, from a bounded number of labelled documents."""
    nothing = np.zeros(0, np.uint64), np.zeros(0), 0.0, -40.0
    ids = [(r["doc_id"], k) for k in (0, 1) for r in bounded_ids(known.filter(F.col("label") == k), sample, 29).collect()]
    if not any(k for _, k in ids):
        return nothing
    chosen = F.broadcast(docs.sparkSession.createDataFrame(ids, "doc_id long, label int"))  # 2 x sample ids at most
    rows = docs.join(chosen, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    half = F.pmod(F.xxhash64(F.substring(F.coalesce("text", F.lit("")), 1, 40)), F.lit(2)).cast("int")
    rows = staged(rows.select("label", half.alias("half"), "text"), "sample")
    size = {(r["label"], r["half"]): r["count"] for r in rows.groupBy("label", "half").count().collect()}
    n = {(label, half): size.get((label, half), 0) for label in (0, 1) for half in (0, 1)}
    counts = rows.mapInArrow(_documents_with(held), "feature long, " + ", ".join(f"{c} long" for c in COUNTS)).groupBy("feature").agg(*(F.sum(c).alias(c) for c in COUNTS))
    toxic, clean = F.col("toxic_0") + F.col("toxic_1"), F.col("clean_0") + F.col("clean_1")
    odds = [_odds(F.col(f"toxic_{k}"), F.col(f"clean_{k}"), n[1, k], n[0, k]) for k in (0, 1)]
    odds.append(_odds(toxic, clean, n[1, 0] + n[1, 1], n[0, 0] + n[0, 1]))
    strong = counts.select("feature", *(o.alias(f"odds_{k}") for k, o in enumerate(odds))).filter("odds_0 is not null or odds_1 is not null or odds_2 is not null").toPandas()

    def learned(k: int) -> tuple[np.ndarray, np.ndarray]:
        own = strong[strong[f"odds_{k}"].notna()].sort_values("feature")
        names = own["feature"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(names)
        return names[order], own[f"odds_{k}"].to_numpy(np.float64)[order]

    told = [rows.filter(F.col("half") == 1 - k).select("label", "text").mapInArrow(_evidence(held, *learned(k)), "label int, evidence double") for k in (0, 1)]
    told = told[0].union(told[1]).toPandas().sort_values(["label", "evidence"])
    if not told["label"].any():
        return nothing
    return *learned(2), *_logistic(np.log1p(told["evidence"].to_numpy()), told["label"].to_numpy(np.float64))


def score_toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of each document."""
    docs = docs.select("doc_id", "text")
    held = _held_model(docs.sparkSession, fit_model(docs))
    names, weights, slope, shift = _learned(docs, trusted(labels, "toxic", modulus, remainder), held, sample)
    scored = docs.mapInArrow(_evidence(held, names, weights), "doc_id long, evidence double")
    score = 1 / (1 + F.exp(-(F.log1p("evidence") * slope + shift)))
    return scored.select("doc_id", F.coalesce(held_out("doc_id", modulus, remainder), F.lit(False)).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def restored(docs: DataFrame) -> DataFrame:
    """doc_id, text with noisy pieces restored under the language model of ``docs``."""
    held = _held_model(docs.sparkSession, fit_model(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model_of(held)
        for batch in batches:
            texts = [restore(model, t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, text string")


def op2_noisy_channel(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_toxicity(docs, labels)
