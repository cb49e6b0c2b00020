"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text, an estimated class prior, and the non-negative unbiased
risk: prior * E_p[loss(+f)] + max(0, E_u[loss(-f)] - prior * E_p[loss(-f)]) for a linear f with
logistic loss, minimised by Adam; where the second term is negative, its gradient is reversed.

Inputs of f are shares of byte-class pairs in a text, and how much of it is repeated lines and
words that follow themselves; ids, languages and sources take no part. They are scaled by the
distance of quantiles, which a few odd texts don't move.

The prior is a ratio of the unlabelled to the positive documents above a threshold. Documents fall
into two halves by a hash of their id, and a first classifier fitted on either half scores the
other one, so that no document's score comes from itself. The threshold is the one where the ratio
with an allowance for chance is least; the prior is the ratio there, without that allowance. These
counts cover all documents. The fits use at most ``SAMPLE`` positives and as many unlabelled
documents, chosen by a hash of their id.

Defined cases: null and empty texts have features of 0 and get a score; very long texts count as a
whole, whatever a slice holds; a label that is null or contradicted by another row takes no part;
repeated rows are scored alike; rows that share an id are scored by their own texts, and only one of
them may serve for fitting; without positives or without unlabelled documents every score is 0.5; a
row with a null doc_id is scored, is not held out and doesn't serve for fitting; an empty table
gives no rows; other columns are ignored, and ``accepted`` keeps them, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import edges, slices, span_hashes
from .common import bounded_ids, held_out, staged

SAMPLE = 6000
BINS = 400
#: What is added to a feature's spread before it divides, and the weight decay of the fit.
FLOOR, DECAY = 0.005, 1e-3
_CLASSES = 20


def _byte_classes() -> np.ndarray:
    table = np.full(256, 19, np.int64)  # other ASCII punctuation
    for b in range(256):
        c = chr(b)
        if b >= 128:
            table[b] = 0
        elif c.islower():
            table[b] = 1
        elif c.isupper():
            table[b] = 2
        elif c.isdigit():
            table[b] = 3
        elif c == "\n":
            table[b] = 4
        elif c.isspace() or b < 32:
            table[b] = 5
        elif c in ".,!?#$%&*|-_/":
            table[b] = 6 + ".,!?#$%&*|-_/".index(c)
    return table


BYTE_CLASS = _byte_classes()
FEATURES = _CLASSES * _CLASSES + 4


def features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES numbers for each text."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    out = np.zeros((n, FEATURES), np.float32)
    pairs = _CLASSES * _CLASSES
    if len(raw):
        own = np.repeat(np.arange(n, dtype=np.int64) * pairs, sizes)
        kind = BYTE_CLASS[raw]
        code = own[1:] + kind[:-1] * _CLASSES + kind[1:]
        code = code[own[1:] == own[:-1]]
        counts = np.bincount(code, minlength=n * pairs).reshape(n, pairs)
        out[:, :pairs] = np.sqrt(counts / np.maximum(1, sizes - 1)[:, None])
        text, start, end = edges(raw != 10, offsets)
        if len(text):
            hashes = span_hashes(raw.astype(np.uint64) + np.uint64(1), start, end)
            order = np.lexsort((hashes, text))
            again = np.zeros(len(text), bool)
            again[order[1:]] = (text[order[1:]] == text[order[:-1]]) & (hashes[order[1:]] == hashes[order[:-1]])
            length = end - start
            out[:, pairs] = np.bincount(text, weights=length * again, minlength=n) / np.maximum(1, sizes)
            out[:, pairs + 1] = np.bincount(text, weights=again, minlength=n) / np.maximum(1, np.bincount(text, minlength=n))
        text, start, end = edges((raw != 32) & ((raw < 9) | (raw > 13)), offsets)
        if len(text) > 1:
            hashes = span_hashes(raw.astype(np.uint64) + np.uint64(1), start, end)
            again = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
            out[:, pairs + 3] = np.sqrt(np.bincount(text[1:], weights=again, minlength=n) / np.maximum(1, np.bincount(text, minlength=n)))
    out[:, pairs + 2] = np.log1p(sizes) / 10
    return out


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id")
        for first, end, raw, offsets in slices(batch):
            rows = features(raw, offsets).astype(np.float16)
            yield pa.RecordBatch.from_arrays([ids.slice(first, end - first), pa.array([r.tobytes() for r in rows], pa.binary())], ["doc_id", "features"])


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.Array):
        column = column.to_pylist()
    return np.frombuffer(b"".join(bytes(x) for x in column), np.float16).reshape(-1, FEATURES).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = 400, rate: float = 0.05, decay: float = DECAY) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk."""
    d = positive.shape[1]
    theta = np.zeros(d + 1)
    first, second = np.zeros(d + 1), np.zeros(d + 1)
    p = np.hstack([positive, np.ones((len(positive), 1), np.float32)])
    u = np.hstack([unlabelled, np.ones((len(unlabelled), 1), np.float32)])
    for t in range(1, rounds + 1):
        fp, fu = p @ theta, u @ theta
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        grad_negative = u.T @ (_sigmoid(fu) / len(u)) - prior * (p.T @ (_sigmoid(fp) / len(p)))
        if negative < 0:
            grad = -grad_negative
        else:
            grad = -prior * (p.T @ (_sigmoid(-fp) / len(p))) + grad_negative
        grad[:-1] += decay * theta[:-1]
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        theta -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return theta[:-1], float(theta[-1])


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The ratio of the unlabelled to the positive share above a threshold; arguments are histograms by score.

    The threshold is where the ratio and its allowance for chance are least together.
    """
    n_p, n_u = positive.sum(), unlabelled.sum()
    if not n_p or not n_u:
        return 0.5
    p, u = np.cumsum(positive[::-1]) / n_p, np.cumsum(unlabelled[::-1]) / n_u
    wide = np.flatnonzero(p >= 0.1)
    allowance = np.sqrt(np.log(40) / 2) * (n_p**-0.5 + n_u**-0.5)
    best = wide[np.argmin((u[wide] + allowance) / p[wide])]
    return float(np.clip(u[best] / p[best], 0.02, 0.98))


class Linear:
    """Weights and bias for unscaled features."""

    def __init__(self, weights: np.ndarray, bias: float, centre: np.ndarray, scale: np.ndarray) -> None:
        self.weights = weights / scale
        self.bias = bias - float(centre @ self.weights)

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        return _sigmoid(rows @ self.weights + self.bias).astype(np.float64)


def scaling(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centre and scale of each feature; 3.3 is the distance of these quantiles in a normal distribution."""
    low, high = np.quantile(rows, [0.05, 0.95], axis=0)
    return rows.mean(axis=0), (high - low) / 3.3 + FLOOR


def _half(doc_id: str):
    return F.pmod(F.xxhash64(doc_id, F.lit(23)), F.lit(2)).cast("int")


def _scored(halves: list[Linear]):
    """doc_id and score; ``halves`` has the classifier of each half, or one for all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                rows = _matrix(batch.column("features"))
                score = halves[0](rows)
                if len(halves) == 2:
                    score = np.where(batch.column("half").to_numpy() == 0, score, halves[1](rows))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    return run


def trusted(labels: DataFrame, column: str, modulus: int, remainder: int) -> DataFrame:
    """doc_id, label of the rows that may be learned from."""
    own = labels.filter(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id", modulus, remainder))
    return own.groupBy("doc_id").agg(F.min(column).alias("label"), F.max(column).alias("_high")).filter("label = _high").select("doc_id", "label")


def _gathered(rows: DataFrame, ids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Features and halves of one row of each of a bounded number of ids."""
    own = rows.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("features").alias("features"))
    own = own.select("features", _half("doc_id").alias("half"), "doc_id").toPandas().sort_values("doc_id")
    return _matrix(own["features"]), own["half"].to_numpy()


def fit(rows: DataFrame, labels: DataFrame, modulus: int, remainder: int, sample: int) -> Linear | None:
    """The classifier for rows of doc_id, features; None if there is nothing to learn from."""
    known = trusted(labels, "quality", modulus, remainder)
    named = staged(rows.filter("doc_id is not null").select("doc_id").join(known, "doc_id", "left"), "named")
    (p, p_half), (u, u_half) = (_gathered(rows, bounded_ids(named.filter(which), sample, 17)) for which in ("label = 1", "label is null"))
    if len(p) == 0 or len(u) == 0:
        return None
    centre, scale = scaling(u)
    p, u = (p - centre) / scale, (u - centre) / scale
    halves = []
    for k in (0, 1):
        own_p, own_u = p[p_half != k], u[u_half != k]
        if len(own_p) == 0 or len(own_u) == 0:
            own_p, own_u = p, u
        halves.append(Linear(*fit_nnpu(own_p, own_u, 0.5, rounds=150), centre, scale))
    scored = rows.filter("doc_id is not null").select("doc_id", "features", _half("doc_id").alias("half")).mapInArrow(_scored(halves), "doc_id long, score double")
    bins = F.least(F.lit(BINS - 1), F.floor(F.col("score") * BINS)).cast("int").alias("bin")
    binned = scored.join(known, "doc_id", "left").groupBy(bins).agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label").isNull()).alias("u")).collect()
    counts = np.zeros((2, BINS))
    for r in binned:
        counts[:, r["bin"]] = r["p"], r["u"]
    return Linear(*fit_nnpu(p, u, estimate_prior(*counts)), centre, scale)


def _features_of(docs: DataFrame) -> DataFrame:
    return staged(docs.select("doc_id", "text").mapInArrow(_featured, "doc_id long, features binary"), "features")


def score_quality(docs: DataFrame, labels: DataFrame, modulus: int = 3, remainder: int = 1, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of each document."""
    rows = _features_of(docs)
    model = fit(rows, labels, modulus, remainder, sample)
    scored = rows.select("doc_id", F.lit(0.5).alias("score")) if model is None else rows.mapInArrow(_scored([model]), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out("doc_id", modulus, remainder), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_pu_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_quality(docs, labels)


def accepted(docs: DataFrame, labels: DataFrame, modulus: int = 3, remainder: int = 1, sample: int = SAMPLE) -> DataFrame:
    """The rows that the classifier does not reject, each by its own text."""
    model = fit(_features_of(docs), labels, modulus, remainder, sample)
    if model is None:
        return docs
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([batch.column(at)], ["text"])
            for first, end, raw, offsets in slices(texts):
                rows = features(raw, offsets).astype(np.float16).astype(np.float32)
                yield batch.slice(first, end - first).filter(pa.array(model(rows) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
