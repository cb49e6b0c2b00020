"""Embedders: what turns texts into unit vectors. All give key, buckets, weights (sparse, of unit length);
texts without a vector are left out, or have an empty one if ``empty``.

``Hashed`` needs no model and runs as column expressions; ``Precomputed`` looks vectors up in a
table; ``Custom`` calls a model, in batches, inside Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import NORM_FLOOR, doubles, hashed_vectors, normalised


@dataclass(frozen=True)
class Hashed:
    dim: int = 1024

    def vectors(self, rows: DataFrame, key: str, text: str, empty: bool = False) -> DataFrame:
        return hashed_vectors(rows, key, text, self.dim, empty)


@dataclass(frozen=True)
class Precomputed:
    """``table`` has the key under ``key`` and an array of numbers under ``vector``; texts without a vector have none."""

    table: DataFrame
    dim: int
    key: str = "key"
    vector: str = "vector"

    def vectors(self, rows: DataFrame, key: str, text: str, empty: bool = False) -> DataFrame:
        unit = normalised(doubles(F.col(self.vector)))
        own = self.table.select(F.col(self.key).alias(key), F.sequence(F.lit(0), F.size(self.vector) - 1).alias("buckets"), unit.alias("weights"))
        if not empty:
            return rows.select(key).join(own, key)
        none = F.array().cast("array<int>"), F.array().cast("array<double>")
        return rows.select(key).join(own, key, "left").select(key, F.coalesce("buckets", none[0]).alias("buckets"), F.coalesce("weights", none[1]).alias("weights"))


@dataclass(frozen=True)
class Custom:
    """``encode`` takes a list of texts and gives a row of ``dim`` numbers for each, in order; it gets ``batch_size`` texts at most."""

    encode: Callable[[list[str]], Sequence[Sequence[float]]]
    dim: int
    batch_size: int = 10
    normalise: bool = True

    def vectors(self, rows: DataFrame, key: str, text: str, empty: bool = False) -> DataFrame:
        kind = dict(rows.dtypes)[key]
        encode, dim, size, normalise = self.encode, self.dim, self.batch_size, self.normalise

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = [t or "" for t in batch.column(text).to_pylist()]
                found = [np.asarray(encode(texts[i : i + size]), float).reshape(-1, dim) for i in range(0, len(texts), size)]
                matrix = np.concatenate([*found, np.zeros((0, dim))])
                if len(matrix) != len(texts):
                    raise ValueError(f"the embedder gave {len(matrix)} vectors for {len(texts)} texts")
                if normalise:
                    matrix = matrix / np.maximum(np.sqrt((matrix**2).sum(axis=1, keepdims=True)), NORM_FLOOR)
                ends = pa.array(np.arange(0, (len(texts) + 1) * dim, dim, dtype=np.int32))
                buckets = pa.ListArray.from_arrays(ends, pa.array(np.tile(np.arange(dim, dtype=np.int32), len(texts))))
                yield pa.RecordBatch.from_arrays([batch.column(key), buckets, pa.ListArray.from_arrays(ends, pa.array(matrix.ravel()))], [key, "buckets", "weights"])

        return rows.select(key, text).mapInArrow(run, f"`{key}` {kind}, buckets array<int>, weights array<double>")
