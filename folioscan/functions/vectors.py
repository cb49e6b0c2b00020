"""Vector arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokens import words

#: Least length that a vector is divided by.
NORM_FLOOR = 1e-10


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def normalised(v: Column) -> Column:
    """The vector over its length, which counts as NORM_FLOOR at least.

    The length is bound by an outer lambda; named inside the inner one, it would be worked out
    again for every component.
    """
    length = F.greatest(norm(v), F.lit(NORM_FLOOR))
    return F.get(F.transform(F.array(length), lambda n: F.transform(v, lambda x: x / n)), 0)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(NORM_FLOOR)) * F.greatest(norm(b), F.lit(NORM_FLOOR)))


def bucket(word: Column, dim: int) -> Column:
    """Feature hashing: the first 32 bits of the word's MD5, modulo ``dim``."""
    return (F.conv(F.substring(F.md5(word.cast("binary")), 1, 8), 16, 10).cast("long") % dim).cast("int")


def hashed_postings(rows: DataFrame, key: str, text: str, dim: int) -> DataFrame:
    """key, bucket, tf of hashed bags of words; a text without words has one row with a null bucket.

    Texts are dealt by key once; counting a key's words, hashing each different one, counting its
    buckets and listing them all stay in that task.
    """
    dealt = rows.select(key, text).repartition(key)
    counted = dealt.select(key, F.explode_outer(words(F.col(text))).alias("word")).groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(key, bucket(F.col("word"), dim).alias("bucket")).agg(F.sum("n").alias("tf"))


def hashed_vectors(rows: DataFrame, key: str, text: str, dim: int, empty: bool = False) -> DataFrame:
    """key, buckets, weights: sparse vectors of unit length; texts without words have none, or empty ones if ``empty``."""
    one = F.when(F.col("bucket").isNotNull(), F.struct("bucket", "tf"))
    square = F.when(F.col("bucket").isNotNull(), F.col("tf").cast("double") * F.col("tf"))
    length = F.greatest(F.sqrt(F.sum(square)), F.lit(NORM_FLOOR))
    listed = hashed_postings(rows, key, text, dim).groupBy(key).agg(F.sort_array(F.collect_list(one)).alias("p"), length.alias("length"))
    found = listed if empty else listed.filter(F.size("p") > 0)
    return found.select(key, F.col("p.bucket").alias("buckets"), F.transform("p", lambda x: x["tf"] / F.col("length")).alias("weights"))
