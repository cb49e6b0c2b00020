"""The persisted index: append, upsert, rebuild, clear, statistics, and the ingest manifest.

A collection is a folder of Parquet versions and a small JSON pointer to the current one. Append
adds files to the current version. Everything that replaces rows writes a new version first and
then moves the pointer, so a reader never meets a half-written state and a failed job leaves the
old version in place.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..options import Options
from ..schema import CHUNK, INDEX, MANIFEST


def collection_name(model: Column, is_path: Column | None = None) -> Column:
    """The collection of an embedding model: ``kb_`` and a tag of at most 40 safe characters."""
    plain = F.replace(F.replace(model, F.lit("/"), F.lit("_")), F.lit("-"), F.lit("_"))
    if is_path is not None:
        plain = F.when(is_path, F.regexp_extract(model, "[^/]+$", 0)).otherwise(plain)
    tag = F.lower(F.regexp_replace(plain, "[^a-zA-Z0-9_]", "_"))
    tag = F.when(F.length(tag) < 3, F.lit("default_model")).otherwise(tag)
    return F.concat(F.lit("kb_"), F.substring(tag, 1, 40))


class _Files:
    """Small text files through Hadoop's file systems, local or remote."""

    def __init__(self, spark: SparkSession) -> None:
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _open(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.conf)

    def read(self, path: str) -> str | None:
        p, fs = self._open(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        p, fs = self._open(path)
        stream = fs.create(p, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def delete(self, path: str) -> None:
        p, fs = self._open(path)
        fs.delete(p, True)


Embed = Callable[[DataFrame], DataFrame]


def _as_they_are(rows: DataFrame) -> DataFrame:
    return rows


def _unique(rows: DataFrame) -> None:
    """Several rows of one chunk_id are an error, told before anything is embedded."""
    twice = rows.groupBy("chunk_id").count().filter("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"chunk ids given twice: {sorted(r['chunk_id'] for r in twice)}")


class Collection:
    """``embed`` of the writing methods adds buckets and weights to rows of chunks; rows that have them need none."""

    def __init__(self, spark: SparkSession, options: Options = Options(), name: str | None = None) -> None:  # noqa: B008
        self.spark, self.options, self.files = spark, options, _Files(spark)
        self.name = name or spark.range(1).select(collection_name(F.lit(options.embedding_model))).first()[0]
        self.folder = f"{options.warehouse}/{self.name}"

    def _version(self) -> str | None:
        text = self.files.read(f"{self.folder}/current.json")
        return json.loads(text)["version"] if text else None

    def read(self) -> DataFrame:
        version = self._version()
        if version is None:
            return self.spark.createDataFrame([], INDEX)
        return self.spark.read.schema(INDEX).parquet(f"{self.folder}/{version}")

    def _replace(self, rows: DataFrame) -> None:
        before, after = self._version(), f"v-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{after}")
        self.files.write(f"{self.folder}/current.json", json.dumps({"version": after}))
        if before:
            self.files.delete(f"{self.folder}/{before}")

    def append(self, rows: DataFrame, embed: Embed = _as_they_are) -> None:
        """Insert rows whose chunk_id is new; existing ids stay as they are, and only what is inserted is embedded."""
        _unique(rows)
        version = self._version()
        if version is None:
            self._replace(embed(rows).select(self.read().columns))
            return
        embed(absent_rows(rows, self.read())).select(self.read().columns).write.mode("append").parquet(f"{self.folder}/{version}")

    def upsert(self, rows: DataFrame, embed: Embed = _as_they_are) -> None:
        """Rows of the sources in ``rows`` replace those sources' rows."""
        _unique(rows)
        old = self.read()
        self._replace(old.join(rows.select("source").distinct(), "source", "left_anti").select(old.columns).unionByName(embed(rows).select(old.columns)))

    def rebuild(self, rows: DataFrame, embed: Embed = _as_they_are) -> None:
        _unique(rows)
        self._replace(embed(rows).select(self.read().columns))

    def clear(self) -> None:
        """Empty the collection; the manifest goes as well, so that the next ingest sees a change."""
        self._replace(self.spark.createDataFrame([], INDEX))
        self.files.delete(self.manifest_path)

    def is_empty(self) -> bool:
        return self.read().isEmpty()

    def stats(self) -> DataFrame:
        """One row: vector_store and config structs."""
        store = F.struct(F.lit(self.name).alias("collection_name"), F.count(F.lit(1)).alias("document_count"), F.lit(self.options.warehouse).alias("persist_dir"))
        config = F.struct(F.lit(self.options.chunk_size).alias("chunk_size"), F.lit(self.options.top_k).alias("top_k"), F.lit(self.options.score_threshold).alias("threshold"))
        return self.read().agg(store.alias("vector_store")).select("vector_store", config.alias("config"))

    @property
    def manifest_path(self) -> str:
        return f"{self.folder}/manifest.json"

    def manifest(self) -> DataFrame:
        """The saved manifest: one row, or none when it is missing or is no JSON object."""
        text = self.files.read(self.manifest_path)
        rows = self.spark.createDataFrame([(text,)] if text else [], "value string")
        return rows.select(F.from_json("value", MANIFEST).alias("m")).filter("m is not null and m.signature is not null").select("m.*")

    def save_manifest(self, signature: DataFrame, stats: DataFrame) -> None:
        row = signature.crossJoin(stats)  # one row each
        state = row.select(F.struct("signature", F.struct("success", "failed", "total_chunks", "vector_count").alias("last_stats")).alias("m"))
        self.files.write(self.manifest_path, state.select(F.to_json("m", {"pretty": "true"})).first()[0])


def absent_rows(rows: DataFrame, existing: DataFrame) -> DataFrame:
    return rows.join(existing.select("chunk_id"), "chunk_id", "left_anti")


def signature(listing: DataFrame, params: str) -> DataFrame:
    """One row: the files by name, size and mtime, and the parameters that the index depends on."""
    files = F.array_sort(F.collect_list(F.struct(F.col("name"), F.col("size").cast("long").alias("size"), F.col("mtime").cast("long").alias("mtime"))))
    return listing.agg(files.alias("files")).select(F.struct("files", F.lit(params).alias("params")).alias("signature"))


def ingest_stats(parsed: DataFrame, chunks: DataFrame, before: int = 0) -> DataFrame:
    """success, failed, total_chunks, vector_count; a file without chunks is a success."""
    files = parsed.agg(F.count_if(F.col("error").isNull()).alias("success"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    counts = chunks.agg(F.count(F.lit(1)).alias("total_chunks"))
    return files.crossJoin(counts).withColumn("vector_count", F.lit(before) + F.col("total_chunks"))  # one row each


def dataset_index(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: total_documents, document_list in order of name, total_chunks."""
    named = documents.agg(F.count(F.lit(1)).alias("total_documents"), F.array_sort(F.collect_list("source")).alias("document_list"))
    return named.crossJoin(chunks.agg(F.count(F.lit(1)).alias("total_chunks")))  # one row each


def write_dataset_index(index: DataFrame, path: str) -> None:
    """Write the row of ``dataset_index`` as one JSON file, for people; the list is that of one folder."""
    text = index.select(F.to_json(F.struct("*"), {"pretty": "true"})).first()[0]
    _Files(index.sparkSession).write(path, text)


def documents(spark: SparkSession, contents: list[str], metadata: list[dict] | None = None) -> DataFrame:
    """Chunks given in code: chunk_id (``doc_`` and the place in the list where the metadata has none), the known columns, and the rest of the metadata as extra."""
    known = ("chunk_id", "source", "file_path", "chunk_index")
    rows = []
    for i, (content, own) in enumerate(zip(contents, metadata or [{}] * len(contents), strict=True)):
        extra = {k: str(v) for k, v in own.items() if k not in known}
        rows.append((own.get("chunk_id", f"doc_{i}"), own.get("source"), own.get("file_path"), own.get("chunk_index"), content, extra or None))
    return spark.createDataFrame(rows, CHUNK)
