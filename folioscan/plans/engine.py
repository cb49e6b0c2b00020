"""The engine: ingest, questions, statistics, and ingestion when something has changed."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import remote
from ..functions.chunking import recursive_chunks, with_chunk_ids
from ..functions.embedders import Hashed
from ..functions.tokens import STOP_WORDS
from ..operators import answer, retrieve, store
from ..options import Options
from ..schema import INGEST
from ..sources import files


#: What is cut off a question's ends; a question of nothing else is blank.
_NOT_SPACE = r"[^\x09-\x0D\x1C-\x20\x85\p{Z}]"
VERSION = "1.0.0"


class Engine:
    """``embedder``, ``generator`` and ``parsers`` are the replaceable parts; see ``functions.embedders``, ``functions.remote``, ``operators.answer`` and ``sources.files``.

    Without an embedder or a generator of its own an engine takes the remote model whose address the
    options have, and otherwise hashed words and the best context line.
    """

    def __init__(self, spark: SparkSession, options: Options = Options(), embedder=None, generator=None, parsers=None, stop_words: tuple[str, ...] = STOP_WORDS) -> None:  # noqa: B008
        self.spark, self.options, self.parsers, self.stop_words = spark, options, parsers, stop_words
        self.embedder = embedder or (remote.embedder(options) if options.embedding_api_base else Hashed(options.embedding_dim))
        self.generator = generator or (remote.generator(options) if options.llm_api_base else None)
        self.collection = store.Collection(spark, options)

    def chunked(self, parsed: DataFrame) -> DataFrame:
        good = parsed.filter("error is null")
        return with_chunk_ids(recursive_chunks(good, ["source", "file_path", "extra"], size=self.options.chunk_size, overlap=self.options.chunk_overlap))

    def indexed(self, chunks: DataFrame) -> DataFrame:
        vectors = retrieve.text_index(chunks, self.embedder).withColumnRenamed("item", "chunk_id")
        return chunks.join(vectors, "chunk_id")

    def ingest(self, scanned: DataFrame, mode: str = "append") -> DataFrame:
        """Parse, split, embed and store files; one row of counts. A file that can't be parsed is counted and left out."""
        return self.ingest_texts(files.parse(scanned, self.parsers), mode)

    def ingest_texts(self, parsed: DataFrame, mode: str = "append") -> DataFrame:
        """The same for texts: source, file_path, text, and error and extra (map<string,string>, kept with each chunk) where they are given."""
        for name, kind in (("error", "string"), ("extra", "map<string,string>")):
            if name not in parsed.columns:
                parsed = parsed.withColumn(name, F.lit(None).cast(kind))
        parsed = parsed.cache()
        chunks = self.chunked(parsed).cache()
        try:
            getattr(self.collection, mode)(chunks, self.indexed)
            counts = store.ingest_stats(parsed, chunks).drop("vector_count").first()
        finally:
            parsed.unpersist()
            chunks.unpersist()
        return self.spark.createDataFrame([(counts["success"], counts["failed"], counts["total_chunks"], self.collection.read().count())], INGEST)

    def ingest_paths(self, paths: list[str], mode: str = "append") -> DataFrame:
        """Ingest files by path; a path that is no file counts as failed."""
        scanned, gone = files.scan_paths(self.spark, paths)
        return self.ingest_texts(files.parse(scanned, self.parsers).unionByName(files.missing(self.spark, gone)), mode)

    def ingest_directory(self, directory: str, mode: str = "append") -> DataFrame:
        return self.ingest(files.scan(self.spark, directory, self.options.supported_exts), mode)

    def add_documents(self, contents: list[str], metadata: list[dict] | None = None) -> int:
        """Store prepared chunks; how many. Without a chunk_id in its metadata a chunk is named by its place in the list."""
        rows = store.documents(self.spark, contents, metadata)
        if contents:
            self.collection.append(rows, self.indexed)
        return len(contents)

    def upload(self, uploads: dict[str, bytes], directory: str) -> DataFrame:
        """Land uploaded files in a folder and ingest them: message, stats."""
        paths = [files.land(self.spark, directory, name, content) for name, content in uploads.items()]
        return self._told(f"{len(paths)} files uploaded", self.ingest_paths(paths))

    def _told(self, message: str, stats: DataFrame) -> DataFrame:
        return stats.select(F.lit(message).alias("message"), F.struct("*").alias("stats"))

    def rebuild(self, directory: str) -> DataFrame:
        return self.ingest_directory(directory, "rebuild")

    def _params(self) -> str:
        o = self.options
        return hashlib.sha256(f"{o.chunk_size},{o.chunk_overlap},{o.embedding_model},{self.embedder.dim}".encode()).hexdigest()[:16]

    def ingest_if_changed(self, directory: str) -> str:
        """``empty``, ``cached``, ``reindexed``, or ``error: ...``; the manifest tells whether files or parameters have changed."""
        try:
            scanned = files.scan(self.spark, directory, self.options.supported_exts)
            if scanned.select("path").isEmpty():
                return "empty"
            now = store.signature(files.listing(scanned), self._params())
            saved = self.collection.manifest().select("signature").first()
            if saved is not None and saved["signature"] == now.first()["signature"]:
                return "cached"
            stats = self.rebuild(directory)
            self.collection.save_manifest(now, stats)
            return "reindexed"
        except Exception as e:
            return f"error: {e}"

    def ingest_on_start(self, directory: str) -> bool:
        """Ingest a folder if the index is empty; whether that was done. A failure is reported, not raised."""
        try:
            if not self.options.auto_ingest or not self.collection.is_empty():
                return False
            self.ingest_directory(directory)
            return True
        except Exception as e:
            print(f"ingest on start failed: {e}")
            return False

    def hits(self, questions: DataFrame) -> DataFrame:
        """query_id, rank, chunk_id, content, source, score, path; a question's own top_k counts where it is given and not 0."""
        o, index = self.options, self.collection.read()
        limit = F.coalesce(F.nullif(F.col("top_k"), F.lit(0)), F.lit(o.top_k))
        asked = questions.filter(F.col("question").rlike(_NOT_SPACE)).withColumn("limit", limit)
        most = asked.agg(F.max("limit")).first()[0] or o.top_k
        found = retrieve.retrieve_with_fallback(asked, index.withColumnRenamed("chunk_id", "item"), self.embedder, most, o.score_threshold, stop_words=self.stop_words)
        named = found.join(asked.select("query_id", "limit"), "query_id").filter("rank <= limit").withColumnRenamed("item", "chunk_id")
        return named.join(index.select("chunk_id", "content", "source"), "chunk_id").select("query_id", "rank", "chunk_id", "content", "source", "score", "path")

    def answer(self, questions: DataFrame) -> DataFrame:
        return answer.answers(questions, self.hits(questions), self.generator)

    def stats(self) -> DataFrame:
        return self.collection.stats()

    def health(self) -> DataFrame:
        """One row: status and the statistics."""
        return self.stats().select(F.lit("healthy").alias("status"), F.struct("vector_store", "config").alias("stats"))

    def about(self) -> DataFrame:
        return self.spark.createDataFrame([("folioscan answers questions from documents", VERSION)], "message string, version string")

    def rebuilt(self, directory: str) -> DataFrame:
        """Rebuild from a folder: message, stats; an empty folder leaves an empty index."""
        stats = self.rebuild(directory)
        n = stats.select(F.col("success") + F.col("failed")).first()[0]
        return self._told(f"index rebuilt from {n} files" if n else "index cleared, no files found", stats)

    def clear(self) -> DataFrame:
        self.collection.clear()
        return self.spark.createDataFrame([("index cleared",)], "message string")
