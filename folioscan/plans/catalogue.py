"""The engine's queries over the test tables, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chunking, embedders, tokens, vectors
from ..operators import answer, buckets, retrieve, store
from ..options import Options

Query = Callable[[SparkSession, str], DataFrame]
OPTIONS = Options()
DIM = OPTIONS.embedding_dim
EMBEDDER = embedders.Hashed(DIM)
#: Questions of the vector queries: the stated set of ids that this number divides.
QUERY_STEP = 50
#: Words of the stop-word query; the default list is Chinese.
FREQUENT = ("the", "and", "of", "de", "la", "und", "die", "que")
MODELS = ("text-embedding-v3", "BAAI/bge-m3", "a", "x" * 60, "Öl/modell-2", "m3")

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Parts of the SQL --------------------------------------------------------------------------------

UNIT = """unit AS (
  SELECT vec_id, list_transform(v, lambda x: x / greatest(sqrt(list_sum(list_transform(v, lambda y: y * y))), 1e-10)) AS u
  FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings))"""
SCORED = f"""{UNIT}, scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, round(list_sum(list_transform(list_zip(q.u, d.u), lambda z: z[1] * z[2])), 9) AS s
  FROM unit q, unit d WHERE q.vec_id % {QUERY_STEP} = 0)"""


def _nearest_sql(threshold: float | None) -> str:
    keep = "" if threshold is None else f"WHERE s >= {threshold}"
    return f"""WITH {SCORED}, ranked AS (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id)::INTEGER AS rank FROM scored {keep})
      SELECT query_id, rank, vec_id, s AS score FROM ranked WHERE rank <= 5"""


WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"
WINDOWS = """chunks AS (
  SELECT doc_id, source, i::INTEGER AS chunk_index, substr(text, (i * 412 + 1)::BIGINT, 512) AS content, doc_id || '_' || i AS chunk_id
  FROM (SELECT doc_id, source, text, unnest(range(0, greatest(0, ceil((length(text) - 512) / 412.0))::BIGINT + 1)) AS i FROM documents WHERE length(text) > 0))"""


def _vectors_sql(name: str, source: str, item: str, text: str) -> str:
    return f"""{name}_tf AS (
      SELECT item, ('0x' || substr(md5(w), 1, 8))::BIGINT % {DIM} AS bucket, count(*) AS tf
      FROM (SELECT {item} AS item, unnest({WORDS.format(text)}) AS w FROM {source}) GROUP BY ALL),
    {name} AS (SELECT item, bucket, tf / sqrt(sum(tf * tf) OVER (PARTITION BY item)) AS w FROM {name}_tf)"""


def _text_scores_sql(source: str, item: str, text: str) -> str:
    return f"""{_vectors_sql("d", source, item, text)}, {_vectors_sql("q", "benchmark", "item_id", "text")},
    hits AS (SELECT q.item AS query_id, d.item AS item, round(sum(q.w * d.w), 9) AS s FROM q JOIN d USING (bucket) GROUP BY ALL),
    primary_hits AS (
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item)::INTEGER AS rank FROM hits WHERE s >= {OPTIONS.score_threshold})
      WHERE rank <= 5)"""


KEYWORDS = f"""kw_words AS (
  SELECT item_id AS query_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos
  FROM (SELECT item_id, CASE WHEN len(list_filter(w, lambda x: length(x) > 1)) > 0 THEN list_filter(w, lambda x: length(x) > 1) ELSE w END AS w
        FROM (SELECT item_id, {WORDS.format("text")} AS w FROM benchmark))),
kw AS (
  SELECT query_id, word AS keyword, freq, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY freq DESC, p)::INTEGER AS rank
    FROM (SELECT query_id, word, count(*) AS freq, min(pos) AS p FROM kw_words GROUP BY ALL))
  WHERE rank <= 5)"""


def _keyword_hits_sql(items: str, item: str) -> str:
    return f"""kw_hits AS (
      SELECT query_id, keyword, item, s, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id, keyword ORDER BY s DESC, item)::INTEGER AS rank FROM (
          SELECT k.query_id, k.keyword, i.item, coalesce(round(d.w, 9), 0) AS s
          FROM kw k CROSS JOIN (SELECT {item} AS item FROM {items}) i
          LEFT JOIN d ON d.item = i.item AND d.bucket = ('0x' || substr(md5(k.keyword), 1, 8))::BIGINT % {DIM}))
      WHERE rank <= 5),
    fallback AS (
      SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item)::INTEGER AS rank
        FROM (SELECT query_id, item, max(s) AS s FROM kw_hits GROUP BY ALL))
      WHERE rank <= 5)"""


RETRIEVED = f"""WITH {WINDOWS}, {_text_scores_sql("chunks", "chunk_id", "content")}, {KEYWORDS}, {_keyword_hits_sql("chunks", "chunk_id")},
found AS (
  SELECT query_id, rank, item, s, 'primary' AS path FROM primary_hits
  UNION ALL SELECT query_id, rank, item, s, 'fallback' FROM fallback WHERE query_id NOT IN (SELECT query_id FROM primary_hits)),
named AS (
  SELECT f.query_id, f.rank, f.item AS chunk_id, c.content, c.source, f.s AS score, f.path,
         '[相似度：' || printf('%.2f', f.s) || '] ' || c.content AS line
  FROM found f JOIN chunks c ON c.chunk_id = f.item),
context AS (
  SELECT query_id, string_agg(line, chr(10) || chr(10) ORDER BY rank) AS context, count(*)::INTEGER AS context_used,
         string_agg(source || ' ' || chunk_id || ' ' || printf('%.3f', round(score, 3)), '; ' ORDER BY rank) AS sources
  FROM named GROUP BY query_id)
"""


# Vectors -----------------------------------------------------------------------------------------


def _dense(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, int]:
    rows = table(spark, sf_dir, "embeddings")
    index = retrieve.dense_as_sparse(rows, "vec_id", "embedding").withColumnRenamed("vec_id", "item")
    dim = rows.agg(F.max(F.size("embedding"))).first()[0] or 1
    return index.filter(F.col("item") % QUERY_STEP == 0).withColumnRenamed("item", "query"), index, dim


def _nearest(spark: SparkSession, sf_dir: str, threshold: float | None) -> DataFrame:
    questions, index, dim = _dense(spark, sf_dir)
    near = retrieve.knn(questions, index, OPTIONS.top_k, dim, threshold)
    return near.select(F.col("query").alias("query_id"), "rank", F.col("item").alias("vec_id"), "score")


@query(_nearest_sql(None))
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir, None)


@query(_nearest_sql(0.3))
def similarity_search_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir, 0.3)


@query(_nearest_sql(OPTIONS.score_threshold))
def similarity_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir, OPTIONS.score_threshold)


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vectors.norm(vectors.doubles(F.col("embedding"))), 6).alias("norm"))


@query(f"WITH {UNIT} SELECT vec_id, (generate_subscripts(u, 1) - 1)::INTEGER AS pos, round(unnest(u), 6) AS value FROM unit")
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", F.posexplode(vectors.normalised(vectors.doubles(F.col("embedding")))).alias("pos", "value")).withColumn("value", F.round("value", 6))


@query(f"WITH {SCORED} SELECT query_id, vec_id, s AS cosine FROM scored")
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row against the stated questions: the questions travel in blocks of 256, the scores are column expressions."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", vectors.normalised(vectors.doubles(F.col("embedding"))).alias("u"))
    asked = rows.filter(F.col("vec_id") % QUERY_STEP == 0)
    n_blocks = -(-asked.count() // 256) or 1
    blocks = asked.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int").alias("block")).agg(F.collect_list(F.struct("vec_id", "u")).alias("asked"))
    met = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).join(blocks, "block")
    scores = F.transform("asked", lambda q: F.struct(q["vec_id"].alias("query_id"), F.round(vectors.dot(q["u"], F.col("u")), retrieve.DIGITS).alias("cosine")))
    return met.select("vec_id", F.explode(scores).alias("s")).select("s.query_id", "vec_id", "s.cosine")


@query()
def lsh_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate neighbours by random projections: all rows that share a bucket with the question are compared.

    Questions that share a bucket with fewer than k rows are compared with every row.
    """
    found = buckets.near(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", QUERY_STEP, OPTIONS.top_k)
    return found.select(F.col("query").alias("query_id"), "rank", F.col("item").alias("vec_id"), F.round("score", 6).alias("score"))


# Words -------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, w AS word, count(*) AS tf FROM (SELECT doc_id, unnest({WORDS.format('text')}) AS w FROM documents) GROUP BY ALL")
def tokenize_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.explode(tokens.words(F.col("text"))).alias("word")).groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("tf"))


@query(f"WITH {KEYWORDS} SELECT query_id, keyword, freq, rank FROM kw")
def keywords_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.keywords(_questions(spark, sf_dir), "query_id", "question", OPTIONS.top_k)


@query(f"SELECT w AS word, count(*) AS n FROM (SELECT unnest({WORDS.format('text')}) AS w FROM documents) WHERE w NOT IN {FREQUENT} AND length(w) > 1 GROUP BY ALL")
def stopword_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    stop = spark.createDataFrame([(w,) for w in FREQUENT], "word string")
    words = table(spark, sf_dir, "documents").select(F.explode(tokens.words(F.col("text"))).alias("word")).filter(F.length("word") > 1)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).join(stop, "word", "left_anti")


@query(f"WITH {_vectors_sql('d', 'documents', 'doc_id', 'text')} SELECT item AS doc_id, bucket::INTEGER AS bucket, round(w, 6) AS weight FROM d")
def hashed_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors.hashed_vectors(table(spark, sf_dir, "documents"), "doc_id", "text", DIM)
    return rows.select("doc_id", F.explode(F.arrays_zip("buckets", "weights")).alias("p")).select("doc_id", F.col("p.buckets").alias("bucket"), F.round("p.weights", 6).alias("weight"))


# Chunks ------------------------------------------------------------------------------------------


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chunks = chunking.chunk_rows(docs, ["doc_id", "source"], chunking.fixed_windows(F.col("text"), OPTIONS.chunk_size, OPTIONS.chunk_overlap))
    return chunks.withColumn("chunk_id", F.concat_ws("_", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")))


@query(f"WITH {WINDOWS} SELECT doc_id, chunk_index, content FROM chunks")
def chunk_fixed_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir).select("doc_id", "chunk_index", "content")


@query("""WITH folded AS (
  SELECT doc_id, list_reduce(list_transform(string_split(text, chr(10)), lambda l: [l]), lambda acc, x:
    CASE WHEN length(acc[-1]) + 1 + length(x[1]) <= 512 THEN list_concat(acc[:-2], [acc[-1] || chr(10) || x[1]]) ELSE list_concat(acc, x) END) AS blocks
  FROM documents WHERE text IS NOT NULL),
kept AS (SELECT doc_id, list_filter(blocks, lambda b: length(trim(b)) > 0) AS blocks FROM folded)
SELECT doc_id, (generate_subscripts(blocks, 1) - 1)::INTEGER AS chunk_index, unnest(blocks) AS content FROM kept""")
def chunk_line_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_rows(table(spark, sf_dir, "documents"), ["doc_id"], chunking.line_blocks(F.col("text"), OPTIONS.chunk_size))


@query()
def chunk_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.recursive_chunks(table(spark, sf_dir, "documents"), ["doc_id"], size=OPTIONS.chunk_size, overlap=OPTIONS.chunk_overlap)


@query(f"WITH {WINDOWS} SELECT chunk_id, doc_id::VARCHAR AS source, '/documents/' || doc_id AS file_path, chunk_index, length(content)::INTEGER AS n_chars FROM chunks")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("file_path", F.concat(F.lit("/documents/"), F.col("doc_id").cast("string")))
    named = docs.select("file_path", "text", F.regexp_extract("file_path", "[^/]+$", 0).alias("source"))
    chunks = chunking.chunk_rows(named, ["source", "file_path"], chunking.fixed_windows(F.col("text"), OPTIONS.chunk_size, OPTIONS.chunk_overlap))
    return chunking.with_chunk_ids(chunks).select("chunk_id", "source", "file_path", "chunk_index", F.length("content").alias("n_chars"))


# Retrieval on text -------------------------------------------------------------------------------


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"), F.lit(None).cast("int").alias("top_k"), F.lit(True).alias("with_sources"))


def _document_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("text").alias("content"))
    return retrieve.text_index(docs, EMBEDDER)


@query(f"""WITH {_text_scores_sql("documents", "doc_id::VARCHAR", "text")}
SELECT query_id, rank, item AS doc_id, s AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item)::INTEGER AS rank FROM hits) WHERE rank <= 5""")
def text_similarity_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = retrieve.knn(retrieve.question_vectors(_questions(spark, sf_dir), EMBEDDER), _document_index(spark, sf_dir), OPTIONS.top_k, DIM)
    return near.select(F.col("query").alias("query_id"), "rank", F.col("item").alias("doc_id"), "score")


@query(f"""WITH {_vectors_sql("d", "documents", "doc_id::VARCHAR", "text")}, {KEYWORDS}, {_keyword_hits_sql("documents", "doc_id::VARCHAR")}
SELECT query_id, rank, item AS doc_id, s AS score FROM fallback""")
def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieve.keyword_search(keywords_topk(spark, sf_dir), _document_index(spark, sf_dir), EMBEDDER, OPTIONS.top_k)
    return found.select("query_id", "rank", F.col("item").alias("doc_id"), "score")


@query(f"""WITH {_vectors_sql("d", "documents", "doc_id::VARCHAR", "text")}, {KEYWORDS}, {_keyword_hits_sql("documents", "doc_id::VARCHAR")}
SELECT query_id, item AS doc_id, max(s) AS score, count(*) AS n_keywords FROM kw_hits GROUP BY ALL""")
def dedup_best_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = retrieve.keyword_hits(keywords_topk(spark, sf_dir), _document_index(spark, sf_dir), EMBEDDER, OPTIONS.top_k)
    return hits.groupBy("query_id", F.col("item").alias("doc_id")).agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("n_keywords"))


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _windows(spark, sf_dir)
    index = retrieve.text_index(chunks.select("chunk_id", "content"), EMBEDDER)
    found = retrieve.retrieve_with_fallback(_questions(spark, sf_dir), index, EMBEDDER, OPTIONS.top_k, OPTIONS.score_threshold)
    return found.withColumnRenamed("item", "chunk_id").join(chunks.select("chunk_id", "content", "source"), "chunk_id").select("query_id", "rank", "chunk_id", "content", "source", "score", "path")


@query(f"{RETRIEVED} SELECT query_id, rank, chunk_id, score, path FROM named")
def retrieve_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).select("query_id", "rank", "chunk_id", "score", "path")


@query(f"{RETRIEVED} SELECT query_id, context, context_used FROM context")
def context_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer.assembled(_hits(spark, sf_dir)).select("query_id", "context", "context_used")


@query(f"{RETRIEVED} SELECT query_id, rank, source AS file, chunk_id, round(score, 3) AS score FROM named")
def sources_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = answer.assembled(_hits(spark, sf_dir)).select("query_id", F.posexplode("sources").alias("pos", "s"))
    return listed.select("query_id", (F.col("pos") + 1).alias("rank"), "s.file", "s.chunk_id", "s.score")


def _sql_prompt() -> str:
    head, rest = answer.PROMPT.split("{context}")
    middle, tail = rest.split("{question}")
    return f"'{head}' || c.context || '{middle}' || b.text || '{tail}'"


@query(f"{RETRIEVED} SELECT query_id, {_sql_prompt()} AS prompt FROM context c JOIN benchmark b ON b.item_id = c.query_id")
def prompt_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready = answer.assembled(_hits(spark, sf_dir)).join(_questions(spark, sf_dir), "query_id")
    return ready.select("query_id", answer.prompt(F.col("context"), F.col("question")).alias("prompt"))


@query(f"""{RETRIEVED} SELECT b.item_id AS query_id, coalesce(string_split(c.context, chr(10) || chr(10))[1], '{answer.NOT_FOUND}') AS answer,
  coalesce(c.sources, '') AS sources, coalesce(c.context_used, 0) AS context_used, b.text AS query
FROM benchmark b LEFT JOIN context c ON c.query_id = b.item_id""")
def response_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The service's response; the sources as text, since nested values are compared row by row here."""
    rows = answer.response(answer.answers(_questions(spark, sf_dir), _hits(spark, sf_dir)))
    entry = lambda s: F.concat_ws(" ", s["file"], s["chunk_id"], F.format_number(s["score"], 3))
    return rows.withColumn("sources", F.array_join(F.transform("sources", entry), "; "))


@query(f"""WITH said AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'),
answers AS (
  SELECT conv_id, turn, 'plain' AS variant, text FROM said
  UNION ALL SELECT conv_id, turn, 'cited', text || ' [来源：' || conv_id || ']' FROM said
  UNION ALL SELECT conv_id, turn, 'honest', '{answer.HONEST_PHRASES[1]}。' || text FROM said
  UNION ALL SELECT conv_id, turn, 'both', '{answer.HONEST_PHRASES[3]}' || text || '[来源:x]' FROM said)
SELECT conv_id, turn, variant, honest AS is_honest, cited AS has_citation, CASE WHEN honest OR cited THEN 'low' ELSE 'medium' END AS risk_level
FROM (SELECT conv_id, turn, variant, {" OR ".join(f"contains(text, '{p}')" for p in answer.HONEST_PHRASES)} AS honest, regexp_matches(text, '{answer.CITATION}') AS cited FROM answers)""")
def risk_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies as they are, with a mark of a source, with a phrase of doubt, and with both."""
    said, text = table(spark, sf_dir, "conversations").filter("role = 'assistant'"), F.col("text")
    variants = {
        "plain": text,
        "cited": F.concat(text, F.lit(" [来源："), F.col("conv_id").cast("string"), F.lit("]")),
        "honest": F.concat(F.lit(f"{answer.HONEST_PHRASES[1]}。"), text),
        "both": F.concat(F.lit(answer.HONEST_PHRASES[3]), text, F.lit("[来源:x]")),
    }
    answers = said.select("conv_id", "turn", F.explode(F.array(*(F.struct(F.lit(name).alias("variant"), body.alias("text")) for name, body in variants.items()))).alias("a"))
    return answers.select("conv_id", "turn", "a.variant", answer.risk(F.col("a.text")).alias("r")).select("conv_id", "turn", "variant", "r.*")


# Store -------------------------------------------------------------------------------------------


@query(f"""WITH {WINDOWS} SELECT (SELECT count(*) FROM documents WHERE text IS NOT NULL) AS success, (SELECT count(*) FROM documents WHERE text IS NULL) AS failed,
  count(*) AS total_chunks, count(*) AS vector_count FROM chunks""")
def ingest_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = table(spark, sf_dir, "documents").select(F.when(F.col("text").isNull(), F.lit("no text")).alias("error"))
    return store.ingest_stats(parsed, _windows(spark, sf_dir))


SIGNATURE_SQL = "SELECT source AS name, sum(n_chars)::BIGINT AS size, max(doc_id)::BIGINT AS mtime FROM documents GROUP BY source"


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pseudo-file for each source: its characters are the size, its last id the time."""
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("name")).agg(F.sum("n_chars").alias("size"), F.max("doc_id").alias("mtime"))


@query(f"SELECT generate_subscripts(f, 1)::INTEGER - 1 AS pos, unnest(f).name AS name, unnest(f).size AS size, unnest(f).mtime AS mtime FROM (SELECT list(s ORDER BY s.name, s.size, s.mtime) AS f FROM ({SIGNATURE_SQL}) s)")
def file_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    signed = store.signature(_listing(spark, sf_dir), "params")
    return signed.select(F.posexplode("signature.files").alias("pos", "f")).select("pos", "f.name", "f.size", "f.mtime")


@query(f"""WITH listing AS ({SIGNATURE_SQL}), saved AS (SELECT list(s ORDER BY s.name) AS files FROM listing s),
later AS (SELECT list(s ORDER BY s.name) AS files FROM (SELECT name, size, mtime + 1 AS mtime FROM listing) s),
cases AS (
  SELECT 'same' AS case_name, files, 'a' AS params FROM saved UNION ALL SELECT 'touched', files, 'a' FROM later
  UNION ALL SELECT 'params', files, 'b' FROM saved UNION ALL SELECT 'none', files[:0], 'a' FROM saved)
SELECT case_name, CASE WHEN len(c.files) = 0 THEN 'empty' WHEN c.files = s.files AND params = 'a' THEN 'cached' ELSE 'reindexed' END AS status FROM cases c, saved s""")
def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What change detection says when nothing, a time, the parameters or everything has changed."""
    files = _listing(spark, sf_dir)
    saved = store.signature(files, "a").select(F.col("signature").alias("saved"))
    cases = {
        "same": store.signature(files, "a"),
        "touched": store.signature(files.withColumn("mtime", F.col("mtime") + 1), "a"),
        "params": store.signature(files, "b"),
        "none": store.signature(files.filter(F.lit(False)), "a"),
    }
    rows = None
    for name, now in cases.items():
        status = F.when(F.size("signature.files") == 0, "empty").when(F.col("signature").eqNullSafe(F.col("saved")), "cached").otherwise("reindexed")
        row = now.crossJoin(saved).select(F.lit(name).alias("case_name"), status.alias("status"))  # one row each
        rows = row if rows is None else rows.unionByName(row)
    return rows


@query("SELECT doc_id::VARCHAR AS chunk_id, CASE WHEN lang = 'en' THEN 'old' ELSE 'new' END AS origin FROM documents WHERE lang IN ('en', 'de', 'fr')")
def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English documents are stored; English, German and French ones arrive."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), "lang")
    old = docs.filter("lang = 'en'").select("chunk_id", F.lit("old").alias("origin"))
    arriving = docs.filter(F.col("lang").isin("en", "de", "fr")).select("chunk_id", F.lit("new").alias("origin"))
    return old.unionByName(store.absent_rows(arriving, old))


@query(r"SELECT page_id, url, lower(regexp_extract(regexp_extract(url, '[^/]+$', 0), '^.+(\.[^.]+)$', 1)) AS ext FROM pages WHERE lower(regexp_extract(regexp_extract(url, '[^/]+$', 0), '^.+(\.[^.]+)$', 1)) IN ('.html', '.pdf', '.txt', '.com', '')")
def extension_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.files import extension

    allowed = spark.createDataFrame([(e,) for e in (".html", ".pdf", ".txt", ".com", "")], "ext string")
    return table(spark, sf_dir, "pages").select("page_id", "url", extension(F.col("url")).alias("ext")).join(allowed, "ext", "left_semi").select("page_id", "url", "ext")


@query(f"""SELECT model, 'kb_' || substr(CASE WHEN length(tag) < 3 THEN 'default_model' ELSE tag END, 1, 40) AS collection
FROM (SELECT model, lower(regexp_replace(replace(replace(model, '/', '_'), '-', '_'), '[^a-zA-Z0-9_]', '_', 'g')) AS tag FROM (VALUES {", ".join(f"('{m}')" for m in MODELS)}) t(model))""")
def collection_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = spark.createDataFrame([(m,) for m in MODELS], "model string")
    return models.select("model", store.collection_name(F.col("model")).alias("collection"))


@query(f"WITH {WINDOWS} SELECT 'kb_text_embedding_v3' AS collection_name, count(*) AS document_count, {OPTIONS.chunk_size} AS chunk_size, {OPTIONS.top_k} AS top_k, {OPTIONS.score_threshold}::DOUBLE AS threshold FROM chunks")
def collection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = store.collection_name(F.lit(OPTIONS.embedding_model)).alias("collection_name")
    return _windows(spark, sf_dir).agg(F.count(F.lit(1)).alias("document_count")).select(name, "document_count", F.lit(OPTIONS.chunk_size).alias("chunk_size"), F.lit(OPTIONS.top_k).alias("top_k"), F.lit(OPTIONS.score_threshold).alias("threshold"))


@query(f"""WITH {WINDOWS} SELECT (SELECT count(*) FROM documents) AS total_documents,
  (SELECT string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id::VARCHAR) FROM documents) AS document_list, count(*) AS total_chunks FROM chunks""")
def dataset_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source"))
    return store.dataset_index(docs, _windows(spark, sf_dir)).withColumn("document_list", F.array_join("document_list", ","))


@query("SELECT * FROM (VALUES ('a.txt', 12, 'first'), ('b.txt', 0, NULL)) t(source, n_chars, first_word)")
def inline_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.files import inline

    docs = inline(spark, {"a.txt": "first second", "b.txt": ""})
    return docs.select("source", F.length("text").alias("n_chars"), F.get(tokens.words(F.col("text")), 0).alias("first_word"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
