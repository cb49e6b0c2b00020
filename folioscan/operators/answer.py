"""From hits to answers: context, sources, prompt, generation and the risk check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts and marks that results have to carry.
UNKNOWN = "未知"
NOT_FOUND = "未在知识库中找到相关信息，请尝试补充文档或换一种问法。"
HONEST_PHRASES = ("无法回答", "没有相关信息", "不清楚", "不知道")
CITATION = r"\[来源[：:]"
FAILED = "生成答案时出错："

PROMPT = "Answer the question from the context alone; say so if it holds no answer.\n\nContext:\n{context}\n\nQuestion:\n{question}\n\nAnswer:"


def context_line(score: Column, content: Column) -> Column:
    return F.concat(F.lit("[相似度："), F.format_number(score, 2), F.lit("] "), content)


def source_entry(file: Column, chunk_id: Column, score: Column) -> Column:
    return F.struct(F.coalesce(file, F.lit(UNKNOWN)).alias("file"), F.coalesce(chunk_id, F.lit(UNKNOWN)).alias("chunk_id"), F.round(score, 3).alias("score"))


def assembled(hits: DataFrame) -> DataFrame:
    """query_id, context, sources, context_used of hits (query_id, rank, chunk_id, content, source, score), in order of rank."""
    ordered = F.sort_array(F.collect_list(F.struct("rank", context_line(F.col("score"), F.col("content")).alias("line"), source_entry(F.col("source"), F.col("chunk_id"), F.col("score")).alias("entry"))))
    return hits.groupBy("query_id").agg(ordered.alias("h")).select("query_id", F.array_join(F.col("h.line"), "\n\n").alias("context"), F.col("h.entry").alias("sources"), F.size("h").alias("context_used"))


def prompt(context: Column, question: Column, template: str = PROMPT) -> Column:
    """The template with its two places filled; braces in the texts stay as they are."""
    head, rest = template.split("{context}")
    middle, tail = rest.split("{question}")
    return F.concat(F.lit(head), context, F.lit(middle), question, F.lit(tail))


def risk(answer: Column, phrases: tuple[str, ...] = HONEST_PHRASES, citation: str = CITATION) -> Column:
    honest = F.lit(False)
    for p in phrases:
        honest = honest | F.contains(answer, F.lit(p))
    cited = answer.rlike(citation)
    return F.struct(honest.alias("is_honest"), cited.alias("has_citation"), F.when(honest | cited, F.lit("low")).otherwise(F.lit("medium")).alias("risk_level"))


def answers(questions: DataFrame, hits: DataFrame, generator=None, template: str = PROMPT) -> DataFrame:
    """A row of the answer type for each question.

    ``generator`` is a function of a prompt column that gives struct<answer, error>; without one,
    the answer is the best hit's context line. Questions without a hit get the fixed answer.
    """
    ready = questions.join(assembled(hits), "query_id", "left").withColumn("prompt", prompt(F.col("context"), F.col("question"), template))
    found = F.col("context_used").isNotNull()
    if generator is None:
        reply = F.struct(F.substring_index("context", "\n\n", 1).alias("answer"), F.lit(None).cast("string").alias("error"))
    else:
        reply = generator(F.col("prompt"))
    ready = ready.withColumn("reply", F.when(found, reply))
    failed = found & F.col("reply.error").isNotNull()
    text = F.when(~found, F.lit(NOT_FOUND)).when(failed, F.concat(F.lit(FAILED), F.col("reply.error"))).otherwise(F.col("reply.answer"))
    return ready.select(
        "query_id",
        text.alias("answer"),
        F.when(F.coalesce("with_sources", F.lit(True)), F.coalesce("sources", F.array().cast("array<struct<file:string,chunk_id:string,score:double>>"))).alias("sources"),
        F.coalesce("context_used", F.lit(0)).alias("context_used"),
        F.when(found & ~failed, risk(F.col("reply.answer"))).alias("hallucination_risk"),
        F.col("question").alias("query"),
        F.col("reply.error").alias("error"),
    )


def response(rows: DataFrame) -> DataFrame:
    """The columns that leave the service."""
    return rows.select("query_id", "answer", "sources", "context_used", "query")
