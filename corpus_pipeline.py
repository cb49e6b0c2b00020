"""The corpus pipeline: classify, deduplicate, decontaminate, mix, shard.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. ``run`` writes
each stage's rows as Parquet to the shared folder, reads them back for the next one and removes the
tables that a stage needed on the way.

Defined cases, for every stage: each row is judged by its own text, whether its doc_id is null, shared
or its own; null and empty texts are rows like others (the classifier scores them, none of them is a
near-duplicate or contaminated, and the mix takes no words of them, so that they go there); texts are
read whole, whatever their length; repeated rows are equal in every stage's eyes, so that one of them
stays behind near-dedup; an empty table gives no rows; other columns stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioscan.llm import bagminhash, decontaminate, mixing, quality, sharding
from folioscan.llm.common import finished, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, the one with the smallest id."""
    return bagminhash.deduplicated(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document is repeated as often as the mix takes its words, rounded by its seed; one that it takes no words of goes."""
    return mixing.mixed_documents(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and their slot in it."""
    return sharding.shard_documents(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: The classifier is trained and the signatures are seeded; SQL can't express these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = finished(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
