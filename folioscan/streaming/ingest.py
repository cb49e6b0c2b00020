"""Uploads as a stream: files that land in a folder are parsed, split, embedded and appended.

A file that is rewritten under its old name is not seen again by a file stream; change detection
is the manifest's job (``Engine.ingest_if_changed``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.engine import Engine

LANDED = "path string, modificationTime timestamp, length long, content binary"


def upload_stream(engine: Engine, directory: str) -> DataFrame:
    return engine.spark.readStream.format("binaryFile").schema(LANDED).load(directory)


def start(engine: Engine, directory: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append each micro-batch; ids that are there already are left alone, so a replayed batch adds nothing."""

    def add(batch: DataFrame, _: int) -> None:
        if not batch.select("path").isEmpty():
            engine.ingest(batch)

    writer = upload_stream(engine, directory).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
