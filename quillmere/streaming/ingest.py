"""Incremental import: a folder watched by Structured Streaming, each batch indexed as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillmere.plans.engine import KnowledgeEngine
from quillmere.sources.files import raw_rows

_BINARY = "path string, modificationTime timestamp, length long, content binary"


def watch_folder(engine: KnowledgeEngine, kb_id: str, path: str, checkpoint: str, files_per_batch: int = 1000) -> StreamingQuery:
    """Import files of a folder as they arrive. File ids follow from base and path, so a batch that runs again replaces itself."""
    source = (
        engine.spark.readStream.format("binaryFile").schema(_BINARY).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(path)
    )

    def batch(found: DataFrame, _: int) -> None:
        files = found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), "content")
        if not files.isEmpty():
            engine.import_rows(kb_id, raw_rows(files, kb_id))

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
