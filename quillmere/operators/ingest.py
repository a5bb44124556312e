"""From files to chunks with vectors, and the state of each file."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.config import Config
from quillmere.functions.chunking import chunks as chunked
from quillmere.functions.text import trim
from quillmere.schemas import CHUNKS, FILES, struct
from quillmere.sources.files import extracted
from quillmere.sources.models import Embedder, embedded

#: What is said of a file whose bytes are gone, and of one whose indexing was cancelled.
MISSING, STOPPED = "the original file is missing", "stopped by user"


def embedded_pieces(raw: DataFrame, config: Config, embedder: Embedder, counted: Callable[[int, int], None] | None = None) -> DataFrame:
    """Raw files as pieces with vectors: a row per chunk, and one without idx for a file that has none.

    Each row has the columns of its file, so that chunks and the state of files
    both follow from this one table: the caller writes it once, and every file
    is read, and every text embedded, once. ``counted`` is told, where the work
    is done, of how many files and chunks it was.
    """
    texts = extracted(raw, strip_markup=config.stripMarkup)
    found = F.when(F.col("error").isNull(), chunked(F.col("text"), config.chunkSize, config.chunkOverlap))
    pieces = texts.withColumns({"pieces": found, "blank": trim(F.coalesce("text", F.lit(""))) == ""}).drop("text")
    rows = pieces.select(*(c for c in pieces.columns if c != "pieces"), F.posexplode_outer("pieces").alias("idx", "piece"))
    rows = rows.select("*", F.col("piece.text").alias("text"), F.col("piece.heading").alias("heading")).drop("piece")

    def told(batch: pa.RecordBatch) -> None:
        idx = batch.column(batch.schema.get_field_index("idx"))
        counted(pc.sum(pc.equal(idx.fill_null(0), 0)).as_py() or 0, len(idx) - idx.null_count)

    return embedded(rows, embedder, told=told if counted else None)


def index_pieces(pieces: DataFrame, model: str, now: int) -> tuple[DataFrame, DataFrame]:
    """(files, chunks) of a table of embedded pieces.

    A file is ready when its text has chunks and all of them have vectors; else
    it has failed, with the reason, and no chunks. Chunk ids follow from file
    and place, so that a run gives the same ids again. Only what describes a
    file and its counts is shuffled, combined before.
    """
    described = ["kb_id", "name", "ext", "kind", "rel_path", "size", "encoding", "char_count", "error", "blank"]
    state = pieces.groupBy("file_id").agg(
        *(F.first(c).alias(c) for c in described),
        F.count("idx").cast("int").alias("chunks"), F.max("embed_error").alias("embed_error"), F.max(F.size("vector")).alias("dim"),
    )
    error = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("blank"), "no text was found")
        .when(F.col("embed_error").isNotNull(), F.col("embed_error"))
        .when(F.col("chunks") == 0, "the text has no chunks")
    )
    ready = error.isNull()
    files = state.select(
        F.col("file_id").alias("id"), "kb_id", "name", "ext", F.coalesce("kind", F.lit("unknown")).alias("kind"), "rel_path", "size",
        F.coalesce("encoding", F.lit("")).alias("encoding"), F.lit("\n").alias("line_ending"), F.col("char_count").cast("long").alias("char_count"),
        F.when(ready, F.col("chunks")).otherwise(0).alias("chunk_count"), F.when(ready, "ready").otherwise("failed").alias("status"),
        error.alias("error"), F.when(ready, F.lit(model)).alias("embedding_model"), F.when(ready, F.col("dim")).alias("embedding_dim"),
        F.lit(now).cast("long").alias("created_at"), F.lit(now).cast("long").alias("updated_at"),
    ).select(*struct(FILES).names)
    rows = pieces.filter("idx IS NOT NULL").select(
        F.sha2(F.concat_ws("|", "file_id", F.col("idx").cast("string")), 256).alias("id"),
        "file_id", "kb_id", F.col("idx").cast("int").alias("idx"), "text", F.size("vector").alias("dim"), "vector",
        F.length("text").alias("size"), "heading", F.lit(now).cast("long").alias("created_at"),
    )
    good = rows.join(files.filter("status = 'ready'").select(F.col("id").alias("file_id")), "file_id", "left_semi")
    return files, good.select(*struct(CHUNKS).names)


def waiting_files(raw: DataFrame, status: str, now: int) -> DataFrame:
    """Rows of files that have arrived and are not indexed yet; their bytes are not read."""
    given = {c: F.col(c) for c in ("kb_id", "name", "ext", "rel_path", "size")} | {"id": F.col("file_id"), "status": F.lit(status)}
    given |= {"kind": F.lit("text"), "encoding": F.lit("auto"), "line_ending": F.lit("\n"), "char_count": F.lit(0), "chunk_count": F.lit(0)}
    given |= {"created_at": F.lit(now), "updated_at": F.lit(now)}
    return raw.select(*(given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in struct(FILES).fields))
