"""Schemas of the catalog tables and of what extraction and search give."""

from __future__ import annotations

from pyspark.sql import types as T

BASES = "id string, name string, description string, created_at long, updated_at long"
FILES = (
    "id string, kb_id string, name string, ext string, kind string, rel_path string, size long, encoding string, "
    "line_ending string, char_count long, chunk_count int, status string, error string, embedding_model string, "
    "embedding_dim int, created_at long, updated_at long"
)
CHUNKS = (
    "id string, file_id string, kb_id string, idx int, text string, dim int, vector array<float>, size int, "
    "heading string, created_at long"
)
MOUNTS = "kb_id string, workspace_id string, enabled boolean, note string, created_at long"
SETTINGS = "id int, json string"
HITS = (
    "chunk_id string, file_id string, kb_id string, file_name string, kb_name string, text string, idx int, "
    "heading string, score double, rerank_score double"
)
EXTRACTED = (
    "text string, kind string, subtype string, encoding string, had_bom boolean, char_count int, degraded boolean, error string"
)

RAW = "kb_id string, file_id string, name string, ext string, rel_path string, size long, content binary"

TABLES = {"bases": BASES, "files": FILES, "chunks": CHUNKS, "mounts": MOUNTS, "settings": SETTINGS, "raw": RAW}
#: Tables whose rows belong to a base, and the key by which they lie in its buckets.
KEYS = {"raw": "file_id", "chunks": "file_id", "files": "id"}


def struct(ddl: str) -> T.StructType:
    """The struct type of one of the schemas above."""
    return T.StructType.fromDDL(ddl)
