"""Queries of the engine's operators on the driver's tables, and SQL that gives the same rows.

The tables stand in for the catalog: sources of documents or labels of
embeddings are bases, documents are files, embeddings are chunks with vectors.
"""

from __future__ import annotations

import io
import json
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.config import Config, candidate_budget, merged_columns, search_arguments
from quillmere.functions import text as T
from quillmere.functions.chunking import chunks as chunked
from quillmere.functions.chunking import fold
from quillmere.functions.vectors import cosine, literal, top_k
from quillmere.operators import catalog, search
from quillmere.operators.ingest import embedded_pieces, index_pieces
from quillmere.plans.api import handle
from quillmere.plans.engine import KnowledgeEngine
from quillmere.sources.checkpoint import cut, ensure_checkpoint_dir
from quillmere.sources.files import extracted
from quillmere.sources.models import HashingEmbedder, OverlapReranker, embedded, parse_ranking

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a query under its function's name, with the SQL of the same rows."""

    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- stand-ins -------------------------------------------------------------


def _chunks(spark, d) -> DataFrame:
    e = _read(spark, d, "embeddings")
    return e.select(
        F.col("vec_id").alias("id"), F.col("vec_id").alias("file_id"), F.col("label").alias("kb_id"), (F.col("vec_id") % 7).alias("idx"),
        F.concat(F.lit("chunk "), F.col("vec_id").cast("string")).alias("text"), F.col("embedding").alias("vector"), F.lit(None).cast("string").alias("heading"),
    )


def _bases(spark, d) -> DataFrame:
    return _read(spark, d, "embeddings").select(F.col("label").alias("id")).distinct().withColumn("name", F.concat(F.lit("kb"), F.col("id").cast("string")))


def _files(spark, d) -> DataFrame:
    return _read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat(F.col("source"), F.lit("-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"))


def _mounts(spark, d) -> DataFrame:
    """Every base in five workspaces, switched on or off."""
    first = F.min("vec_id")
    by = _read(spark, d, "embeddings").groupBy(F.col("label").alias("kb_id"), F.concat(F.lit("w"), (F.col("vec_id") % 5).cast("string")).alias("workspace_id"))
    return by.agg((first % 3 != 0).alias("enabled"), F.concat(F.lit("n"), first.cast("string")).alias("note"), first.alias("created_at"))


_MOUNTS = (
    "(SELECT label AS kb_id, 'w' || (vec_id % 5) AS workspace_id, min(vec_id) % 3 <> 0 AS enabled, 'n' || min(vec_id) AS note, "
    "min(vec_id) AS created_at FROM embeddings GROUP BY label, vec_id % 5) AS mounts"
)
_CHUNKS = (
    "chunks AS (SELECT vec_id AS id, vec_id AS file_id, label AS kb_id, vec_id % 7 AS idx, 'chunk ' || vec_id AS text, "
    "CAST(embedding AS DOUBLE[]) AS vector FROM embeddings)"
)
_FOUND = (
    _CHUNKS
    + ", found AS (SELECT c.id AS chunk_id, c.file_id, c.kb_id, d.source || '-' || d.doc_id || '.txt' AS file_name, 'kb' || c.kb_id AS kb_name, c.text, c.idx, "
    "list_cosine_similarity(c.vector, (SELECT vector FROM chunks WHERE id = 0)) AS score "
    "FROM chunks c JOIN documents d ON d.doc_id = c.file_id WHERE c.vector IS NOT NULL)"
)
_HIT = "chunk_id, file_id, kb_id, file_name, kb_name, text, idx, round(score, 6) AS score"


def _vector(spark, d) -> list[float]:
    """The vector of the first chunk stands for that of a question."""
    return list(_read(spark, d, "embeddings").filter("vec_id = 0").select("embedding").first()[0])


def _searched(spark, d, chunks: DataFrame) -> DataFrame:
    """The 20 nearest chunks: recalled by ids and vectors, then described."""
    bases, files = _bases(spark, d), _files(spark, d)
    df = search.described(search.recall(chunks, bases, files, _vector(spark, d), 20), chunks, bases, files)
    return df.select("chunk_id", "file_id", "kb_id", "file_name", "kb_name", "text", "idx", F.round("score", 6).alias("score"))


# ---- vectors and search ----------------------------------------------------


@query(
    "SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) "
    "FROM embeddings WHERE vec_id = 0)), 6) AS score FROM embeddings"
)
def cosine_score(spark, d):
    score = cosine(F.col("embedding"), literal(_vector(spark, d)))
    return _read(spark, d, "embeddings").select("vec_id", F.round(score, 6).alias("score"))


@query(
    "SELECT vec_id, round(s, 6) AS score FROM (SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT "
    "CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) AS s FROM embeddings) "
    "ORDER BY s DESC, vec_id LIMIT 20"
)
def cosine_topk(spark, d):
    from quillmere.functions.vectors import scored

    rows = _read(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return top_k(scored(rows, _vector(spark, d)), 20, "vec_id").select("vec_id", F.round("score", 6).alias("score"))


@query(
    "SELECT vec_id, CAST(len(v) AS INTEGER) AS dim FROM (SELECT vec_id, CASE "
    "WHEN vec_id % 3 = 0 THEN embedding[1:32] ELSE embedding END AS v FROM embeddings) "
    "WHERE len(v) = 64"
)
def dim_filter(spark, d):
    cut = F.when(F.col("vec_id") % 3 == 0, F.slice("embedding", 1, 32)).otherwise(F.col("embedding"))
    from quillmere.functions.vectors import scored

    rows = scored(_read(spark, d, "embeddings").select("vec_id", F.size(cut).alias("dim"), cut.alias("vector")), [1.0] * 64)
    return rows.select("vec_id", "dim")


@query(
    "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dim, CAST(4 * len(embedding) AS INTEGER) AS bytes, "
    "round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total FROM embeddings"
)
def vector_blobs(spark, d):
    from quillmere.functions.vectors import pack_float32, unpack_float32

    packed = _read(spark, d, "embeddings").select("vec_id", pack_float32("embedding").alias("blob"))
    rows = packed.select("vec_id", F.octet_length("blob").alias("bytes"), unpack_float32("blob").alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return rows.select("vec_id", F.size("v").alias("dim"), "bytes", F.round(total, 6).alias("total"))


@query(f"WITH {_FOUND} SELECT {_HIT} FROM found WHERE kb_id IN (1, 4) ORDER BY found.score DESC, idx, chunk_id LIMIT 20")
def scoped_search_kb(spark, d):
    return _searched(spark, d, search.in_scope(_chunks(spark, d), kb_ids=[1, 4]))


@query(
    f"WITH {_FOUND} SELECT {_HIT} FROM found WHERE kb_id IN (SELECT kb_id FROM {_MOUNTS} "
    "WHERE workspace_id = 'w1' AND enabled) ORDER BY found.score DESC, idx, chunk_id LIMIT 20"
)
def scoped_search_workspace(spark, d):
    return _searched(spark, d, search.in_scope(_chunks(spark, d), _mounts(spark, d), workspace_id="w1"))


@query(f"WITH {_FOUND} SELECT {_HIT} FROM found ORDER BY found.score DESC, idx, chunk_id LIMIT 20")
def search_all(spark, d):
    return _searched(spark, d, search.in_scope(_chunks(spark, d)))


@query(f"WITH {_FOUND} SELECT chunk_id, file_id, kb_id, file_name, kb_name, text, idx FROM found")
def candidate_join(spark, d):
    return search.candidates(_chunks(spark, d), _bases(spark, d), _files(spark, d)).drop("vector", "heading")


@query(f"WITH {_FOUND} SELECT chunk_id, kb_id, idx FROM found ORDER BY idx, chunk_id LIMIT 100")
def candidate_cap(spark, d):
    return search.candidates(_chunks(spark, d), _bases(spark, d), _files(spark, d), cap=100).select("chunk_id", "kb_id", "idx")


@query(
    "SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, round(s, 6) AS score "
    "FROM (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, s, row_number() OVER (PARTITION BY a.vec_id "
    "ORDER BY s DESC, b.vec_id) AS rank "
    "FROM embeddings a, embeddings b, LATERAL (SELECT list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS "
    "DOUBLE[])) AS s) WHERE a.vec_id % 50 = 0) WHERE rank <= 5"
)
def batch_topk(spark, d):
    asked = _read(spark, d, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return search.batch_nearest(asked, _chunks(spark, d), 5).withColumn("score", F.round("score", 6))


@query(
    f"WITH {_FOUND}, hits AS (SELECT *, row_number() OVER (ORDER BY score DESC, idx, chunk_id) - 1 AS ordinal "
    "FROM found ORDER BY score DESC, idx, chunk_id LIMIT 20), "
    "scores AS (SELECT h.ordinal, min(CASE WHEN l.quality = 1 THEN 0.5 + (h.chunk_id % 5) * 0.125 ELSE -0.25 END) AS r "
    "FROM hits h JOIN labels l ON l.doc_id = h.chunk_id GROUP BY h.ordinal) "
    "SELECT chunk_id, round(score, 6) AS score, CAST(coalesce(r, 0) AS DOUBLE) AS rerank_score "
    "FROM hits LEFT JOIN scores USING (ordinal) ORDER BY coalesce(r, 0) DESC, ordinal LIMIT 5"
)
def rerank_merge(spark, d):
    found = search.candidates(_chunks(spark, d), _bases(spark, d), _files(spark, d))
    hits = search.nearest(found, _vector(spark, d), 20)
    from pyspark.sql import Window

    hits = hits.withColumn("ordinal", F.row_number().over(Window.orderBy(F.desc("score"), "idx", "chunk_id")) - 1)  # 20 rows
    score = F.when(F.col("quality") == 1, 0.5 + (F.col("chunk_id") % 5) * 0.125).otherwise(-0.25)
    scores = hits.join(_read(spark, d, "labels"), F.col("chunk_id") == F.col("doc_id")).select(F.col("ordinal").alias("index"), score.alias("relevance"))
    return search.rerank_merge(hits, scores, 5).select("chunk_id", F.round("score", 6).alias("score"), "rerank_score")


# ---- catalog ---------------------------------------------------------------


def _catalog(spark, d) -> dict[str, DataFrame]:
    docs = _read(spark, d, "documents")
    bases = docs.groupBy(F.col("source").alias("id")).agg(F.min("doc_id").alias("created_at"))
    empty = spark.createDataFrame([("none", -1)], "id string, created_at long")
    files = docs.select(
        F.col("doc_id").alias("id"), F.col("source").alias("kb_id"), F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("name"),
        F.lit("pending").alias("status"), F.lit(None).cast("string").alias("error"), F.lit(0).cast("long").alias("chunk_count"),
        F.col("doc_id").alias("created_at"), F.col("doc_id").alias("updated_at"),
    )
    turns = _read(spark, d, "conversations").join(docs.select("doc_id", "source"), F.col("conv_id") == F.col("doc_id"))
    chunks = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("file_id"), F.col("source").alias("kb_id"), F.col("turn").alias("idx"))
    mounts = _mounts(spark, d).withColumn("kb_id", F.concat(F.lit("src"), F.col("kb_id").cast("string")))
    return {"bases": bases.unionByName(empty), "files": files, "chunks": chunks, "mounts": mounts}


_CATALOG = (
    "bases AS (SELECT source AS id, min(doc_id) AS created_at FROM documents GROUP BY source UNION ALL SELECT 'none', -1), "
    "files AS (SELECT doc_id AS id, source AS kb_id, 'f' || doc_id AS name, 'pending' AS status, CAST(NULL AS VARCHAR) AS error, "
    "0::BIGINT AS chunk_count, doc_id AS created_at, doc_id AS updated_at FROM documents), "
    "chunks AS (SELECT conv_id * 1000 + turn AS id, conv_id AS file_id, source AS kb_id, turn AS idx "
    "FROM conversations JOIN documents ON conv_id = doc_id), "
    "mounted AS (SELECT 'src' || kb_id AS kb_id, workspace_id, enabled, note, created_at::BIGINT AS created_at FROM " + _MOUNTS + ")"
)
_COUNTED = (
    "SELECT id, created_at, (SELECT count(*) FROM files f WHERE f.kb_id = b.id) AS file_count, (SELECT count(*) "
    "FROM chunks c WHERE c.kb_id = b.id) AS chunk_count FROM bases b"
)


@query(f"WITH {_CATALOG} {_COUNTED}")
def bases_with_counts(spark, d):
    t = _catalog(spark, d)
    return catalog.with_counts(t["bases"], t["files"], t["chunks"])


@query(f"WITH {_CATALOG} {_COUNTED} WHERE id = 'src3'")
def base_by_id(spark, d):
    t = _catalog(spark, d)
    return catalog.base_by_id(t["bases"], t["files"], t["chunks"], "src3")


@query(f"WITH {_CATALOG} SELECT id, name, created_at FROM files WHERE kb_id = 'src3'")
def files_of_base(spark, d):
    return catalog.files_of_base(_catalog(spark, d)["files"], "src3").select("id", "name", "created_at")


@query(f"WITH {_CATALOG} SELECT id, kb_id, name FROM files WHERE id = 7")
def file_by_id(spark, d):
    return catalog.file_by_id(_catalog(spark, d)["files"], 7).select("id", "kb_id", "name")


@query(f"WITH {_CATALOG} SELECT id, name FROM files")
def file_names(spark, d):
    return catalog.file_names(_catalog(spark, d)["files"])


@query(f"WITH {_CATALOG} SELECT id FROM chunks WHERE kb_id IN ('src1', 'src2')")
def chunk_ids(spark, d):
    return catalog.chunk_ids(_catalog(spark, d)["chunks"], ["src1", "src2"])


@query(f"WITH {_CATALOG} SELECT (SELECT count(*) FROM bases) AS bases, (SELECT count(*) FROM files JOIN bases b ON b.id = kb_id) AS files")
def health(spark, d):
    t = _catalog(spark, d)
    return catalog.health(t["bases"], t["files"])


@query(
    f"WITH {_CATALOG} SELECT 'base' AS kind, id AS name, 0::BIGINT AS n FROM bases "
    "WHERE id <> 'src1' UNION ALL SELECT 'files', kb_id, count(*) FROM files "
    "WHERE kb_id <> 'src1' GROUP BY kb_id UNION ALL SELECT 'chunks', kb_id, count(*) "
    "FROM chunks WHERE kb_id <> 'src1' GROUP BY kb_id UNION ALL SELECT 'mounts', kb_id, count(*) "
    "FROM mounted WHERE kb_id <> 'src1' GROUP BY kb_id"
)
def delete_base(spark, d):
    t = catalog.delete_base(_catalog(spark, d), "src1")
    out = t["bases"].select(F.lit("base").alias("kind"), F.col("id").alias("name"), F.lit(0).cast("long").alias("n"))
    for kind in ("files", "chunks", "mounts"):
        out = out.unionByName(t[kind].groupBy("kb_id").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), F.col("kb_id").alias("name"), "n"))
    return out


@query(f"WITH {_CATALOG} SELECT 'files' AS kind, id FROM files WHERE id <> 3 UNION ALL SELECT 'chunks', id FROM chunks WHERE file_id <> 3")
def delete_file(spark, d):
    t = catalog.delete_file(_catalog(spark, d), 3)
    return t["files"].select(F.lit("files").alias("kind"), "id").unionByName(t["chunks"].select(F.lit("chunks").alias("kind"), "id"))


@query(
    f"WITH {_CATALOG}, fresh AS (SELECT file_id * 1000 + 500 + idx AS id, file_id, kb_id, idx "
    "FROM chunks WHERE file_id % 4 = 0) SELECT * FROM chunks WHERE file_id NOT IN (SELECT file_id "
    "FROM fresh) UNION ALL SELECT * FROM fresh"
)
def replace_chunks(spark, d):
    chunks = _catalog(spark, d)["chunks"]
    fresh = chunks.filter(F.col("file_id") % 4 == 0).withColumn("id", F.col("file_id") * 1000 + 500 + F.col("idx"))
    return catalog.replace_chunks(chunks, fresh)


@query(
    f"WITH {_CATALOG} SELECT id, kb_id, name, CASE WHEN id % 5 = 0 THEN 'ready' ELSE status END AS status, "
    "CASE WHEN id % 5 = 0 THEN id % 9 ELSE chunk_count END AS chunk_count, created_at, "
    "CASE WHEN id % 5 = 0 THEN 777 ELSE updated_at END AS updated_at FROM files"
)
def patch_file(spark, d):
    files = _catalog(spark, d)["files"]
    patch = files.filter(F.col("id") % 5 == 0).select("id", F.lit("ready").alias("status"), (F.col("id") % 9).alias("chunk_count"), F.lit("no").alias("name"))
    return catalog.patch_files(files, patch, now=777).drop("error")


@query(
    "SELECT kb_id, workspace_id, CASE WHEN kb_id % 2 = 0 THEN NOT enabled ELSE enabled END AS enabled, "
    f"CASE WHEN kb_id % 2 = 0 THEN 'new' ELSE note END AS note, created_at FROM {_MOUNTS} "
    f"UNION ALL SELECT kb_id, 'w9', true, 'added', created_at + 5000 FROM {_MOUNTS} WHERE workspace_id = 'w1'"
)
def mount_upsert(spark, d):
    mounts = _mounts(spark, d)
    changed = mounts.filter("kb_id % 2 = 0").select("kb_id", "workspace_id", (~F.col("enabled")).alias("enabled"), F.lit("new").alias("note"), (F.col("created_at") + 9000).alias("created_at"))
    added = mounts.filter("workspace_id = 'w1'").select("kb_id", F.lit("w9").alias("workspace_id"), F.lit(True).alias("enabled"), F.lit("added").alias("note"), (F.col("created_at") + 5000).alias("created_at"))
    return catalog.set_mounts(mounts, changed.unionByName(added))


@query(f"SELECT kb_id, workspace_id, enabled, note, created_at FROM {_MOUNTS} WHERE NOT (kb_id = 3 AND workspace_id = 'w1')")
def mount_delete(spark, d):
    return catalog.delete_mount(_mounts(spark, d), 3, "w1")


@query(f"SELECT DISTINCT kb_id FROM {_MOUNTS} WHERE workspace_id = 'w1' AND enabled")
def workspace_scope(spark, d):
    return catalog.workspace_bases(_mounts(spark, d), "w1")


@query(f"WITH {_CATALOG} SELECT id, id IN (SELECT kb_id FROM mounted WHERE workspace_id = 'w1' AND enabled) AS mounted FROM bases")
def mounted_bases(spark, d):
    t = _catalog(spark, d)
    return catalog.is_mounted(t["bases"], t["mounts"], "w1").select("id", "mounted")


@query(
    "SELECT doc_id AS id, CASE WHEN doc_id % 4 = 1 THEN CAST(800 + doc_id % 100 AS VARCHAR) ELSE '1200' END AS chunk_size, '150' AS chunk_overlap, "
    "CASE WHEN doc_id % 4 = 0 THEN 'm' || doc_id ELSE 'text-embedding-bge-m3' END AS model FROM documents"
)
def config_merge(spark, d):
    number = F.col("doc_id").cast("string")
    stored = (
        F.when(F.col("doc_id") % 4 == 0, F.to_json(F.struct(F.concat(F.lit("m"), number).alias("embeddingModel"), F.lit(1).alias("other"))))
        .when(F.col("doc_id") % 4 == 1, F.to_json(F.struct((800 + F.col("doc_id") % 100).alias("chunkSize"))))
        .when(F.col("doc_id") % 4 == 2, "not json")
    )
    defaults = Config()
    keys = {"chunkSize": str(defaults.chunkSize), "chunkOverlap": str(defaults.chunkOverlap), "embeddingModel": defaults.embeddingModel}
    rows = _read(spark, d, "documents").select("doc_id", stored.alias("json"))
    return rows.select("doc_id", *merged_columns(F.col("json"), keys)).toDF("id", "chunk_size", "chunk_overlap", "model")


@query(
    "SELECT event_id AS id, least(1.0, (event_id % 7 + CASE WHEN event_id % 5 > 0 THEN (event_id % 3) / (event_id % 5) ELSE 0.0 END) "
    "/ 6.0) AS progress FROM events"
)
def progress_view(spark, d):
    e = F.col("event_id")
    ops = _read(spark, d, "events").select(e.alias("id"), (e % 7).alias("done"), (e % 3).alias("chunk_done"), (e % 5).alias("chunk_total"), F.lit(6).alias("total"))
    return catalog.progress(ops).select("id", "progress")


# ---- text ------------------------------------------------------------------

#: Documents with CRLF ends, blank lines and some heading lines, in both dialects.
_MARKED = (
    "CASE WHEN doc_id % 3 = 0 THEN '# Head ' || doc_id || chr(10) || chr(10) || chr(10) ELSE '' END || replace(text, chr(10), "
    "chr(10) || chr(10)) || CASE WHEN doc_id % 4 = 0 THEN chr(10) || chr(10) || '## Two ' || chr(10) || 'last' ELSE '' END"
)


def _marked(spark, d) -> DataFrame:
    head = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("# Head "), F.col("doc_id").cast("string"), F.lit("\n\n\n"))).otherwise("")
    tail = F.when(F.col("doc_id") % 4 == 0, "\n\n## Two \nlast").otherwise("")
    return _read(spark, d, "documents").select("doc_id", "source", F.concat(head, F.replace("text", F.lit("\n"), F.lit("\n\n")), tail).alias("text"))


@query(
    "SELECT doc_id, regexp_replace(replace(text, chr(10), CASE WHEN doc_id % 2 = 0 THEN chr(13) || chr(10) ELSE chr(13) END), "
    "'\\r\\n?', chr(10), 'g') AS text FROM documents"
)
def newline_normalize(spark, d):
    ends = F.when(F.col("doc_id") % 2 == 0, "\r\n").otherwise("\r")
    return _read(spark, d, "documents").select("doc_id", T.normalize_newlines(F.replace("text", F.lit("\n"), ends)).alias("text"))


@query(
    f"SELECT doc_id, trim(regexp_replace({_MARKED}, '\\n{{3,}}', chr(10) || chr(10), 'g'), chr(32) || chr(9) || chr(10) || chr(13)) "
    "AS text FROM documents"
)
def blank_collapse(spark, d):
    return _marked(spark, d).select("doc_id", T.collapse_blank(F.col("text")).alias("text"))


#: White space as an SQL string.
_SPACE = " || ".join(f"chr({ord(c)})" for c in T.SPACES)


def _blocks(key: str, text: str, table: str) -> str:
    """SQL of paragraphs (key, pos, text, own, heading) of a table's texts; ``own`` is a paragraph's own heading."""
    return (
        f"marked AS (SELECT {key}, string_split_regex(trim(regexp_replace({text}, '\\n{{3,}}', chr(10) || chr(10), 'g'), {_SPACE}), "
        f"'\\n{{2,}}') AS blocks FROM {table}), "
        f"numbered AS (SELECT {key}, unnest(range(len(blocks))) AS n, unnest(blocks) AS block FROM marked), "
        f"lines AS (SELECT {key}, n, list_filter(list_transform(string_split(block, chr(10)), lambda x: trim(x, {_SPACE})), lambda x: x "
        "<> '') AS lines FROM numbered), "
        f"owned AS (SELECT {key}, n, array_to_string(lines, ' ') AS text, nullif(trim(regexp_extract(list_filter(lines, lambda x: "
        f"regexp_matches(x, '^#{{1,6}}\\s+.+$'))[1], '^#{{1,6}}\\s+(.+)$', 1), {_SPACE}), '') AS own "
        "FROM lines WHERE len(lines) > 0), "
        f"paras AS (SELECT {key} AS k, row_number() OVER (PARTITION BY {key} ORDER BY n) - 1 AS pos, text, last_value(own IGNORE NULLS) "
        f"OVER (PARTITION BY {key} ORDER BY n) AS heading FROM owned)"
    )


def _chunked(size: int, overlap: int) -> str:
    """SQL of the greedy chunker over ``paras``: each step of a document keeps the open text and gives what it closes; (k, idx, text, heading)."""
    step, over = size - overlap, f"open <> '' AND length(open) + 1 + length(p.text) > {size}"
    return f"""
steps(k, n, open, heading, given) AS (
  SELECT DISTINCT k, 0::BIGINT, '', CAST(NULL AS VARCHAR), CAST([] AS STRUCT(t VARCHAR, h VARCHAR)[]) FROM paras
  UNION ALL
  SELECT s.k, n + 1,
    CASE WHEN open = '' AND length(p.text) > {size} THEN '' WHEN {over} THEN right(trim(open, {_SPACE}), {overlap}) || chr(10) || p.text
         WHEN open = '' THEN p.text ELSE open || chr(10) || p.text END,
    CASE WHEN open = '' AND length(p.text) > {size} THEN coalesce(p.heading, s.heading) WHEN {over} THEN p.heading ELSE coalesce(s.heading, p.heading) END,
    CASE WHEN open = '' AND length(p.text) > {size}
         THEN list_transform(range(CAST(ceil((length(p.text) - {size}) / {step}.0) AS BIGINT) + 1), lambda i: {{'t': substr(p.text, i * {step} + 1, {size}), 'h': coalesce(p.heading, s.heading)}})
         WHEN {over} THEN [{{'t': trim(open, {_SPACE}), 'h': s.heading}}] ELSE CAST([] AS STRUCT(t VARCHAR, h VARCHAR)[]) END
  FROM steps s JOIN paras p ON p.k = s.k AND p.pos = s.n),
closed AS (
  SELECT k, n, given FROM steps
  UNION ALL SELECT k, n + 1, [{{'t': trim(open, {_SPACE}), 'h': heading}}] FROM steps QUALIFY n = max(n) OVER (PARTITION BY k) AND open <> ''),
given AS (SELECT k, n, unnest(range(len(given))) AS i, unnest(given) AS c FROM closed),
pieces AS (SELECT k, CAST(row_number() OVER (PARTITION BY k ORDER BY n, i) - 1 AS INTEGER) AS idx, c.t AS text, c.h AS heading FROM given)"""


_BLOCKS = _blocks("doc_id", _MARKED, "documents")


@query(f"WITH {_BLOCKS} SELECT k AS doc_id, CAST(pos AS INTEGER) AS pos, text FROM paras")
def paragraphs(spark, d):
    return _marked(spark, d).select("doc_id", F.posexplode(T.paragraphs(F.col("text"))).alias("pos", "p")).select("doc_id", "pos", F.col("p.text").alias("text"))


@query(f"WITH {_BLOCKS} SELECT k AS doc_id, CAST(pos AS INTEGER) AS pos, heading FROM paras")
def heading_carry(spark, d):
    return _marked(spark, d).select("doc_id", F.posexplode(T.paragraphs(F.col("text"))).alias("pos", "p")).select("doc_id", "pos", F.col("p.heading").alias("heading"))


_SPLIT = (
    "SELECT doc_id, source, CAST(i AS INTEGER) AS idx, substr(text, CAST(i * 1050 + 1 AS BIGINT), 1200) AS text "
    "FROM documents, LATERAL (SELECT unnest(range(greatest(0, CAST(ceil((length(text) - 1200) / 1050.0) AS BIGINT)) + 1)) AS i) "
    "WHERE length(text) > 0"
)


@query(f"SELECT doc_id, idx, text FROM ({_SPLIT})")
def hard_split(spark, d):
    return _read(spark, d, "documents").select("doc_id", F.posexplode(T.hard_split(F.col("text"), 1200, 150)).alias("idx", "text"))


@query(f"SELECT doc_id, idx, CAST(length(text) AS INTEGER) AS size, CAST(length(text) AS INTEGER) AS utf16_size FROM ({_SPLIT})")
def chunk_sizes(spark, d):
    rows = _read(spark, d, "documents").select("doc_id", F.posexplode(T.hard_split(F.col("text"), 1200, 150)).alias("idx", "text"))
    return rows.select("doc_id", "idx", F.length("text").alias("size"), T.utf16_length(F.col("text")).alias("utf16_size"))


@query(f"SELECT source AS kb_id, count(*) AS chunk_count FROM ({_SPLIT}) GROUP BY source")
def chunk_counts_per_base(spark, d):
    rows = _read(spark, d, "documents").select("source", F.explode(T.hard_split(F.col("text"), 1200, 150)).alias("text"))
    return rows.groupBy(F.col("source").alias("kb_id")).agg(F.count("*").alias("chunk_count"))


_TURNS = (
    f"talk AS (SELECT conv_id, turn, trim(replace(replace(text, chr(10), ' '), chr(13), ' '), {_SPACE}) AS text FROM conversations), "
    "paras AS (SELECT conv_id AS k, row_number() OVER (PARTITION BY conv_id "
    "ORDER BY turn) - 1 AS pos, text, CAST(NULL AS VARCHAR) AS heading FROM talk "
    "WHERE text <> '')"
)


@query(f"WITH RECURSIVE {_TURNS}, {_chunked(1200, 150)} SELECT k AS conv_id, idx, text FROM pieces")
def greedy_chunks(spark, d):
    line = T.trim(F.translate("text", "\n\r", "  "))
    talks = _read(spark, d, "conversations").select("conv_id", "turn", line.alias("text")).filter("text <> ''")
    blocks = talks.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("turns"))  # the turns of one conversation
    paras = F.transform("turns", lambda t: F.struct(t["text"].alias("text"), F.lit(None).cast("string").alias("heading")))
    return blocks.select("conv_id", F.posexplode(fold(paras, 1200, 150)).alias("idx", "c")).select("conv_id", "idx", F.col("c.text").alias("text"))


@query(f"WITH RECURSIVE {_BLOCKS}, {_chunked(600, 80)} SELECT k AS doc_id, idx, text, heading FROM pieces")
def heading_chunks(spark, d):
    """Chunks with headings of documents that have paragraphs."""
    return _marked(spark, d).select("doc_id", F.posexplode(chunked(F.col("text"), 600, 80)).alias("idx", "c")).select("doc_id", "idx", "c.text", "c.heading")


#: Names and first bytes for the dispatch.
_NAMES = "'d' || doc_id || ['.txt', '.DOCX', '', '.', '.tar.gz', '.pdf', '.xls', ':a?b/..\\c.md'][doc_id % 8 + 1]"
_HEADS = "['504B0304AA', 'D0CF11E0A1B11AE1AA', '255044462D312E34', '68656C6C6F'][doc_id % 5 % 4 + 1]"


def _named(spark, d) -> DataFrame:
    ends = F.array(*(F.lit(x) for x in (".txt", ".DOCX", "", ".", ".tar.gz", ".pdf", ".xls", ":a?b/..\\c.md")))
    heads = F.array(*(F.lit(x) for x in ("504B0304AA", "D0CF11E0A1B11AE1AA", "255044462D312E34", "68656C6C6F")))
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.element_at(ends, (F.col("doc_id") % 8 + 1).cast("int")))
    return _read(spark, d, "documents").select("doc_id", name.alias("name"), F.unhex(F.element_at(heads, (F.col("doc_id") % 5 % 4 + 1).cast("int"))).alias("content"))


@query(f"SELECT doc_id, lower(regexp_extract({_NAMES}, '\\.([^.]+)$', 1)) AS ext FROM documents")
def ext_parse(spark, d):
    return _named(spark, d).select("doc_id", T.extension(F.col("name")).alias("ext"))


@query(f"SELECT doc_id, replace(regexp_replace({_NAMES}, '[\\\\/:*?\"<>|]', '_', 'g'), '..', '_') AS name FROM documents")
def safe_name(spark, d):
    return _named(spark, d).select("doc_id", T.safe_name(F.col("name")).alias("name"))


@query(
    f"WITH n AS (SELECT doc_id, lower(regexp_extract({_NAMES}, '\\.([^.]+)$', 1)) AS ext, {_HEADS} AS head "
    "FROM documents) SELECT doc_id, CASE WHEN ext IN ('docx', 'pptx', 'xlsx') AND head LIKE '504B0304%' THEN 'ooxml' "
    "WHEN ext IN ('doc', 'ppt', 'xls') OR head LIKE 'D0CF11E0A1B11AE1%' THEN 'legacy' "
    "WHEN ext = 'pdf' OR head LIKE '255044462D%' THEN 'pdf' ELSE 'text' END AS reader "
    "FROM n"
)
def signature_dispatch(spark, d):
    return _named(spark, d).select("doc_id", T.reader_of(F.col("name"), F.col("content")).alias("reader"))


@query(
    "WITH c AS (SELECT doc_id, repeat(chr((doc_id % 32)::INTEGER), (doc_id % 400)::INTEGER) || repeat(md5(doc_id::VARCHAR), (doc_id "
    "% 41)::INTEGER) AS t FROM documents), h AS (SELECT doc_id, left(t, 1024) AS t, doc_id % 32 AS x "
    "FROM c) "
    "SELECT doc_id, length(t) = 0 OR (NOT (x = 0 AND doc_id % 400 > 0) AND (length(t) - "
    "CASE WHEN x IN (9, 10, 13) THEN 0 ELSE least(1024, doc_id % 400) END) / length(t) > 0.85) AS textual "
    "FROM h"
)
def text_likeness(spark, d):
    """Made-up bytes: as many control characters as the number of the document tells, then its digest, some times."""
    n = F.col("doc_id")
    control = F.repeat(F.char(n % 32), (n % 400).cast("int"))
    zeros = F.when(n % 32 == 0, F.repeat(F.lit("\0"), (n % 400).cast("int"))).otherwise(control)
    content = F.encode(F.concat(zeros, F.repeat(F.md5(n.cast("string").cast("binary")), (n % 41).cast("int"))), "UTF-8")
    return _read(spark, d, "documents").select("doc_id", T.looks_like_text(content).alias("textual"))


@query("SELECT page_id, regexp_replace(html, '<[^>]+>', ' ', 'g') AS text FROM pages")
def tag_strip(spark, d):
    return _read(spark, d, "pages").select("page_id", T.strip_tags(F.col("html")).alias("text"))


@query(
    "SELECT page_id AS id, regexp_matches(html, '(?i)<(!doctype|html|head|body|div|p|span|td|a|script|style)\\b') AS markup "
    "FROM pages UNION ALL SELECT -doc_id - 1, regexp_matches(text, '(?i)<(!doctype|html|head|body|div|p|span|td|a|script|style)\\b') "
    "FROM documents"
)
def markup_sniff(spark, d):
    pages = _read(spark, d, "pages").select(F.col("page_id").alias("id"), T.is_markup(F.col("html")).alias("markup"))
    return pages.unionByName(_read(spark, d, "documents").select((-F.col("doc_id") - 1).alias("id"), T.is_markup(F.col("text")).alias("markup")))


@query(
    "SELECT vec_id, CAST(vec_id % 26 + CASE WHEN vec_id % 2 = 0 THEN 26 * (vec_id % 3 + 1) ELSE 0 END AS INTEGER) AS col, "
    "left('chunk ' || vec_id || repeat('x', 300), 200) AS preview FROM embeddings"
)
def cell_columns(spark, d):
    last = F.char(65 + F.col("vec_id") % 26)
    first = F.when(F.col("vec_id") % 2 == 0, F.char(65 + F.col("vec_id") % 3)).otherwise("")
    text = F.concat(F.lit("chunk "), F.col("vec_id").cast("string"), F.lit("x" * 300))
    rows = _read(spark, d, "embeddings").select("vec_id", F.concat(first, last, F.lit("7")).alias("ref"), text.alias("text"))
    return rows.select("vec_id", T.column_index(F.col("ref")).alias("col"), T.preview(F.col("text")).alias("preview"))


# ---- files and models ------------------------------------------------------


_NODES = """
WITH bare AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '<x>', 'g'), '(?is)<style[^>]*>.*?</style>', '<x>', 'g') AS h FROM pages),
nodes AS (
  SELECT page_id, list_filter(list_transform(regexp_split_to_array(h, '<[^>]*>'), lambda x: trim(
    replace(replace(replace(replace(replace(replace(x, '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'),
    ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda x: x <> '') AS found
  FROM bare),
lines AS (
  SELECT page_id, regexp_replace(regexp_replace(array_to_string(found, chr(10)), '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g') AS t FROM nodes),
read AS (SELECT page_id, regexp_replace(t, '\\r\\n?', chr(10), 'g') AS text FROM lines)
SELECT page_id, text, 'html' AS subtype, CAST(length(text) AS INTEGER) AS char_count, CAST(NULL AS VARCHAR) AS error FROM read
"""


@query(_NODES)
def html_text(spark, d):
    """Text of all pages by the lenient reader."""
    pages = _read(spark, d, "pages").select("page_id", F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("name"), F.encode("html", "UTF-8").alias("content"))
    return extracted(pages).select("page_id", "text", "subtype", "char_count", "error")


#: Texts in legacy charsets, to which a number is put: what each looks like, its codec and the name it is reported by.
_FOREIGN = {3: ("河水很清 ", "gb18030", "gb18030"), 4: ("café ", "cp1252", "windows-1252"), 5: ("ｶﾅ ｱ ", "cp932", "shift_jis"), 6: ("中文 ", "big5", "big5")}


@query(
    "SELECT doc_id, ['utf-16le', 'utf-8', 'utf-8', 'gb18030', 'windows-1252', 'shift_jis', 'big5', 'utf-8'][doc_id % 8 + 1] AS encoding, "
    "doc_id % 8 IN (0, 2) AS had_bom, CAST(length(t) AS INTEGER) AS char_count, t AS text FROM (SELECT doc_id, CASE doc_id % 8 "
    + " ".join(f"WHEN {k} THEN '{text}' || doc_id" for k, (text, _, _) in _FOREIGN.items())
    + " WHEN 7 THEN ' ' || chr(65533) ELSE regexp_replace(text, '\\r\\n?', chr(10), 'g') END AS t FROM documents)"
)
def decode_charset(spark, d):
    """Documents with and without marks, others in four legacy charsets, and bytes that are blank in all of them, read back."""
    which, number = F.col("doc_id") % 8, F.encode(F.col("doc_id").cast("string"), "UTF-8")
    data = F.when(which == 0, F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE")))
    data = data.when(which == 2, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8")))
    for k, (text, codec, _) in _FOREIGN.items():
        data = data.when(which == k, F.concat(F.lit(text.encode(codec)), number))
    data = data.when(which == 7, F.unhex(F.lit("20A0"))).otherwise(F.encode("text", "UTF-8"))
    files = _read(spark, d, "documents").select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), data.alias("content"))
    return extracted(files).select("doc_id", "encoding", "had_bom", "char_count", "text")


def _zip(members: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name, data in members.items():
            archive.writestr(name, data)
    return out.getvalue()


#: Office files that Python holds at once.
_FILES = 256


def _made(batches: Iterable[pa.RecordBatch], make: Callable[[str], bytes]) -> Iterator[pa.RecordBatch]:
    """Batches of (conv_id, turn, text) with a file instead of the text, a slice at a time."""
    for whole in batches:
        for at in range(0, whole.num_rows, _FILES):
            batch = whole.slice(at, _FILES)
            content = pa.array([make(t) for t in batch.column(2).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), content], names=["conv_id", "turn", "content"])


def _office(spark, d, ext: str, make: Callable[[str], bytes]) -> DataFrame:
    """Every conversation turn as a small office file, written in Arrow batches and read back."""
    rows = _read(spark, d, "conversations").select("conv_id", "turn", F.translate("text", "<>&\n\r", "     ").alias("text"))
    made = rows.mapInArrow(lambda batches: _made(batches, make), "conv_id long, turn long, content binary").withColumn("name", F.lit(f"f.{ext}"))
    return extracted(made).select("conv_id", "turn", "kind", "subtype", "text", "error")


_LINE = "translate(text, '<>&' || chr(10) || chr(13), '     ')"
_READ = "SELECT conv_id, turn, 'office' AS kind, '{}' AS subtype, {} AS text, CAST(NULL AS VARCHAR) AS error FROM conversations"


@query(_READ.format("docx", f"{_LINE} || chr(9) || 'end'"))
def docx_text(spark, d):
    return _office(spark, d, "docx", lambda t: _zip({"word/document.xml": f'<w:document xmlns:w="w"><w:p><w:r><w:t>{t}</w:t></w:r><w:r><w:tab/><w:t>end</w:t></w:r></w:p></w:document>'}))


@query(_READ.format("pptx", f"'--- Slide 1 ---' || chr(10) || {_LINE} || ' 1' || chr(10) || '--- Slide 2 ---' || chr(10) || {_LINE} || ' 2'"))
def pptx_text(spark, d):
    return _office(spark, d, "pptx", lambda t: _zip({f"ppt/slides/slide{n}.xml": f'<p:s xmlns:p="p" xmlns:a="a"><a:p><a:r><a:t>{t} {n}</a:t></a:r></a:p></p:s>' for n in (2, 1)}))


@query(_READ.format("xlsx", f"'--- Sheet xl/worksheets/sheet1.xml ---' || chr(10) || {_LINE} || chr(9) || chr(9) || 'TRUE'"))
def xlsx_text(spark, d):
    return _office(spark, d, "xlsx", lambda t: _zip({"xl/sharedStrings.xml": f"<s><si><t>{t}</t></si></s>", "xl/worksheets/sheet1.xml": '<w><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="b"><v>1</v></c></row></w>'}))


@query(_READ.format("doc", f"array_to_string(list_transform(regexp_extract_all({_LINE} || ' and more', '[\\x20-\\x7e\\x{{80}}-\\x{{ff}}]{{4,}}'), lambda x: trim(x, {_SPACE})), ' ')"))
def ole_text(spark, d):
    return _office(spark, d, "doc", lambda t: bytes.fromhex(T.OLE2_SIGNATURE) + (t + " and more").encode("utf-16-le") + b"\x00\x00")


@query(_READ.format("doc", f"{_LINE} || chr(9) || 'end'"))
def renamed_office_text(spark, d):
    """Newer office files under an older extension."""
    return _office(spark, d, "doc", lambda t: _zip({"word/document.xml": f'<w:document xmlns:w="w"><w:p><w:r><w:t>{t}</w:t></w:r><w:r><w:tab/><w:t>end</w:t></w:r></w:p></w:document>'}))


def _talks(spark, d, kb_id: Column) -> DataFrame:
    """Conversations as raw files of a base."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("turns")  # of one conversation
    body = F.array_join(F.transform("turns", lambda t: t["text"]), "\n\n")
    number = F.col("conv_id").cast("string")
    return _read(spark, d, "conversations").groupBy("conv_id").agg(turns).select(
        kb_id.alias("kb_id"), number.alias("file_id"), F.concat(number, F.lit(".md")).alias("name"), F.lit("md").alias("ext"),
        F.concat_ws("/", kb_id, number, F.concat(number, F.lit(".md"))).alias("rel_path"),
        F.octet_length(body).cast("long").alias("size"), F.encode(body, "UTF-8").alias("content"),
    )


def _pipeline(spark, d) -> dict[str, DataFrame]:
    raw = _talks(spark, d, F.concat(F.lit("kb"), (F.col("conv_id") % 3).cast("string")))
    files, chunks = index_pieces(cut(embedded_pieces(raw, Config(), HashingEmbedder())), HashingEmbedder().name, now=0)
    bases = spark.createDataFrame([(f"kb{n}", f"Base {n}") for n in range(3)], "id string, name string")
    return {"files": files, "chunks": chunks, "bases": bases, "mounts": _mounts(spark, d).withColumn("kb_id", F.concat(F.lit("kb"), F.col("kb_id").cast("string")))}


_TALKS = (
    "talks AS (SELECT conv_id, regexp_replace(string_agg(text, chr(10) || chr(10) "
    "ORDER BY turn), '\\r\\n?', chr(10), 'g') AS body FROM conversations GROUP BY conv_id)"
)
_PIECES = f"{_TALKS}, {_blocks('conv_id', 'body', 'talks')}, {_chunked(1200, 150)}"


def _embedded(pieces: str, key: str) -> str:
    """SQL tables of the hashing embedder's vectors: ``units`` (key, d, x) has their components that aren't 0, as 32-bit floats."""
    return f"""
worded AS (SELECT {key}, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM {pieces}),
grams AS (SELECT {key}, md5(unnest(w || list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))) AS h FROM worded),
summed AS (
  SELECT {key}, CAST('0x' || h[1:8] AS BIGINT) % 64 AS d, sum(CASE WHEN CAST('0x' || h[9:10] AS BIGINT) >= 128 THEN 1 ELSE -1 END) AS n FROM grams GROUP BY ALL),
units AS (SELECT {key}, d, CAST(n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS FLOAT) AS x FROM summed WHERE n <> 0)"""


@query(
    f"WITH RECURSIVE {_PIECES}, {_embedded('pieces', 'k, idx')}, "
    "checks AS (SELECT k, idx, round(sum((d + 1) * CAST(x AS DOUBLE)), 6) AS checksum FROM units GROUP BY k, idx) "
    "SELECT sha256(k || '|' || idx) AS id, CAST(k AS VARCHAR) AS file_id, 'kb' || (k % 3) AS kb_id, idx, text, 64 AS dim, "
    "CAST(length(text) AS INTEGER) AS size, "
    "coalesce(checksum, 0.0) AS checksum FROM pieces LEFT JOIN checks USING (k, idx)"
)
def embed_pipeline(spark, d):
    """Conversations as files: extracted, chunked and embedded; the checksum weighs each component of a vector by its place."""
    places = F.sequence(F.lit(1), F.size("vector"))
    checksum = F.aggregate(F.zip_with("vector", places, lambda x, n: x.cast("double") * n), F.lit(0.0), lambda a, x: a + x)
    return _pipeline(spark, d)["chunks"].select("id", "file_id", "kb_id", "idx", "text", "dim", "size", F.round(checksum, 6).alias("checksum"))


@query(
    f"WITH RECURSIVE {_PIECES}, counts AS (SELECT k, count(*) AS n FROM pieces "
    "GROUP BY k) SELECT CAST(conv_id AS VARCHAR) AS id, 'kb' || (conv_id % 3) AS kb_id, 'text' AS kind, length(body) AS char_count, "
    "CAST(coalesce(n, 0) AS INTEGER) AS chunk_count, "
    "CASE WHEN n IS NULL THEN 'failed' ELSE 'ready' END AS status, CASE WHEN n IS NULL THEN 'no text was found' END AS error "
    "FROM talks LEFT JOIN counts ON k = conv_id"
)
def import_status(spark, d):
    return _pipeline(spark, d)["files"].select("id", "kb_id", "kind", "char_count", "chunk_count", "status", "error")


_QUESTION = "the and of that"


@query(
    f"WITH RECURSIVE {_PIECES}, asked AS (SELECT -1::BIGINT AS k, -1 AS idx, '{_QUESTION}' AS text), "
    f"every AS (SELECT k, CAST(idx AS BIGINT) AS idx, text FROM pieces UNION ALL SELECT k, idx, text FROM asked), {_embedded('every', 'k, idx')}, "
    "norms AS (SELECT k, idx, sqrt(sum(CAST(x AS DOUBLE) * x)) AS norm FROM units GROUP BY k, idx), "
    "wanted AS (SELECT d, n / sqrt(sum(n * n) OVER ()) AS q FROM summed WHERE k = -1), "
    "scored AS (SELECT k, idx, round(sum(CAST(x AS DOUBLE) * q) / any_value(norm), 12) AS score "
    "FROM units JOIN wanted USING (d) JOIN norms USING (k, idx) WHERE k >= 0 "
    "GROUP BY k, idx), "
    "placed AS (SELECT sha256(k || '|' || idx) AS chunk_id, k, idx, text, coalesce(score, 0.0) AS score "
    "FROM pieces LEFT JOIN scored USING (k, idx)), "
    "near AS (SELECT *, row_number() OVER (ORDER BY score DESC, idx, chunk_id) AS ordinal FROM placed ORDER BY ordinal LIMIT 20), "
    "judged AS (SELECT *, len(list_filter(['the', 'and', 'of', 'that'], lambda w: list_contains(regexp_extract_all(lower(text), "
    "'\\S+'), w))) / 4.0::DOUBLE AS r FROM near) "
    "SELECT chunk_id, k || '.md' AS file_name, 'Base ' || (k % 3) AS kb_name, round(score, 6) AS score, r AS rerank_score "
    "FROM judged ORDER BY r DESC, ordinal LIMIT 5"
)
def search_end_to_end(spark, d):
    """A question over these chunks, reranked."""
    found = search.search(_QUESTION, _pipeline(spark, d), HashingEmbedder(), 5, reranker=OverlapReranker())
    return found.select("chunk_id", "file_name", "kb_name", F.round("score", 6).alias("score"), "rerank_score")


# ---- the engine over a warehouse -------------------------------------------


def _engine(spark, d, embedder=None) -> tuple[KnowledgeEngine, dict[str, str]]:
    """A new warehouse below the shared checkpoint folder, with the conversations imported into the bases ``even`` and ``odd``."""
    ensure_checkpoint_dir(spark)
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir")
    engine = KnowledgeEngine(spark, f"{folder}/warehouse-{uuid.uuid4().hex}", embedder or HashingEmbedder(), OverlapReranker())
    bases = {name: engine.create_base(name) for name in ("even", "odd")}
    for rest, kb_id in enumerate(bases.values()):
        engine.import_rows(kb_id, _talks(spark, d, F.lit(kb_id)).filter(F.col("file_id").cast("long") % 2 == rest))
    return engine, bases


_STATES = (
    f"{_PIECES}, counts AS (SELECT k, count(*) AS n FROM pieces GROUP BY k), raws AS (SELECT conv_id, string_agg(text, chr(10) || "
    "chr(10) ORDER BY turn) AS raw FROM conversations GROUP BY conv_id)"
)


@query(
    f"WITH RECURSIVE {_STATES} SELECT conv_id || '.md' AS name, ['even', 'odd'][conv_id % 2 + 1] AS base, 'md' AS ext, "
    "CAST(strlen(raw) AS BIGINT) AS size, length(body) AS char_count, "
    "CAST(coalesce(n, 0) AS INTEGER) AS chunk_count, CASE WHEN n IS NULL THEN 'failed' ELSE 'ready' END AS status, "
    "CASE WHEN n IS NULL THEN 'no text was found' END AS error, "
    "CASE WHEN n > 0 THEN 'hashing-64' END AS embedding_model, CASE WHEN n > 0 THEN 64 END AS embedding_dim, sha256(raw) AS "
    "content_sha256 FROM talks JOIN raws USING (conv_id) LEFT JOIN counts ON k = conv_id"
)
def engine_import(spark, d):
    """Files of two bases after their import, with the bytes that were kept for them."""
    engine, bases = _engine(spark, d)
    name = F.when(F.col("kb_id") == bases["even"], "even").otherwise("odd").alias("base")
    kept = engine.store.read("raw").select(F.col("file_id").alias("id"), F.sha2("content", 256).alias("content_sha256"))
    shown = ("ext", "size", "char_count", "chunk_count", "status", "error", "embedding_model", "embedding_dim", "content_sha256")
    return engine.store.read("files").join(kept, "id").select("name", name, *shown)


@query(
    f"WITH RECURSIVE {_STATES}, kept AS (SELECT * FROM talks WHERE conv_id % 2 = 0 AND conv_id > (SELECT min(conv_id) "
    "FROM talks WHERE conv_id % 2 = 0)) "
    "SELECT conv_id || '.md' AS name, 'even' AS base, CAST(coalesce(n, 0) AS INTEGER) AS chunk_count, CAST(coalesce(n, 0) AS BIGINT) "
    "AS chunks, CASE WHEN n IS NULL THEN 'failed' ELSE 'ready' END AS status, "
    "CASE WHEN n > 0 THEN 'hashing-32' END AS embedding_model, CASE WHEN n > 0 THEN 32 END AS embedding_dim, CAST(strlen(raw) AS "
    "BIGINT) AS bytes FROM kept JOIN raws USING (conv_id) LEFT JOIN counts ON k = conv_id"
)
def engine_changes(spark, d):
    """What is left in all tables when a base and a file are deleted and the rest is embedded again by another model."""
    engine, bases = _engine(spark, d)
    engine.delete_base(bases["odd"])
    engine.delete_file(str(engine.files(bases["even"]).agg(F.min(F.col("id").cast("long"))).first()[0]))
    other = KnowledgeEngine(spark, engine.store.root, HashingEmbedder(32))
    operation = other.reindex(bases["even"])
    other.operations.wait(operation)
    names = engine.store.read("bases").select(F.col("id").alias("kb_id"), F.col("name").alias("base"))
    chunks = engine.store.read("chunks").filter("dim = 32 AND size(vector) = 32").groupBy(F.col("file_id").alias("id")).agg(F.count("*").alias("chunks"))
    raw = engine.store.read("raw").select(F.col("file_id").alias("id"), F.octet_length("content").cast("long").alias("bytes"))
    found = engine.store.read("files").join(names, "kb_id", "left").join(chunks, "id", "full").join(raw, "id", "full")
    return found.select("name", "base", "chunk_count", F.coalesce("chunks", F.lit(0)).alias("chunks"), "status", "embedding_model", "embedding_dim", "bytes")


@query(
    f"WITH RECURSIVE {_PIECES}, asked AS (SELECT -1::BIGINT AS k, -1 AS idx, '{_QUESTION}' AS text), "
    "every AS (SELECT k, CAST(idx AS BIGINT) AS idx, text FROM pieces WHERE k % 2 = 1 "
    f"UNION ALL SELECT k, idx, text FROM asked), {_embedded('every', 'k, idx')}, "
    "norms AS (SELECT k, idx, sqrt(sum(CAST(x AS DOUBLE) * x)) AS norm FROM units GROUP BY k, idx), "
    "wanted AS (SELECT d, n / sqrt(sum(n * n) OVER ()) AS q FROM summed WHERE k = -1), "
    "scored AS (SELECT k, idx, round(sum(CAST(x AS DOUBLE) * q) / any_value(norm), 12) AS score "
    "FROM units JOIN wanted USING (d) JOIN norms USING (k, idx) WHERE k >= 0 "
    "GROUP BY k, idx), "
    "placed AS (SELECT sha256(k || '|' || idx) AS chunk_id, k, idx, text, coalesce(score, 0.0) AS score "
    "FROM pieces LEFT JOIN scored USING (k, idx) WHERE k % 2 = 1) "
    "SELECT chunk_id, k || '.md' AS file_name, 'odd' AS kb_name, CAST(idx AS INTEGER) AS idx, text, round(score, 6) AS score "
    "FROM placed ORDER BY placed.score DESC, idx, chunk_id LIMIT 20"
)
def engine_search(spark, d):
    """A question to a workspace that has one of two bases switched on, by a request without reranking."""
    engine, bases = _engine(spark, d)
    engine.set_mount(bases["even"], "w")
    engine.set_mount(bases["even"], "w", enabled=False)
    engine.set_mount(bases["odd"], "w")
    status, answer = handle(engine, "POST", "search", {"query": _QUESTION, "workspace": "w", "topK": 99, "useRerank": False})
    assert status == 200 and answer["count"] == len(answer["hits"])
    hits = [(h["chunkId"], h["fileName"], h["kbName"], h["index"], h["text"], round(h["score"], 6)) for h in answer["hits"]]  # 20 at most
    return spark.createDataFrame(hits, "chunk_id string, file_name string, kb_name string, idx int, text string, score double")


@query(
    f"WITH RECURSIVE {_STATES}, files AS (SELECT conv_id, coalesce(n, 0) AS n, length(body) AS chars FROM talks LEFT JOIN counts ON k = conv_id) "
    "SELECT 'bases' AS route, ['even', 'odd'][rest + 1] AS name, count(conv_id) AS a, CAST(coalesce(sum(n), 0) AS BIGINT) AS b "
    "FROM (SELECT unnest([0, 1]) AS rest) LEFT JOIN files ON conv_id % 2 = rest "
    "GROUP BY rest "
    "UNION ALL SELECT 'files', conv_id || '.md', chars, n FROM files WHERE conv_id % 2 = 0 "
    "UNION ALL SELECT 'health', 'ok', 2, count(*) FROM files UNION ALL SELECT 'mounts', 'odd', 1, 0 "
    "UNION ALL SELECT 'mounts', 'even', 0, 0 UNION ALL SELECT 'config', 'hashing', 900, 7"
)
def engine_requests(spark, d):
    """Answers to the listing requests over two imported bases, as rows."""
    engine, bases = _engine(spark, d)
    names = {kb_id: name for name, kb_id in bases.items()}
    ask = lambda *request: handle(engine, *request)[1]
    for kb_id in names:
        ask("POST", "mounts", {"kbId": kb_id, "workspaceId": "w", "enabled": names[kb_id] == "odd"})
    ask("POST", "config", {"chunkSize": 900, "defaultTopK": 7, "embeddingModel": "hashing"})
    config, health = ask("GET", "config"), ask("GET", "health")
    rows = [("bases", x["name"], x["fileCount"], x["chunkCount"]) for x in ask("GET", "bases")]
    rows += [("files", x["name"], x["charCount"], x["chunkCount"]) for x in ask("GET", f"files?kbId={bases['even']}")]
    rows += [("health", "ok" if health["ok"] else "no", health["baseCount"], health["fileCount"])]
    rows += [("mounts", names[x["kbId"]], int(x["enabled"]), 0) for x in ask("GET", "mounts")]
    rows += [("config", config["embeddingModel"], config["chunkSize"], config["defaultTopK"])]
    return spark.createDataFrame(rows, "route string, name string, a long, b long")


@query(
    "SELECT doc_id, 'unknown' AS kind, 'pdf' AS subtype, '' AS text, 0 AS char_count, true AS degraded, 'PDF text is not supported' "
    "AS error FROM documents"
)
def pdf_rows(spark, d):
    """Documents behind the signature of a format that has no reader: rows that say so, whatever their names."""
    name = F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, ".pdf").otherwise(".txt"))
    files = _read(spark, d, "documents").select("doc_id", name.alias("name"), F.concat(F.lit(b"%PDF-1.7\n"), F.encode("text", "UTF-8")).alias("content"))
    files = files.withColumn("name", F.when(F.col("doc_id") % 4 == 1, F.concat("doc_id", F.lit(".bin"))).otherwise(F.col("name")))
    return extracted(files).select("doc_id", "kind", "subtype", "text", "char_count", "degraded", "error")


def _each(rows: DataFrame, answer: Callable, schema: str) -> DataFrame:
    """Rows of (number) as what ``answer`` gives of each number, in Arrow batches."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            found = [x for n in batch.column(0).to_pylist() for x in answer(n)]
            yield pa.RecordBatch.from_pylist([dict(zip(out.names, x)) for x in found], schema=out)

    return rows.mapInArrow(run, schema)


def _arguments(n: int):
    bodies = (
        {"query": f"q{n}", "topK": n % 30}, {"query": 5, "kbIds": [f"a{n}", 7, " "], "topK": 2.9}, {"query": "q", "kbId": f"b{n}", "useRerank": False},
        {"query": "q", "workspace": f"w{n}", "topK": True}, {"query": "q", "workspaceId": " ", "kbIds": "x"}, {},
    )
    a = search_arguments(bodies[n % 6])
    yield n, a["query"], ",".join(a["kb_ids"]), a["workspace_id"], a["top_k"], a["use_rerank"], candidate_budget(a["top_k"])


@query(
    "SELECT doc_id AS id, query, kb_ids, workspace_id, CAST(top_k AS INTEGER) AS top_k, m <> 2 AS use_rerank, CAST(greatest(4 * "
    "top_k, 20) AS INTEGER) AS budget FROM (SELECT doc_id, doc_id % 6 AS m, "
    "['q' || doc_id, '', 'q', 'q', 'q', ''][doc_id % 6 + 1] AS query, CASE doc_id % 6 "
    "WHEN 1 THEN 'a' || doc_id WHEN 2 THEN 'b' || doc_id ELSE '' END AS kb_ids, "
    "CASE WHEN doc_id % 6 = 3 THEN 'w' || doc_id END AS workspace_id, CASE WHEN doc_id % 6 = 1 THEN 2 "
    "WHEN doc_id % 6 = 0 AND doc_id % 30 > 0 THEN least(doc_id % 30, 20) ELSE 5 END AS top_k "
    "FROM documents)"
)
def search_bodies(spark, d):
    """Search arguments out of request bodies, right and wrong ones."""
    return _each(_read(spark, d, "documents").select("doc_id"), _arguments, "id long, query string, kb_ids string, workspace_id string, top_k int, use_rerank boolean, budget int")


def _ranking(n: int):
    answers = (
        {"results": [{"index": 0, "relevance_score": n / 8}, {"index": 1, "relevance_score": n}]}, {"data": [{"index": n, "relevance_score": -1}]},
        {"results": [{"index": "x", "relevance_score": 2.5}, {"relevance_score": None}, 7]}, {"results": {}, "data": None},
    )
    for place, (index, score) in enumerate(parse_ranking(json.loads(json.dumps(answers[n % 4])))):
        yield n, place, index, score


@query(
    "SELECT doc_id AS id, CAST(place AS INTEGER) AS place, CAST(idx AS BIGINT) AS idx, CAST(score AS DOUBLE) AS score FROM ("
    "SELECT doc_id, 0 AS place, CASE WHEN doc_id = 0 THEN 0 ELSE 1 END AS idx, doc_id AS score FROM documents WHERE doc_id % 4 = 0 "
    "UNION ALL SELECT doc_id, 1, CASE WHEN doc_id = 0 THEN 1 ELSE 0 END, doc_id / 8 FROM documents WHERE doc_id % 4 = 0 "
    "UNION ALL SELECT doc_id, 0, doc_id, -1 FROM documents WHERE doc_id % 4 = 1 "
    "UNION ALL SELECT doc_id, 0, 0, 2.5 FROM documents WHERE doc_id % 4 = 2 UNION ALL SELECT doc_id, 1, 0, 0 FROM documents WHERE doc_id % 4 = 2)"
)
def ranking_answers(spark, d):
    """Rankings out of a model's answers, in both shapes and broken ones."""
    return _each(_read(spark, d, "documents").select("doc_id"), _ranking, "id long, place int, idx long, score double")


class _Moody:
    """A model that fails on some texts in each way a model can."""

    name = "moody"

    def embed(self, texts: list[str]) -> list[list[float]]:
        mood = int(texts[0].split()[0]) % 5
        if mood == 0:
            raise RuntimeError("model is away")
        return {1: [[]], 2: [[1.0], [1.0]]}.get(mood, [[1.0, 2.0, float(mood)]] * len(texts))


@query(
    "SELECT doc_id, CASE WHEN doc_id % 6 = 5 THEN NULL ELSE CASE doc_id % 5 "
    "WHEN 0 THEN 'model is away' WHEN 1 THEN 'a vector is empty' WHEN 2 THEN '2 vectors for 1 texts' END END AS embed_error, "
    "CASE WHEN doc_id % 6 <> 5 AND doc_id % 5 > 2 THEN 3 ELSE 0 END AS dim, "
    "CASE WHEN doc_id % 6 <> 5 AND doc_id % 5 > 2 THEN CAST(doc_id % 5 AS DOUBLE) END AS last "
    "FROM documents"
)
def embed_failures(spark, d):
    """What rows say where a model fails; each text is a request of its own, rows without text are not sent."""
    text = F.when(F.col("doc_id") % 6 != 5, F.concat_ws(" ", F.col("doc_id").cast("string"), F.substring("text", 1, 20)))
    found = embedded(_read(spark, d, "documents").select("doc_id", text.alias("text")), _Moody(), batch=1)
    return found.select("doc_id", "embed_error", F.coalesce(F.size("vector"), F.lit(0)).alias("dim"), F.element_at("vector", -1).cast("double").alias("last"))
