"""Scoped retrieval: candidates, cosine top-k, rerank.

What is scored are vectors and ids alone. Texts, headings and names are fetched
for the rows that are left, by their ids.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillmere.config import candidate_budget
from quillmere.functions.vectors import DIGITS, scored, top_k
from quillmere.operators.catalog import workspace_bases
from quillmere.sources.checkpoint import cut
from quillmere.sources.models import Embedder, Reranker, embed_texts

#: Questions of a block when many are asked at once.
QUERY_BLOCK = 1024
#: Columns of a hit before it is scored.
_HIT = ("chunk_id", "file_id", "kb_id", "file_name", "kb_name", "text", "idx", "heading")


def in_scope(chunks: DataFrame, mounts: DataFrame | None = None, kb_ids: Sequence | None = None, workspace_id=None) -> DataFrame:
    """Chunks of the named bases, else of those that the workspace has switched on, else all."""
    if kb_ids:
        return chunks.filter(F.col("kb_id").isin(list(kb_ids)))
    if workspace_id is not None:
        return chunks.join(workspace_bases(mounts, workspace_id), "kb_id", "left_semi")
    return chunks


def candidates(chunks: DataFrame, bases: DataFrame, files: DataFrame, cap: int | None = None) -> DataFrame:
    """Chunks with a vector, joined to the names of their file and base; files and bases that are gone drop them.

    ``cap`` keeps the chunks with the lowest places in their files, as the
    reference does with 10,000; by default every chunk is searched. Which side
    is broadcast Spark decides by size: files grow with the data.
    """
    found = (
        chunks.filter(F.col("vector").isNotNull())
        .join(bases.select(F.col("id").alias("kb_id"), F.col("name").alias("kb_name")), "kb_id")
        .join(files.select(F.col("id").alias("file_id"), F.col("name").alias("file_name")), "file_id")
        .select(F.col("id").alias("chunk_id"), *_HIT[1:], "vector")
    )
    return found if cap is None else found.orderBy("idx", "chunk_id").limit(max(1, cap))


def nearest(found: DataFrame, query: Sequence[float], k: int) -> DataFrame:
    """The k candidates of the query's dimension with the highest cosine; ties by place, then id."""
    return top_k(scored(found, query), k, "idx", "chunk_id")


def recall(chunks: DataFrame, bases: DataFrame, files: DataFrame, query: Sequence[float], k: int, cap: int | None = None) -> DataFrame:
    """(chunk_id, file_id, kb_id, idx, score) of the k nearest chunks whose file and base are there.

    Only ids, places and vectors are read; ``cap`` is that of ``candidates``.
    """
    found = (
        chunks.filter(F.col("vector").isNotNull())
        .select(F.col("id").alias("chunk_id"), "file_id", "kb_id", "idx", "vector")
        .join(bases.select(F.col("id").alias("kb_id")), "kb_id", "left_semi")
        .join(files.select(F.col("id").alias("file_id")), "file_id", "left_semi")
    )
    return nearest(found if cap is None else found.orderBy("idx", "chunk_id").limit(max(1, cap)), query, k)


#: From some rows of a recall to the (chunks, files) to look in for their texts and names.
Lookup = Callable[[list], tuple[DataFrame, DataFrame]]


def described(hits: DataFrame, chunks: DataFrame, bases: DataFrame, files: DataFrame, lookup: Lookup | None = None) -> DataFrame:
    """The columns of a hit and ``ordinal`` for the rows of a recall, whose number the caller has bounded.

    Without ``lookup``, texts and names are looked for in all of ``chunks`` and
    ``files``. Either way ids and bases reach the scans as literals.
    """
    rows = hits.collect()  # as many as were recalled
    some = lambda c: sorted({r[c] for r in rows})
    local = hits.sparkSession.createDataFrame([(n, *r) for n, r in enumerate(rows)], f"ordinal int, {hits.schema.simpleString()[7:-1]}")
    chunks, files = lookup(rows) if lookup and rows else (chunks, files)
    known = chunks.filter(F.col("kb_id").isin(some("kb_id")) & F.col("id").isin(some("chunk_id")))
    return (
        local.join(known.select(F.col("id").alias("chunk_id"), "text", "heading"), "chunk_id")
        .join(bases.filter(F.col("id").isin(some("kb_id"))).select(F.col("id").alias("kb_id"), F.col("name").alias("kb_name")), "kb_id")
        .join(files.filter(F.col("id").isin(some("file_id"))).select(F.col("id").alias("file_id"), F.col("name").alias("file_name")), "file_id")
        .select("ordinal", *_HIT, "score")
    )


def batch_nearest(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, chunk_id, score) for a stated set of queries (query_id, vector) against all chunks.

    Queries are broadcast, a block of about ``QUERY_BLOCK`` at a time: no chunk
    vector moves, each Arrow batch of chunks keeps k rows per query, and those
    are ranked. Where there are several blocks, each has its own scan of the
    chunks, whose result is written before the next block is sent, so that the
    driver and the executors hold one block at once. Vectors of another
    dimension, or with a null, meet nothing; ties go by chunk id; a query that
    repeats is asked once.
    """
    whole = lambda df, key, vector: df.filter(F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull())).select(
        F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"), F.size(vector).alias("dim")
    )
    asked, stored = whole(queries, "query_id", "vector").dropDuplicates(["key", "v"]), whole(chunks, "id", "vector")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    if blocks == 1:
        return _against_all(asked, stored, k)
    of_block = F.pmod(F.xxhash64("key", "v"), F.lit(blocks))
    found = [cut(_against_all(asked.filter(of_block == n), stored, k)) for n in range(blocks)]
    return _ranked(reduce(DataFrame.unionByName, found), k)  # a query with several vectors may lie in several blocks


def _against_all(asked: DataFrame, stored: DataFrame, k: int) -> DataFrame:
    """A block of queries, which the caller has bounded, against all chunks."""
    kinds = [dict(df.dtypes)["key"] for df in (asked, stored)]
    ddl = f"query_id {kinds[0]}, chunk_id {kinds[1]}, score double"
    schema = to_arrow_schema(T.StructType.fromDDL(ddl))
    shared = stored.sparkSession.sparkContext.broadcast(asked.toArrow())

    def run(batches):
        dims = np.asarray(shared.value["dim"])
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            for dim in np.unique(np.asarray(rows["dim"])):
                yield from _best(shared.value.filter(pa.array(dims == dim)), rows.filter(pc.equal(rows["dim"], int(dim))), k, schema).to_batches()

    return _ranked(stored.mapInArrow(run, ddl), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "score")


def _best(left: pa.Table, right: pa.Table, k: int, schema: pa.Schema) -> pa.Table:
    """The k nearest rows of ``right`` for each of ``left``, all of one dimension."""
    rows: list[pa.Table] = []
    if left.num_rows and right.num_rows:
        right = right.sort_by("key")
        x, y = _unit_rows(left), _unit_rows(right)
        keep = min(k, len(y))
        for at in range(0, len(x), 64):
            score = (x[at : at + 64] @ y.T).round(DIGITS)
            best = np.argsort(-score, axis=1, kind="stable")[:, :keep]
            who = np.repeat(np.arange(at, at + len(score)), keep)
            rows.append(pa.table([left["key"].take(pa.array(who)), right["key"].take(pa.array(best.ravel())), pa.array(np.take_along_axis(score, best, 1).ravel())], schema=schema))
    return pa.concat_tables(rows) if rows else schema.empty_table()


def _unit_rows(table: pa.Table) -> np.ndarray:
    """Vectors of a block at unit length; zero vectors stay, so that their cosine is 0."""
    x = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def rerank_merge(hits: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """The k best hits by rerank score. ``hits`` have ``ordinal``, their place by cosine; ``scores`` are (index, relevance).

    Hits that have no score count 0, scores that are no finite number count as
    missing, and of several for one hit the lowest counts; ties keep the order
    by cosine.
    """
    fine = scores.filter(~F.isnan("relevance") & (F.abs("relevance") < F.lit(float("inf"))))
    known = fine.groupBy(F.col("index").alias("ordinal")).agg(F.min("relevance").alias("_relevance"))
    merged = hits.join(known, "ordinal", "left").withColumn("rerank_score", F.coalesce("_relevance", F.lit(0.0))).drop("_relevance")
    return merged.orderBy(F.desc("rerank_score"), "ordinal").limit(max(0, k))


def search(
    query: str,
    tables: dict[str, DataFrame],
    embedder: Embedder,
    top: int = 5,
    kb_ids: Sequence | None = None,
    workspace_id=None,
    reranker: Reranker | None = None,
    candidate_k: int | None = None,
    cap: int | None = None,
    lookup: Lookup | None = None,
) -> DataFrame:
    """Hits of a question. A blank question has none, and then no model is asked.

    With a reranker, the recalled candidates (80 at most for the highest
    ``top``) are sent to it; if it fails, their order by cosine stands. ``lookup``
    is that of ``described``.
    """
    chunks, bases, files = (tables[x] for x in ("chunks", "bases", "files"))
    none = F.lit(None).cast("double").alias("rerank_score")
    if not query.strip():
        return candidates(chunks, bases, files).select(*_HIT, F.lit(0.0).alias("score"), none).limit(0)
    vector = embed_texts(embedder, [query])[0]
    budget = candidate_budget(top, candidate_k)
    nearby = recall(in_scope(chunks, tables["mounts"], kb_ids, workspace_id), bases, files, vector, budget if reranker else min(top, budget), cap)
    hits = described(nearby, chunks, bases, files, lookup)
    if reranker is None:
        return hits.orderBy("ordinal").select(*_HIT, "score", none)
    rows = hits.orderBy("ordinal").collect()  # candidate_budget rows
    spark = chunks.sparkSession
    local = spark.createDataFrame(rows, hits.schema)
    try:
        ranking = [(int(rows[int(i)].ordinal), float(s)) for i, s in reranker.rank(query, [r.text for r in rows]) if 0 <= int(i) < len(rows)] if rows else []
    except Exception:  # noqa: BLE001  a failing reranker degrades to cosine
        ranking = []
    merged = rerank_merge(local, spark.createDataFrame(ranking, "index int, relevance double"), top)
    return merged.select(*_HIT, "score", "rerank_score")
