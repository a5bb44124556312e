"""The engine that users call: catalog, import, search and re-embedding over a warehouse folder."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.config import Config
from quillmere.operators import catalog, search
from quillmere.operators.ingest import MISSING, STOPPED, embedded_pieces, index_pieces, waiting_files
from quillmere.operators.operations import Operation, Operations, Stopped
from quillmere.schemas import BASES, KEYS, MOUNTS
from quillmere.sources.files import raw_rows, read_files
from quillmere.sources.models import Embedder, HttpEmbedder, HttpReranker, Reranker, probe
from quillmere.sources.store import BUCKETS, TableStore

#: Files of a batch that is indexed and committed at once, and batches of an operation: beyond so many, batches grow with the files.
BATCH_FILES, MOST_BATCHES = 500, 4


class KnowledgeEngine:
    """One warehouse. ``clock`` gives milliseconds; models default to those of the configuration, over HTTP.

    A base of a new warehouse has ``buckets`` buckets. Files are indexed in
    batches of whole buckets, of ``batch_files`` files or more, and no more than
    ``most_batches`` of them. Each batch is one plan and is
    committed when it is through, so stopping leaves the files of earlier
    batches ready and fails only those in hand.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        embedder: Embedder | None = None,
        reranker: Reranker | None = None,
        workspaces: Iterable[dict] = (),
        clock: Callable[[], int] = lambda: int(time.time() * 1000),
        batch_files: int = BATCH_FILES,
        buckets: int = BUCKETS,
        most_batches: int = MOST_BATCHES,
    ):
        self.spark, self.clock, self.batch_files, self.most_batches = spark, clock, batch_files, most_batches
        self.store = TableStore(spark, root, buckets=buckets)
        self.workspaces = [dict(w) for w in workspaces]
        self._embedder, self._reranker = embedder, reranker
        self.operations = Operations(spark)

    def close(self) -> None:
        """Cancel what still runs."""
        self.operations.stop_all()

    # configuration

    def get_config(self) -> Config:
        row = self.store.read("settings").filter("id = 1").first()
        return Config.merged(row.json if row else None)

    def save_config(self, patch: dict) -> Config:
        """Put values into the configuration, whatever others put there meanwhile."""
        merged: list[Config] = []

        def change(stored: DataFrame) -> DataFrame:
            row = stored.filter("id = 1").first()
            merged.append(Config.merged(row.json if row else None, patch).checked())
            return self.spark.createDataFrame([(1, merged[-1].to_json())], "id int, json string")

        self.store.rewrite("settings", change)
        return merged[-1]

    def embedder(self) -> Embedder:
        config = self.get_config()
        return self._embedder or HttpEmbedder(config.endpointBaseUrl, config.embeddingModel, config.apiKey)

    def reranker(self) -> Reranker | None:
        config = self.get_config()
        return self._reranker or (HttpReranker(config.rerank_endpoint(), config.rerankModel, config.apiKey) if config.rerankModel else None)

    def probe(self, overrides: dict | None = None) -> dict:
        """Whether the model answers; ``overrides`` are configuration values that are tried before they are saved."""
        given = {k: v for k, v in (overrides or {}).items() if k in ("endpointBaseUrl", "embeddingModel", "apiKey") and isinstance(v, str) and (v or k == "apiKey")}
        if not given:
            return probe(self.embedder())
        config = Config.merged(json.loads(self.get_config().to_json()), given)
        return probe(HttpEmbedder(config.endpointBaseUrl, config.embeddingModel, config.apiKey))

    # bases, files, mounts

    def create_base(self, name: str, description: str = "") -> str:
        now, kb_id = self.clock(), str(uuid.uuid4())
        self.store.append("bases", self.spark.createDataFrame([(kb_id, name, description, now, now)], BASES))
        return kb_id

    def list_bases(self) -> DataFrame:
        t = self.store.tables()
        return catalog.with_counts(t["bases"], t["files"], t["chunks"])

    def delete_base(self, kb_id: str) -> None:
        """The base and all that belongs to it. Its row goes last, so that one who was interrupted can ask again."""
        for name in KEYS:
            self.store.drop_base(name, kb_id)
        for name, key in (("mounts", "kb_id"), ("bases", "id")):
            self.store.replace(name, key, self._ids([kb_id]))

    def clean_up(self, older_than: float = 86_400) -> list[str]:
        """Remove what imports that died have left, unchanged for so many seconds, and rows of bases that are gone; gives their paths or ids."""
        there = {r.id for r in self.store.read("bases").select("id").collect()}  # a row per base
        gone = sorted(set().union(*(self.store.bases(name) for name in KEYS)) - there)
        for kb_id in gone:
            self.delete_base(kb_id)
        return self.store.clean(older_than) + gone

    def _ids(self, ids: Iterable[str]) -> DataFrame:
        return self.spark.createDataFrame([(x,) for x in ids], "id string")

    def files(self, kb_id: str) -> DataFrame:
        return catalog.files_of_base(self.store.read("files", [kb_id]), kb_id)

    def base(self, kb_id: str) -> DataFrame:
        return catalog.base_by_id(self.store.read("bases"), self.store.read("files", [kb_id]), self.store.read("chunks", [kb_id]), kb_id)

    def delete_file(self, file_id: str) -> None:
        """The file, its bytes and chunks; in each table only the parts of its bucket that hold it are written anew."""
        known = self.store.read("files", keys=[file_id]).select("kb_id").first()
        for name, key in KEYS.items():  # files last, so that one who was interrupted can ask again
            self.store.replace(name, key, self._ids([file_id]), kb_ids=[known.kb_id] if known else None)

    def read_file_bytes(self, rel_path: str) -> bytes | None:
        """The bytes kept for a file; only its bucket is read."""
        place = rel_path.split("/") if rel_path else []
        if len(place) < 3:
            return None
        row = self.store.read("raw", [place[0]], [place[1]]).filter(F.col("rel_path") == rel_path).select("content").first()
        return bytes(row.content) if row else None

    def set_mount(self, kb_id: str, workspace_id: str, enabled: bool = True, note: str = "") -> DataFrame:
        """Switch a base on or off for a workspace; gives the mount's row."""
        new = self.spark.createDataFrame([(kb_id, workspace_id, enabled, note, self.clock())], MOUNTS)
        self.store.rewrite("mounts", lambda mounts: catalog.set_mounts(mounts, new))
        return self.store.read("mounts").filter((F.col("kb_id") == kb_id) & (F.col("workspace_id") == workspace_id))

    def delete_mount(self, kb_id: str, workspace_id: str) -> None:
        self.store.rewrite("mounts", lambda mounts: catalog.delete_mount(mounts, kb_id, workspace_id))

    def mounts(self) -> DataFrame:
        return self.store.read("mounts")

    def health(self) -> DataFrame:
        return catalog.health(self.store.read("bases"), self.store.read("files"))

    # import and re-embedding

    def import_folder(self, kb_id: str, path: str, pattern: str = "*") -> DataFrame:
        """Import every file under a folder; gives the files' rows. A broken file is a failed row."""
        return self.import_rows(kb_id, raw_rows(read_files(self.spark, path, pattern), kb_id), path)

    def import_file(self, kb_id: str, name: str, content: bytes) -> DataFrame:
        """Import one file from memory; gives its row. Empty bytes are an error of the caller."""
        if not content:
            raise ValueError("empty upload")
        files = self.spark.createDataFrame([(f"{uuid.uuid4()}/{name}", name, len(content), content)], "path string, name string, size long, content binary")
        return self.import_rows(kb_id, raw_rows(files, kb_id), name)

    def import_rows(self, kb_id: str, raw: DataFrame, label: str = "import") -> DataFrame:
        """Keep raw files and index them, as an operation that can be watched and stopped; gives the files' rows.

        Files are ``indexing`` until they are ready or have failed; where the
        import is stopped, those that aren't ready have failed.
        """
        if self.store.read("bases").filter(F.col("id") == kb_id).isEmpty():
            raise ValueError(f"there is no base {kb_id}")
        ids = raw.select(F.col("file_id").alias("id"))
        try:
            self.operations.run("import", label, ids.count(), lambda op: self._import(op, kb_id, raw), kb_id)
        except Stopped:
            pass
        return self.store.read("files", [kb_id]).join(ids, "id", "left_semi")

    def _import(self, op: Operation, kb_id: str, raw: DataFrame) -> None:
        """Bytes are written once and read again from just the parts that were written."""
        parts = self.store.replace("raw", "file_id", raw.select("file_id"), raw, [kb_id], merge=False)
        kept = self.store.rows("raw", parts)
        waiting = waiting_files(kept, "indexing", self.clock())
        self.store.replace("files", "id", waiting.select("id"), self._created(waiting, [kb_id]), [kb_id])
        rest = self.store.buckets_in(parts)
        try:
            for some in self._batches(rest, op.total):
                self._index(op, kept.filter(F.col("bucket").isin(some)), [kb_id], some, keep_old=False)
                rest = [x for x in rest if x not in some]
        except Exception as e:
            reason = STOPPED if op.stopped else str(e)[:400]
            left = self.store.rows("raw", parts).filter(F.col("bucket").isin(rest)).select(F.col("file_id").alias("id"))
            self.operations.without_tag(op, lambda: self._fail(left, reason, "indexing"))
            raise
        finally:
            self.operations.without_tag(op, lambda: self.store.merge("raw", parts))

    def _batches(self, buckets: list[int], files: int) -> list[list[int]]:
        """Buckets in batches. Each costs the same plans and commits however many files it has, so their number is bounded."""
        n = max(1, min(len(buckets), self.most_batches, -(-files // self.batch_files)))
        return [buckets[k::n] for k in range(n)]

    def _created(self, rows: DataFrame, kb_ids: list[str] | None, buckets: list[int] | None = None) -> DataFrame:
        """``rows`` of files with the time of creation that the table has for them."""
        known = self.store.read("files", kb_ids, buckets=buckets)
        created = known.select("id", F.col("created_at").alias("_created"))
        return rows.join(created, "id", "left").withColumn("created_at", F.coalesce("_created", "created_at")).select(*known.columns)

    def _index(self, op: Operation, raw: DataFrame, kb_ids: list[str] | None, buckets: list[int], keep_old: bool) -> None:
        """Index a batch of raw files. Every file is read and every text embedded once: the pieces are written, then both tables made from them.

        With ``keep_old``, a file that fails again keeps the chunks it has. Once
        the chunks of the batch are in their table, its files follow even if the
        operation is stopped.
        """
        ids, staged, finish = raw.select(F.col("file_id").alias("id")), None, None
        try:
            embedder = self.embedder()
            pieces, staged = self.store.staged(embedded_pieces(raw.drop("bucket"), self.get_config().checked(), embedder, op.counter.add))
            files, chunks = index_pieces(pieces, embedder.name, self.clock())
            gone = files.filter("status = 'ready'").select("id") if keep_old else files.select("id")
            self.store.replace("chunks", "file_id", gone, chunks, kb_ids)
            finish = lambda: self.store.replace("files", "id", files.select("id"), self._created(files, kb_ids, buckets), kb_ids)
            finish()
            op.done = min(op.total, op.done + ids.count())
        except Exception as e:
            reason = STOPPED if op.stopped else str(e)[:400]
            self.operations.without_tag(op, finish or (lambda: self._fail(ids, reason)))
            raise
        finally:
            if staged:
                self.store.delete(staged)

    def _fail(self, ids: DataFrame, reason: str, only: str | None = None) -> None:
        """Mark files as failed, or just those in one state; their chunks stay."""
        known = self.store.read("files").join(ids.select("id").distinct(), "id", "left_semi")
        known = known if only is None else known.filter(F.col("status") == only)
        patch = known.select("id", F.lit("failed").alias("status"), F.lit(reason).alias("error"))
        self.store.replace("files", "id", known.select("id"), catalog.patch_files(known, patch, self.clock()))

    def reindex(self, kb_id: str | None = None) -> str:
        """Embed all files of a base, or of all bases, again, in batches under a tag; gives the operation's id."""
        scope = None if kb_id is None else [kb_id]
        files = self.store.read("files", scope)
        kind, label = ("reindex-all", "all bases") if kb_id is None else ("reindex-base", kb_id)
        total, chunks = files.agg(F.count("*"), F.coalesce(F.sum("chunk_count"), F.lit(0))).first()
        return self.operations.start(kind, total, lambda op: self._reindex(op, scope), kb_id, label, chunks)

    def _reindex(self, op: Operation, scope: list[str] | None, keys: list[str] | None = None) -> None:
        """Batches of buckets; in each only its own folders of the raw table are read. Files whose bytes are gone fail."""
        now = self.store.snapshot("files")
        buckets = self.store.buckets_of(keys, now.buckets) if keys else self.store.buckets_in(now.parts)
        for some in self._batches(buckets, op.total):
            files = self.store.read("files", scope, keys, some).select("id")
            raw = self.store.read("raw", scope, keys, some)
            missing = files.join(raw.select(F.col("file_id").alias("id")), "id", "left_anti")
            if not missing.isEmpty():
                self._fail(missing, MISSING)
            self._index(op, raw.join(files.select(F.col("id").alias("file_id")), "file_id", "left_semi"), scope, some, keep_old=True)

    def reembed_file(self, file_id: str) -> DataFrame | None:
        """Embed one file again; None if there is no such file, or its bytes are gone and it has failed. Only its bucket is read."""
        known = self.store.read("files", keys=[file_id]).select("kb_id").first()
        if known is None:
            return None
        self.operations.run("reindex-file", file_id, 1, lambda op: self._reindex(op, [known.kb_id], [file_id]), known.kb_id)
        row = self.store.read("files", [known.kb_id], [file_id])
        return None if row.filter(F.col("error") == MISSING).count() else row

    # search

    def search(self, query: str, kb_ids=None, workspace_id=None, top_k: int | None = None, use_rerank: bool = True, candidate_k: int | None = None) -> DataFrame:
        """Hits of a question. Chunks and files of other bases are not opened; texts and names are read from the buckets of the hits' files."""
        top = top_k if top_k is not None else self.get_config().defaultTopK
        model = self.reranker() if use_rerank else None
        tables = {x: self.store.read(x) for x in ("bases", "mounts")} | {x: self.store.read(x, kb_ids or None) for x in ("files", "chunks")}

        def lookup(hits: list) -> tuple[DataFrame, DataFrame]:
            where = {h.kb_id for h in hits}, {h.file_id for h in hits}
            return self.store.read("chunks", *where), self.store.read("files", *where)

        return search.search(query, tables, self.embedder() if query.strip() else None, top, kb_ids, workspace_id, model, candidate_k, lookup=lookup)
