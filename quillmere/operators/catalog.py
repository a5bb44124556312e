"""The catalog - bases, files, chunks, mounts, settings - as state before to state after.

Tables are immutable: each operation is a plan over the rows before it, written
as the next snapshot by the engine. Deletes are anti-joins, updates take the
latest version, and nothing is gathered on the driver.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_counts(bases: DataFrame, files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Bases with the numbers of their files and chunks, 0 where there are none; the newest first."""
    n_files = files.groupBy(F.col("kb_id").alias("id")).agg(F.count("*").alias("file_count"))
    n_chunks = chunks.groupBy(F.col("kb_id").alias("id")).agg(F.count("*").alias("chunk_count"))
    counted = bases.join(n_files, "id", "left").join(n_chunks, "id", "left")
    return counted.fillna(0, ["file_count", "chunk_count"]).orderBy(F.desc("created_at"), "id")


def base_by_id(bases: DataFrame, files: DataFrame, chunks: DataFrame, kb_id) -> DataFrame:
    """One base with its counts; no row if there is none. The condition reaches all three scans."""
    own = lambda df, c: df.filter(F.col(c) == F.lit(kb_id))
    return with_counts(own(bases, "id"), own(files, "kb_id"), own(chunks, "kb_id"))


def files_of_base(files: DataFrame, kb_id) -> DataFrame:
    return files.filter(F.col("kb_id") == F.lit(kb_id)).orderBy(F.desc("created_at"), "id")


def file_by_id(files: DataFrame, file_id) -> DataFrame:
    return files.filter(F.col("id") == F.lit(file_id))


def file_names(files: DataFrame) -> DataFrame:
    """(id, name): the small side of joins that show names."""
    return files.select("id", "name")


def chunks_of_bases(chunks: DataFrame, kb_ids: Iterable) -> DataFrame:
    return chunks.filter(F.col("kb_id").isin(list(kb_ids)))


def chunk_ids(chunks: DataFrame, kb_ids: Iterable) -> DataFrame:
    return chunks_of_bases(chunks, kb_ids).select("id")


def health(bases: DataFrame, files: DataFrame) -> DataFrame:
    """One row: number of bases, and of the files in them."""
    counted = bases.join(files.groupBy(F.col("kb_id").alias("id")).agg(F.count("*").alias("n")), "id", "left")
    return counted.agg(F.count("*").alias("bases"), F.coalesce(F.sum("n"), F.lit(0)).alias("files"))


def without(rows: DataFrame, doomed: DataFrame, **keys: str) -> DataFrame:
    """``rows`` for which ``doomed`` has no row with the same keys, given as column of rows = column of doomed."""
    gone = doomed.select(*(F.col(b).alias(f"_gone_{b}") for b in keys.values())).distinct()
    return rows.join(gone, [rows[a].eqNullSafe(gone[f"_gone_{b}"]) for a, b in keys.items()], "left_anti")


def delete_base(tables: dict[str, DataFrame], kb_id) -> dict[str, DataFrame]:
    """All tables without a base and what belongs to it."""
    keeps = {"bases": "id", "files": "kb_id", "chunks": "kb_id", "mounts": "kb_id"}
    return {name: rows.filter(~F.col(keeps[name]).eqNullSafe(F.lit(kb_id))) if name in keeps else rows for name, rows in tables.items()}


def delete_file(tables: dict[str, DataFrame], file_id) -> dict[str, DataFrame]:
    """All tables without a file and its chunks."""
    keeps = {"files": "id", "chunks": "file_id"}
    return {name: rows.filter(~F.col(keeps[name]).eqNullSafe(F.lit(file_id))) if name in keeps else rows for name, rows in tables.items()}


def replace_chunks(chunks: DataFrame, new: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Chunks where the files that ``files`` (or else ``new``) names have exactly the chunks of ``new``."""
    named = files.select(F.col("id").alias("file_id")) if files is not None else new.select("file_id")
    return without(chunks, named, file_id="file_id").unionByName(new)


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key: the first in this order."""
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter("_rank = 1").drop("_rank")


FIXED = ("id", "kb_id", "name", "created_at")


def patch_files(files: DataFrame, patches: DataFrame, now: int) -> DataFrame:
    """Files with the columns of ``patches`` (by id) put in where they are not null; who and when created stay."""
    changed = [c for c in patches.columns if c in files.columns and c not in FIXED]
    renamed = patches.select(F.col("id").alias("_id"), F.lit(True).alias("_hit"), *(F.col(c).alias(f"_{c}") for c in changed))
    joined = files.join(renamed, files["id"] == renamed["_id"], "left")

    def column(name: str) -> Column:
        if name in changed:
            return F.coalesce(f"_{name}", files[name]).alias(name)
        if name == "updated_at":
            return F.when(F.col("_hit"), F.lit(now)).otherwise(files[name]).cast("long").alias(name)
        return files[name]

    return joined.select(*(column(c) for c in files.columns))


def set_mounts(mounts: DataFrame, new: DataFrame) -> DataFrame:
    """Mounts after an upsert by (kb_id, workspace_id): flag and note are new, the time of creation stays."""
    keys = ["kb_id", "workspace_id"]
    both = mounts.withColumn("_new", F.lit(0)).unionByName(new.select(*mounts.columns).withColumn("_new", F.lit(1)))
    newest = F.struct("_new", "created_at")
    return both.groupBy(*keys).agg(
        F.max_by("enabled", newest).alias("enabled"), F.max_by("note", newest).alias("note"), F.min_by("created_at", newest).alias("created_at")
    ).select(*mounts.columns)


def delete_mount(mounts: DataFrame, kb_id, workspace_id) -> DataFrame:
    return mounts.filter(~(F.col("kb_id").eqNullSafe(F.lit(kb_id)) & F.col("workspace_id").eqNullSafe(F.lit(workspace_id))))


def workspace_bases(mounts: DataFrame, workspace_id) -> DataFrame:
    """(kb_id) of the bases that a workspace has mounted and switched on."""
    return mounts.filter((F.col("workspace_id") == F.lit(workspace_id)) & F.col("enabled")).select("kb_id").distinct()


def is_mounted(bases: DataFrame, mounts: DataFrame, workspace_id) -> DataFrame:
    """Bases with whether a workspace has them switched on."""
    on = workspace_bases(mounts, workspace_id).select(F.col("kb_id").alias("id"), F.lit(True).alias("mounted"))
    return bases.join(on, "id", "left").fillna(False, ["mounted"])


def progress(operations: DataFrame) -> DataFrame:
    """Operations with the share that is done: whole files, and the part of the current one by its chunks."""
    part = F.when(F.col("chunk_total") > 0, F.col("chunk_done") / F.col("chunk_total")).otherwise(0.0)
    share = F.when(F.col("total") > 0, F.least(F.lit(1.0), (F.col("done") + part) / F.col("total"))).otherwise(0.0)
    return operations.withColumn("progress", share)
