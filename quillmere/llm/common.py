"""Helpers shared by the training-data operators: tables, cuts and batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.sources.checkpoint import cut, ensure_checkpoint_dir

__all__ = ["SLICE", "column_or_null", "cut", "ensure_checkpoint_dir", "map_rows", "row_key", "table"]

#: Rows of a batch that Python holds as objects at once.
SLICE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables, read by Spark from wherever ``sf_dir`` lies."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column_or_null(df: DataFrame, name: str, kind: str):
    """Column ``name`` cast to ``kind``; a null column if ``df`` has none."""
    return F.col(f"`{name}`").cast(kind) if name in df.columns else F.lit(None).cast(kind)


def row_key(df: DataFrame) -> list[Column]:
    """128 bits that stand for all columns of a row, as columns a and b; maps count by their JSON, nulls by their place."""
    columns = [(F.col(f"`{f.name}`"), "map<" in f.dataType.simpleString()) for f in df.schema.fields]
    parts = [x for c, is_map in columns for x in (c.isNull(), F.to_json(c) if is_map else c)]
    return [F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit("b"), *parts).alias("b")]


def map_rows(df: DataFrame, fn: Callable[..., tuple], schema: str) -> DataFrame:
    """Apply ``fn(*row) -> tuple`` to each row, in slices of Arrow batches.

    ``fn`` may also be a factory marked with ``per_task = True``; it is then
    called once in each task and returns the row function, so that models and
    caches are set up once.
    """
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = fn() if getattr(fn, "per_task", False) else fn
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                rows = [each(*row) for row in zip(*(c.to_pylist() for c in part.columns))]
                columns = zip(*rows) if rows else [[] for _ in out]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(columns, out)], schema=out)

    return df.mapInArrow(run, schema)
