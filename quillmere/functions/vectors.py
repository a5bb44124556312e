"""Vector scores: cosine as an expression, and many vectors at once in Arrow batches."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Digits of a score that count; products of matrices differ beyond them with the place of a row.
DIGITS = 12


def _double(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in doubles; 0 for different lengths, empty vectors and zero norms."""
    a, b = _double(a), _double(b)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (F.size(a) == 0) | (norm == 0), 0.0).otherwise(dot(a, b) / norm)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def unpack_float32(blob: pd.Series) -> pd.Series:
    """Vectors out of little-endian 32-bit floats, as other stores keep them; null stays null."""
    return blob.map(lambda b: None if b is None else np.frombuffer(b[: len(b) // 4 * 4], "<f4"))


@F.pandas_udf(T.BinaryType())
def pack_float32(vector: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats of vectors; doubles are rounded."""
    return vector.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


def literal(vector: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector)) if len(vector) else F.array().cast("array<double>")


def scored(rows: DataFrame, query: Sequence[float], vector_col: str = "vector", score_col: str = "score") -> DataFrame:
    """``rows`` of the query's dimension with their cosine; the vector column goes.

    Scores come from one matrix product per Arrow batch, rounded to ``DIGITS``
    so that equal vectors tie wherever they lie. Rows without a vector or of
    another dimension drop out before Python sees them.
    """
    wanted = np.asarray(query, float)
    norm = float(np.sqrt(wanted @ wanted))
    kept = [c for c in rows.columns if c != vector_col]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != vector_col)

    def run(batches):
        for batch in batches:
            x = batch.column(batch.schema.get_field_index(vector_col)).flatten().to_numpy(zero_copy_only=False)
            x = x.astype(float).reshape(batch.num_rows, len(wanted))
            norms = np.sqrt((x * x).sum(axis=1)) * norm
            score = np.divide(x @ wanted, norms, out=np.zeros(len(x)), where=norms > 0).round(DIGITS)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(score)], names=[*kept, score_col])

    fitting = rows.filter(F.col(vector_col).isNotNull() & (F.size(vector_col) == len(wanted)) & ~F.exists(vector_col, lambda x: x.isNull()))
    return fitting.mapInArrow(run, f"{schema}, `{score_col}` double")


def top_k(rows: DataFrame, k: int, *ties: str, score_col: str = "score") -> DataFrame:
    """The k best rows, ties in the order of ``ties``; none for k <= 0. Spark keeps a heap of k rows per task."""
    return rows.orderBy(F.desc(score_col), *ties).limit(max(0, k))
